"""Stratified, blinded and control samples; md5 of a salt and a key stands for every random draw."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import jaccard, length_band, md5_int, tokens
from .scratch import written


def draw(salt: str, key: str) -> Column:
    return md5_int(F.concat(F.lit(salt), F.col(key).cast("string")))


def allocate(df: DataFrame, stratum: str, total: int, whole: tuple = ()) -> DataFrame:
    """(stratum, n, take): the strata of `whole` in full; of what is left of `total`, shares in proportion to size, rounded half to
    even, the residue to the largest of them."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("_whole", F.coalesce(F.col(stratum).isin(*whole) if whole else F.lit(False), F.lit(False)))
    full, rest = sizes.agg(F.sum(F.when(F.col("_whole"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("_whole"), F.col("n")).otherwise(0))).first()
    left = min(total, (full or 0) + (rest or 0)) - (full or 0)
    base = sizes.withColumn("take", F.when(F.col("_whole"), F.col("n")).otherwise(F.bround(F.lit(left) * F.col("n") / max(1, rest or 0)).cast("long")))
    residue = left - (base.where("NOT _whole").agg(F.sum("take")).first()[0] or 0)
    largest = base.where("NOT _whole").orderBy(F.desc("n"), stratum).limit(1).select(F.col(stratum).alias("_s"), F.lit(True).alias("_big"))
    j = base.join(F.broadcast(largest), F.col(stratum).eqNullSafe(F.col("_s")), "left")  # one row
    return j.select(stratum, "n", (F.col("take") + F.when(F.coalesce("_big", F.lit(False)), residue).otherwise(0)).cast("long").alias("take"))


def allocate_within(df: DataFrame, outer: str, inner: str, takes: DataFrame) -> DataFrame:
    """(outer, inner, n, take): each outer stratum's `take` dealt to its inner strata in proportion, rounded half to even, one at least.

    While they sum to too many, the largest allocation gives one up; while to too few, the one with most rows left gets one;
    ties by name. An outer stratum that is to give all its rows gives all. Inner strata of one outer stratum are few and are folded in an array.
    """
    sizes = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    arrays = sizes.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(F.col(inner).alias("k"), "n"))).alias("_s"), F.sum("n").alias("_all"))
    j = arrays.join(takes.select(outer, "take").hint("merge"), outer)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    first = F.transform("_s", lambda x: F.least(x["n"], F.greatest(F.lit(1).cast("long"), F.bround(F.col("take") * x["n"] / F.col("_all")).cast("long"))))
    add = lambda xs, at, by: F.transform(xs, lambda x, i: x + F.when(i + 1 == at, by).otherwise(0))

    def step(xs, _):
        room = F.zip_with("_s", xs, lambda s, x: s["n"] - x)
        fewer, more = add(xs, F.array_position(xs, F.array_max(xs)), -1), add(xs, F.array_position(room, F.array_max(room)), 1)
        return F.when(total(xs) > F.col("take"), fewer).when(total(xs) < F.col("take"), more).otherwise(xs)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.abs(total(F.col("_first")) - F.col("take")).cast("int")))
    j = j.withColumn("_first", first)
    j = j.withColumn("_take", F.when(F.col("take") >= F.col("_all"), F.transform("_s", lambda x: x["n"])).otherwise(F.aggregate(steps, F.col("_first"), step)))
    dealt = j.select(outer, F.explode(F.zip_with("_s", "_take", lambda s, x: F.struct(s["k"].alias("k"), s["n"].alias("n"), x.alias("take")))).alias("r"))
    return dealt.select(outer, F.col("r.k").alias(inner), "r.n", "r.take")


def pick(df: DataFrame, stratum: str, takes: DataFrame, key: str, salt: str) -> DataFrame:
    """The first `take` rows of each stratum by md5. A large stratum is ranked in range partitions."""
    from .order import ranked_within

    r = ranked_within(df.withColumn("_h", draw(salt, key)), stratum, "_h", key)
    return r.join(takes.select(stratum, "take").hint("merge"), stratum).where("rank <= take").drop("_h", "rank", "take")


def round_robin(df: DataFrame, group: str, key: str, total: int) -> DataFrame:
    """`total` rows, one of each group in turn, largest group first."""
    r = df.withColumn("_n", F.count("*").over(W.partitionBy(group))).withColumn("round", F.row_number().over(W.partitionBy(group).orderBy(key)))
    return r.orderBy("round", F.desc("_n"), group).limit(total).drop("_n")


def rotated(df: DataFrame, concept: str, key: str, salt: str) -> DataFrame:
    """`df` with `rank` and `donor_rank`: all rows, sorted by concept and md5, are turned by the size of the largest concept,
    so that no row gets its own concept if none holds more than half, and each donor serves once."""
    from .order import indexed

    r = indexed(df.withColumn("_h", draw(salt, key)), concept, "_h", key).withColumnRenamed("idx", "rank")
    most, n = df.groupBy(concept).count().agg(F.max("count"), F.sum("count")).first()
    return r.withColumn("donor_rank", (F.col("rank") + (most or 0)) % max(1, n or 0)).drop("_h")


#: Rows of one value of a key from which on what is known of the value is broadcast: at most one value for as many rows.
HOT = 1 << 16


def told_of(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `known`, which has a row for each value of `key` and its number of rows as `_rows`. Rows of a value that has over HOT of them stay where they are,
    so no task gets all of them; others are shuffled by the key."""
    hot, cold = known.where(F.col("_rows") > HOT).drop("_rows"), known.where(F.col("_rows") <= HOT).drop("_rows")
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, how)
    return near.unionByName(rest)


def distractor_candidates(records: DataFrame, item: str, pool: list[str], most: int, salt: str, asked: DataFrame | None = None) -> DataFrame:
    """(item, place, answer, concept, facet, n_pool): up to `most` answers of the same `pool` (columns of `records`; none: of all) for each record, or for those of
    `asked`, and the size of the pool.

    The distinct answers of a pool stand in a circle in md5 order; a record's candidates are the next ones from a place that md5 of its
    item draws. Each record joins `most` places, so a large pool makes no pairs of records.
    """
    from .order import indexed

    key = F.concat_ws("\x1f", F.lit(salt), *[F.col(c).cast("string") for c in pool])
    answers = records.select(key.alias("_pool"), "concept", "facet", "answer").distinct().withColumn("_h", md5_int(F.concat(F.lit(salt), "answer")))
    ring = indexed(answers, "_pool", "_h", "answer", "concept", "facet")
    spans = ring.groupBy("_pool").agg(F.min("idx").alias("_low"), F.count("*").alias("n_pool"))
    asked = (records if asked is None else asked).select(item, key.alias("_pool"))
    spans = written(asked.groupBy("_pool").agg(F.count("*").alias("_rows")).join(spans.hint("merge"), "_pool"))
    asked = told_of(asked, spans, "_pool")
    start = md5_int(F.concat(F.lit(salt), F.col(item).cast("string")))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most), "n_pool") - 1), lambda i: F.col("_low") + (start + i) % F.col("n_pool"))
    asked = asked.select(item, "n_pool", F.posexplode(places).alias("place", "idx"))
    return asked.join(ring.hint("merge"), "idx").select(item, "place", "answer", "concept", "facet", "n_pool")


def _chosen(records: DataFrame, asked: DataFrame, item: str, hard: bool, n: int, most: int, alike: float, salt: str) -> DataFrame:
    """(item, _gold, _kept, _settled): the greedy choice among the next `most` answers of each pool, and whether longer looks can't change it.

    A stage is spent if its pool was looked at as a whole or each of its tags has been taken. A choice is settled if every stage before that of its last
    answer is spent; one that lacks answers, if all stages are.
    """
    gold = asked.select(item, F.col("concept").alias("_c"), F.col("facet").alias("_f"), F.col("answer").alias("_gold"))
    # the numbers of tags meet the bare records, before lists make them long
    tags = lambda by, of, name: records.groupBy(*[F.col(c).alias(k) for c, k in by]).agg((F.countDistinct(of) - 1).alias(name), F.count("*").alias("_rows"))
    of_concepts, of_facets = written(tags([("concept", "_c")], "facet", "_t1")), written(tags([("facet", "_f")], "concept", "_t3"))
    gold = told_of(told_of(gold, of_concepts, "_c", "left"), of_facets, "_f", "left").crossJoin(F.broadcast(tags([], "concept", "_t4").drop("_rows")))  # the last is one row
    gold = written(gold)

    def stage(pool: list[str], order: int, ok: Column, tag: Column) -> DataFrame:
        found = distractor_candidates(records, item, pool, most, f"{salt}{order}", asked).join(gold.hint("merge"), item)
        # an answer that doesn't qualify leaves the pool's size behind
        return found.select(item, F.lit(order).alias("stage"), "place", F.when(ok, F.col("answer")).alias("answer"), F.when(ok, tag).alias("tag"), "n_pool")

    away = F.col("concept") != F.col("_c")
    of = F.concat(F.lit("c:"), F.col("concept").cast("string"))
    stages = [stage(["facet"], 3, away, of), stage([], 4, away, of)]
    if hard:
        inside = (F.col("concept") == F.col("_c")) & (F.col("facet") != F.col("_f")) & (F.col("answer") != F.col("_gold"))
        first = stage(["concept"], 1, inside, F.concat(F.lit("f:"), F.col("facet").cast("string")))
        stages = [first, first.select(item, F.lit(2).alias("stage"), "place", "answer", F.lit(None).cast("string").alias("tag"), "n_pool"), *stages]
    every = functools.reduce(DataFrame.union, stages)
    size = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("n_pool"))), F.lit(0)).alias(f"_n{s}")
    own = F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("stage", "place", "answer", "tag")))
    listed = every.groupBy(item).agg(F.array_sort(own).alias("_list"), *[size(s) for s in (1, 2, 3, 4)]).join(gold.hint("merge"), item)
    words = lambda x: F.array_distinct(tokens(x))
    near = lambda a, b: jaccard(words(a), words(b)) > alike
    kind = dict(records.dtypes)["answer"]

    def step(kept, c):
        clash = F.exists(kept, lambda k: F.coalesce(k["tag"] == c["tag"], F.lit(False)) | near(k["answer"], c["answer"]))
        return F.when((F.size(kept) >= n) | near(c["answer"], F.col("_gold")) | clash, kept).otherwise(F.concat(kept, F.array(F.struct(c["stage"].alias("stage"), c["answer"].alias("answer"), c["tag"].alias("tag")))))

    chosen = listed.withColumn("_kept", F.aggregate("_list", F.array().cast(f"array<struct<stage:int,answer:{kind},tag:string>>"), step))
    taken = lambda *s: F.size(F.filter("_kept", lambda k: k["stage"].isin(*s)))
    full = F.size("_kept") >= n
    last = F.when(full, F.element_at("_kept", -1)["stage"]).otherwise(5)
    spent = {1: taken(1) >= F.col("_t1"), 2: F.lit(False), 3: taken(3) >= F.col("_t3"), 4: taken(3, 4) >= F.col("_t4")}
    settled = functools.reduce(Column.__and__, [(last <= s) | (F.col(f"_n{s}") <= most) | F.coalesce(spent[s], F.lit(False)) for s in spent])
    return chosen.select(item, "_gold", "_kept", settled.alias("_settled"))


def distractors(records: DataFrame, item: str, hard: bool, n: int = 3, most: int = 24, alike: float = 0.6, salt: str = "mcq") -> DataFrame:
    """(item, options, gold_position, fell_back) of the records (item, concept, facet, answer) that get `n` distractors.

    Distractors have a Jaccard similarity of at most `alike` to the answer and to one another. Easy ones come from other concepts, one
    of each: first of the same facet, then of any. Hard ones come from other facets of the same concept: one of each facet, then
    any; if these are too few, from other concepts as the easy ones. Options stand in md5 order.

    Every record looks at the next `most` answers of each pool; those whose choice longer looks could change look four times as far, and so on
    until their pools are spent: the result is that of a search of all answers. Greedy choice runs over one record's candidates.
    """
    asked, found = records, None
    while True:
        judged = written(_chosen(records, asked, item, hard, n, most, alike, salt))
        settled = judged.where("_settled")
        found = settled if found is None else found.union(settled)
        rest = judged.where("NOT _settled").select(item)
        if rest.isEmpty():
            break
        asked, most = records.join(rest.hint("merge"), item, "left_semi"), most * 4
    chosen = found.where(F.size("_kept") >= n)
    answers = F.concat(F.array("_gold"), F.transform("_kept", lambda k: k["answer"]))
    mixed = F.transform(F.array_sort(F.transform(answers, lambda o: F.struct(md5_int(F.concat(F.col(item).cast("string"), F.lit("opt"), o)).alias("h"), o.alias("o")))), lambda x: x["o"])
    done = chosen.select(item, "_gold", mixed.alias("options"), F.exists("_kept", lambda k: k["stage"] > 2).alias("fell_back"))
    return done.select(item, "options", (F.array_position("options", F.col("_gold")) - 1).alias("gold_position"), "fell_back")


def collect_arm(jobs: DataFrame, replies: DataFrame, item: str, kind: str, order: list[str]) -> DataFrame:
    """(item, kind, place, target, words, choice, in_band) for every job: the n-th job of an item and type takes the n-th reply to them.

    `jobs` has `target`, `replies` have `words` and `choice`; of a job without a reply these are null and it is out of its band.
    """
    placed = lambda df: df.withColumn("place", F.row_number().over(W.partitionBy(item, kind).orderBy(*order)))
    told = placed(replies).select(item, kind, "place", "words", "choice")
    low, high = length_band(F.col("target"))
    met = placed(jobs).select(item, kind, "place", "target").join(told.hint("merge"), [item, kind, "place"], "left")
    return met.withColumn("in_band", F.coalesce(F.col("words").between(low, high), F.lit(False)))


def arm_report(collected: DataFrame, kind: str, n_options: int) -> DataFrame:
    """Per type: jobs, answered ones, replies that name an option there is, replies in their length band."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return collected.groupBy(kind).agg(F.count("*").alias("n_jobs"), F.count("words").alias("n_answered"), n(F.col("choice").between(0, n_options - 1), "n_valid"), n(F.col("in_band"), "n_in_band"))


def blinded(records: DataFrame, key: list[str], salt: str) -> tuple[DataFrame, DataFrame]:
    """(shown, keys) of pooled records: `shown` has rec_id, a digest of the salt and the key columns, and the columns that aren't key; `keys` has rec_id and the key columns,
    and is kept apart. The order of rec_id is the shuffle."""
    rec = F.sha2(F.concat_ws("\x1f", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in key]), 256).alias("rec_id")
    return records.select(rec, *[c for c in records.columns if c not in key]), records.select(rec, *key)


def with_abstain(options: Column, abstain: str) -> Column:
    """Options with the abstain option at the end, unless they have it."""
    return F.when(F.array_contains(options, abstain), options).otherwise(F.concat(options, F.array(F.lit(abstain))))


def job_labels(jobs: DataFrame, reference: DataFrame, votes: DataFrame, item: str, label: str, voter: str, vote: str, named: int | str | None = None) -> DataFrame:
    """`jobs` with `given`: the reference's label of the item, or the vote of the voter `named`; jobs whose voter abstained (`none`) or has no vote go."""
    if named is None:
        return jobs.join(reference.select(item, F.col(label).alias("given")).hint("merge"), item)
    told = votes.where((F.col(voter) == named) & (F.col(vote) != "none")).select(item, F.col(vote).alias("given"))
    return jobs.join(told.hint("merge"), item)
