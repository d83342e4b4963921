"""Votes, audits, gates and release tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import md5_int
from .scratch import written


def vote(label: Column, confidence: Column, valid: list[str]) -> Column:
    """The label if it is a valid one given with high or medium confidence, else `none`."""
    return F.when(label.isin(*valid) & confidence.isin("high", "medium"), label).otherwise("none")


def consensus(votes: DataFrame, item: str, vote: str, voters: int, strict: bool = True) -> DataFrame:
    """(item, n_votes, winner): the most frequent vote but `none`, if it has a majority of `voters`; ties by vote.

    Two grouped counts; the second starts from one row per item and vote. `strict`: ceil((k + 1) / 2), else ceil(k / 2).
    """
    need = -(-(voters + 1) // 2) if strict else -(-voters // 2)
    counts = votes.groupBy(item, vote).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col(vote) != "none", F.struct((-F.col("n")).alias("less"), F.col(vote).alias("v"))))
    r = counts.groupBy(item).agg(F.sum("n").alias("n_votes"), best.alias("b"))
    return r.select(item, "n_votes", F.when(-F.col("b.less") >= need, F.col("b.v")).otherwise("none").alias("winner"))


def gate(items: DataFrame, votes: DataFrame, item: str, label: str, vote: str, least: int) -> DataFrame:
    """Items whose label at least `least` voters name, with that number."""
    named = votes.join(items.select(item, F.col(label).alias("_label")).hint("merge"), item).groupBy(item).agg(F.count(F.when(F.col(vote) == F.col("_label"), 1)).alias("n_agree"))
    return items.join(named.hint("merge"), item).where(F.col("n_agree") >= least)


def with_ancestors(items: DataFrame, item: str, parent: str, ok: str) -> DataFrame:
    """`items` with `ok` false also where any item that they derive from, at whatever distance, is not ok; an unknown parent counts as ok.

    Each round joins every item with its ancestor and takes over the ancestor's own one, so a chain takes as many rounds as its length has
    binary digits; a circle ends when no verdict changes any more and every chain that ends has ended.
    """
    state = written(items.select(F.col(item).alias("_item"), F.col(parent).alias("_up"), F.coalesce(F.col(ok), F.lit(False)).alias("_ok")))
    before = None
    while True:
        now = tuple(state.agg(F.count("_up"), F.count(F.when(~F.col("_ok"), 1))).first())
        if not now[0] or now == before:
            break
        before = now
        above = state.select(F.col("_item").alias("_up"), F.col("_up").alias("_next"), F.col("_ok").alias("_above"))
        state = written(state.join(above.hint("merge"), "_up", "left").select("_item", F.col("_next").alias("_up"), (F.col("_ok") & F.coalesce("_above", F.lit(True))).alias("_ok")))
    return items.drop(ok).join(state.select(F.col("_item").alias(item), F.col("_ok").alias(ok)).hint("merge"), item)


def released(items: DataFrame, votes: DataFrame, item: str, label: str, vote: str, least: int, parent: str) -> DataFrame:
    """`items` with `n_agree` and `status`: kept, not_agreed (an item with a label that fewer than `least` voters name), or derived (from an item that goes).
    An item without a label is a refusal, which no vote concerns."""
    named = votes.join(items.select(item, F.col(label).alias("_label")).hint("merge"), item).groupBy(item).agg(F.count(F.when(F.col(vote) == F.col("_label"), 1)).alias("n_agree"))
    told = items.join(named.hint("merge"), item, "left").withColumn("n_agree", F.coalesce("n_agree", F.lit(0).cast("long")))
    told = told.withColumn("_own", F.col(label).isNull() | (F.col("n_agree") >= least))
    told = with_ancestors(told.withColumn("_all", F.col("_own")), item, parent, "_all")
    return told.withColumn("status", F.when(~F.col("_own"), "not_agreed").when(~F.col("_all"), "derived").otherwise("kept")).drop("_own", "_all")


def vote_matrix(votes: DataFrame, item: str, voter: str, vote: str, voters: list) -> DataFrame:
    """One row per item with a column for each of `voters`, named by them; null where one has no vote."""
    return votes.groupBy(item).pivot(voter, voters).agg(F.min(vote))


def transitions(df: DataFrame, before: str, after: str, most: int = 10) -> DataFrame:
    """(before, after, n): the most frequent changes of a label, `most` of them; ties by label."""
    changed = df.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(before, after).agg(F.count("*").alias("n"))
    return changed.orderBy(F.desc("n"), before, after).limit(most)


def audit_tier(verdict: Column) -> Column:
    """yes / partial / no to primary / review / salvage; a missing verdict goes to review."""
    return F.when(verdict == "yes", "primary").when(verdict == "no", "salvage").otherwise("review")


def next_different(df: DataFrame, order: list[str], concept: str, groups: str, half: bool = True) -> DataFrame:
    """`df` with `partner_rank`: inside a group, rows are ranked; a row's partner is the first row, from half the
    group onwards (without `half`, from the row itself) and then from its start, with another concept. Null if the group has one concept only.

    The rank of the next row with another concept is found by a window from the end, so no pairs are made.
    """
    w = W.partitionBy(groups).orderBy(*order)
    r = df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(groups)))
    changes = F.when(F.lead(concept).over(w).isNotNull() & (F.lead(concept).over(w) != F.col(concept)), F.col("_k") + 1)
    r = r.withColumn("_next", F.min(changes).over(W.partitionBy(groups).orderBy("_k").rowsBetween(0, W.unboundedFollowing)))
    ahead = F.floor(F.col("_n") / 2) if half else F.lit(0)
    start = F.when(F.col("_k") + ahead < F.col("_n"), F.col("_k") + ahead).otherwise(0)
    r = r.withColumn("_start", start)
    at = r.select(groups, F.col("_k").alias("_start"), F.col(concept).alias("_c0"), F.col("_next").alias("_n0"))
    zero = r.where("_k = 0").select(groups, F.col(concept).alias("_cz"), F.col("_next").alias("_nz"))
    j = r.join(at.hint("merge"), [groups, "_start"]).join(zero.hint("merge"), groups)
    wrapped = F.when(F.col("_cz") != F.col(concept), 0).otherwise(F.col("_nz"))
    partner = F.when(F.col("_c0") != F.col(concept), F.col("_start")).otherwise(F.coalesce("_n0", wrapped))
    return j.withColumn("rank", F.col("_k").cast("long")).withColumn("partner_rank", partner.cast("long")).select(*df.columns, "rank", "partner_rank")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count and percentage of each value, null included, inside `by`."""
    counts = df.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("verdict")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)), 4))


def majority(judgements: DataFrame, item: str, model: str, passed: Column, models: int) -> DataFrame:
    """Items judged by all models, and whether most of them pass."""
    r = judgements.groupBy(item).agg(F.countDistinct(model).alias("n_models"), F.count(F.when(passed, 1)).alias("n_pass"))
    return r.where(F.col("n_models") == models).withColumn("majority", F.col("n_pass") >= models // 2 + 1)


def match_roles(known: DataFrame, given: DataFrame, item: str, role: str, label: str) -> DataFrame:
    """For each given rater the known role that agrees most, with the share of agreement."""
    j = known.select(item, F.col(role).alias("known"), F.col(label).alias("_a")).join(given.select(item, F.col(role).alias("given"), F.col(label).alias("_b")).hint("merge"), item)
    rates = j.groupBy("given", "known").agg(F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("rate"))
    best = rates.groupBy("given").agg(F.min(F.struct((-F.col("rate")).alias("less"), "known")).alias("b"))
    return best.select("given", F.col("b.known").alias("known"), F.round(-F.col("b.less"), 6).alias("rate"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(label, got, want, ok): every expected value against what was found, within its tolerance; a missing one fails."""
    j = expected.join(found, "label", "left")
    return j.select("label", "got", "want", F.coalesce(F.abs(F.col("got") - F.col("want")) <= F.col("tol"), F.lit(False)).alias("ok"))


def display_names(items: DataFrame, concept: str, answer: str) -> DataFrame:
    """(concept, display): the most frequent answer of each concept's items, ties by answer."""
    counts = items.where(F.col(concept).isNotNull()).groupBy(concept, answer).agg(F.count("*").alias("n"))
    return counts.groupBy(concept).agg(F.min(F.struct((-F.col("n")).alias("less"), answer)).alias("b")).select(concept, F.col(f"b.{answer}").alias("display"))


def correct_concepts(items: DataFrame, verdicts: DataFrame, inventory: DataFrame, item: str, concept: str, answer: str, refusal: str, salt: str = "fix", n_options: int = 4) -> DataFrame:
    """(item, action, concept, corrected_from, answer, options) after a concept audit; action is agreed, confirmed, corrected or refused.

    Items without a verdict, and those whose verdict is `original`, stay. A verdict `reperceived` or `other` with a `correct` concept
    that `inventory` holds rebuilds the item: the answer is the concept's display name, the distractors are the next names
    from a place that md5 draws, and md5 orders the options. All else becomes a refusal without a concept, with `refusal` as its answer.
    """
    from .order import indexed

    names = display_names(items, concept, answer)
    known = inventory.select(F.col(concept).alias("correct")).distinct().join(names.select(F.col(concept).alias("correct"), "display").hint("merge"), "correct", "left")
    j = items.select(item, concept, answer).join(verdicts.select(item, "verdict", "correct").hint("merge"), item, "left").join(known.withColumn("held", F.lit(True)).hint("merge"), "correct", "left")
    action = F.when(F.col("verdict").isNull(), "agreed").when(F.col("verdict") == "original", "confirmed")
    action = action.when(F.col("verdict").isin("reperceived", "other") & F.col("held"), "corrected").otherwise("refused")
    j = j.withColumn("action", action).withColumn("shown", F.coalesce("display", "correct"))
    labels = indexed(names.select("display").distinct(), "display")
    n = labels.count()
    start = md5_int(F.concat(F.lit(salt), F.col(item).cast("string")))
    asked = j.where("action = 'corrected'").select(item, "shown", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(n, n_options) - 1)), lambda i: (start + i) % max(1, n))).alias("place", "idx"))
    near = asked.join(labels.select("idx", "display").hint("merge"), "idx").where("display != shown")
    taken = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "display"))), 1, n_options - 1), lambda x: x["display"])
    drawn = near.groupBy(item, "shown").agg(taken.alias("distractors"))
    mixed = F.array_sort(F.transform(F.concat(F.array("shown"), "distractors"), lambda o: F.struct(md5_int(F.concat(F.lit(salt), F.col(item).cast("string"), o)).alias("h"), o.alias("o"))))
    drawn = drawn.select(item, F.transform(mixed, lambda x: x["o"]).alias("options"))
    moved, fixed = F.col("action") == "refused", F.col("action") == "corrected"
    return j.join(drawn.hint("merge"), item, "left").select(
        item,
        "action",
        F.when(fixed, F.col("correct")).when(~moved, F.col(concept)).alias(concept),
        F.when(fixed, F.col(concept)).alias("corrected_from"),
        F.when(moved, refusal).when(fixed, F.col("shown")).otherwise(F.col(answer)).alias(answer),
        "options",
    )


def merge_notes(items: DataFrame, notes: DataFrame, item: str, labels: str, names: list[str]) -> DataFrame:
    """`items` whose label map has the notes of `notes` (item, name, text), trimmed; old notes under `names` go first, blank ones are none."""
    kept = notes.where(F.col("name").isin(*names)).select(item, "name", F.trim("text").alias("text")).where("text != ''")
    new = kept.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "text")))).alias("_new"))  # a note of each name
    cleared = F.map_filter(F.col(labels), lambda k, v: ~k.isin(*names))
    j = items.join(new.hint("merge"), item, "left")
    return j.withColumn(labels, F.when(F.col("_new").isNull(), cleared).otherwise(F.map_concat(cleared, "_new"))).drop("_new")


def voters(votes: DataFrame, voter: str, vote: str, gold: str, confirmed: str) -> DataFrame:
    """Per voter: votes, agreement with `gold`, votes of none, replies not parsed (null), and agreement where raters confirmed the label and where one rejected it."""
    agree = F.coalesce(F.col(vote) == F.col(gold), F.lit(False)).cast("int")
    over = lambda c: F.round(F.avg(F.when(c, agree)), 6)
    return votes.groupBy(voter).agg(
        F.count("*").alias("n"), F.round(F.avg(agree), 6).alias("agreement"), F.count(F.when(F.col(vote) == "none", 1)).alias("n_none"), F.count(F.when(F.col(vote).isNull(), 1)).alias("n_unparsed"),
        over(F.col(confirmed)).alias("on_confirmed"), over(~F.col(confirmed)).alias("on_rejected"),
    )


def regeneration(questions: DataFrame, issues: DataFrame, checks: DataFrame, item: str, kind: str, discard: tuple[str, ...] = ("answerable", "off_topic", "unfaithful")) -> DataFrame:
    """Per item with issues: the types to write anew, the types that stay, whether a type was flagged in two passes, and how many new candidates go.

    `questions` and `issues` hold (item, kind), issues also `pass`; `checks` (item, kind, verdict) is an independent look at the new candidates, and
    those with a verdict of `discard` go. Types of an item are few.
    """
    flagged = issues.groupBy(item, kind).agg(F.countDistinct("pass").alias("_n"))
    bad = checks.where(F.col("verdict").isin(*discard)).select(item, kind).distinct().withColumn("_bad", F.lit(True))
    marked = questions.select(item, kind).distinct().join(flagged.hint("merge"), [item, kind], "left").join(bad.hint("merge"), [item, kind], "left")
    again = F.col("_n").isNotNull()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(kind)))), ",")
    r = marked.groupBy(item).agg(names(again).alias("regen_types"), names(~again).alias("kept"), F.coalesce(F.max("_n") >= 2, F.lit(False)).alias("second_pass"), F.count(F.when(again & F.col("_bad"), 1)).alias("n_discarded"), F.count("_n").alias("_some"))
    return r.where("_some > 0").drop("_some")


def audit_precision(df: DataFrame, by: list[str], verdict: str, cross: str) -> DataFrame:
    """Per group: items, audited ones, and shares of them: precise (yes or partial), clear (yes); of items that the cross-check rejects, those not clear, and of those
    that it accepts (yes or partial), the clear ones. Only audited items count for precision; an unaudited one is not clear."""
    v, c = F.col(verdict), F.col(cross)
    n = lambda x: F.count(F.when(x, 1))
    share = lambda x, of: F.round(F.try_divide(n(of & F.coalesce(x, F.lit(False))), n(of)), 6)
    clear, accepted = F.coalesce(v == "yes", F.lit(False)), F.coalesce(c.isin("yes", "partial"), F.lit(False))
    rejected = F.coalesce(c == "no", F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(v).alias("n_audited"), share(v.isin("yes", "partial"), v.isNotNull()).alias("precision"), share(clear, v.isNotNull()).alias("clear"), share(~clear, rejected).alias("rejected_rightly"), share(clear, accepted).alias("accepted_rightly"))


def confusion(df: DataFrame, one: str, other: str) -> DataFrame:
    """(one, other, n): how often two verdicts meet; null is a verdict of its own."""
    return df.groupBy(one, other).agg(F.count("*").alias("n"))


def assign_roles(known: DataFrame, given: DataFrame, item: str, role: str, label: str, least: float = 0.9) -> DataFrame:
    """(given, known, rate, problem) of each given rater: the known role whose labels its own agree with most, ties by name; `problem` says why it is no
    identification: `agreement` below `least`, or a role `claimed` by several. Null: identified."""
    best = match_roles(known, given, item, role, label)
    claims = best.where(F.col("rate") >= least).groupBy("known").agg(F.count("*").alias("_n"))
    told = best.join(claims.hint("merge"), "known", "left")
    return told.select("given", "known", "rate", F.when(F.col("rate") < least, "agreement").when(F.col("_n") > 1, "claimed").alias("problem"))


def kept_dependents(tables: dict[str, tuple[DataFrame, str]], dropped: DataFrame, item: str) -> dict[str, DataFrame]:
    """Each dependent table (rows, name of its item column) without the rows of dropped items; rows without an item stay."""
    gone = dropped.select(F.col(item).alias("_gone")).distinct()
    return {name: rows.join(gone.hint("merge"), F.col(key) == F.col("_gone"), "left_anti") for name, (rows, key) in tables.items()}


def worst(df: DataFrame, value: str, key: str, most: int = 6) -> DataFrame:
    """The `most` rows of least `value`; ties by key."""
    return df.orderBy(value, key).limit(most)


def audit_verdict(original: Column, reperceived: Column, other: Column) -> Column:
    """What an auditor's three answers say of a concept: the original one is right, else the second look's, else another, else none."""
    return F.when(original, "original").when(reperceived, "reperceived").when(other, "other").otherwise("none")


def disagreement_verdict(a_ok: Column, b_ok: Column, answerable: Column) -> Column:
    """Of two disagreeing fields: refuse what can't be answered, else say which of them needs fixing."""
    return F.when(~answerable, "refuse").when(a_ok & b_ok, "ok").when(~a_ok & ~b_ok, "fix_both").when(~a_ok, "fix_a").otherwise("fix_b")
