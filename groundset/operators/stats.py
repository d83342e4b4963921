"""Scores, agreement, paired tests and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import md5_int, wilson
from .order import indexed


#: Clusters of a bootstrap that are broadcast at most, 24 bytes each, and draws that a task makes.
BROADCAST_CLUSTERS, DRAWS = 1 << 23, 1 << 21


def accuracy(df: DataFrame, by: list[str], pred: str, gold: str) -> DataFrame:
    """n, right and share right, an unparsed prediction counting as wrong, with its Wilson interval."""
    right = F.coalesce(F.col(pred) == F.col(gold), F.lit(False)).cast("int")
    r = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(right).cast("long").alias("n_right"))
    low, high = wilson(F.col("n_right"), F.col("n"))
    return r.withColumns({"accuracy": F.round(F.col("n_right") / F.col("n"), 6), "low": low, "high": high})


def macro(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Mean of the groups' means."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.count("*").alias("n_groups"), F.round(F.avg("m"), 6).alias("macro"))


def risk(df: DataFrame, by: list[str], wrong: Column, answered: Column, severity: Column) -> DataFrame:
    """Coverage, error among the answered, and error weighted by severity over the number answered; 0 if nothing is."""
    w = F.when(answered & wrong, severity).otherwise(0)
    r = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(answered, 1)).alias("n_answered"), F.count(F.when(answered & wrong, 1)).alias("n_wrong"), F.sum(w).cast("double").alias("weighted"))
    over = lambda c, d: F.when(F.col(d) > 0, F.round(F.col(c) / F.col(d), 6)).otherwise(0.0)
    return r.select(*by, "n", over("n_answered", "n").alias("coverage"), over("n_wrong", "n_answered").alias("error"), over("weighted", "n_answered").alias("risk"))


def _log_factorial(n: Column) -> Column:
    """Exact up to 20, then by Stirling's series, whose error there is below 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts; 1 without a discordant pair.

    The binomial tail is its last term times a sum of falling products, of which those beyond about nine standard deviations add nothing: the work
    grows with the root of the counts.
    """
    n, k = b + c, F.least(b, c)
    last = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2))
    terms = F.least(k, F.ceil(9 * F.sqrt(n)) + 40).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s, j):
        term = s["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["sum"])
    return F.round(F.least(F.lit(1.0), 2 * last * total), 6)


def ac1(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Gwet's AC1 of any number of raters and categories, over items with two ratings or more; null if chance is certain."""
    counts = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("n"))
    sized = counts.withColumn("r", F.sum("n").over(W.partitionBy(item))).where("r > 1")
    items = sized.groupBy(item).agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("r") * (F.col("r") - 1))).alias("agree"))
    pa = items.agg(F.avg("agree").alias("pa"), F.count("*").alias("n_items"))
    total = sized.groupBy(label).agg(F.sum(F.col("n") / F.col("r")).alias("share")).crossJoin(F.broadcast(pa))  # pa is one row
    pi = F.col("share") / F.col("n_items")
    r = total.agg(F.first("pa").alias("pa"), F.first("n_items").alias("n_items"), F.sum(pi * (1 - pi)).alias("spread"), F.count("*").alias("q"))
    pe = F.when(F.col("q") > 1, F.col("spread") / (F.col("q") - 1)).otherwise(0.0)
    return r.select("n_items", F.round("pa", 6).alias("observed"), F.round(F.when(pe < 1, (F.col("pa") - pe) / (1 - pe)), 6).alias("ac1"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, reps: int = 1000, salt: str = "boot") -> DataFrame:
    """(mean, low, high): the mean, and the 2.5 and 97.5 % quantiles of means over resampled clusters.

    Clusters are reduced to a sum and a count first; a repetition draws as many clusters as there are, by md5 of its
    number and the slot, so reps x clusters small rows are joined, never reps x rows. Up to BROADCAST_CLUSTERS clusters, which are counted first, are sent to
    the draws, which are then summed where they are made, and only a row for each repetition and task is shuffled.
    """
    from .order import indexed

    sums = indexed(df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")), cluster)
    k = sums.count()
    slots = sums.select(F.col("idx").alias("slot")).repartition(min(4096, 1 + k * reps // DRAWS), "slot")  # a slot is a few bytes, but has `reps` draws
    draws = slots.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    draws = draws.select("rep", (md5_int(F.concat(F.lit(salt), F.col("rep").cast("string"), F.lit("-"), F.col("slot").cast("string"))) % max(1, k)).alias("idx"))
    few = sums.select("idx", "s", "n")
    means = draws.join(F.broadcast(few) if k <= BROADCAST_CLUSTERS else few.hint("shuffle_hash"), "idx").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    whole = sums.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))
    return whole.crossJoin(F.broadcast(means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))))  # one row each


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """`df` with the average rank of `value` inside `by`: values are counted first, so only distinct values are put in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(counts.withColumn(name, before + (F.col("_c") + 1) / 2).drop("_c").hint("merge"), [*by, value], "left")


def judge_agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson, Spearman (average ranks of the rows that both judged), share within 1, and mean absolute difference of two judges."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_ranks(average_ranks(both, by, a, "_ra"), by, b, "_rb")
    gap = F.abs(F.col(a) - F.col(b))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.corr(a, b), 4).alias("pearson"), F.round(F.corr("_ra", "_rb"), 4).alias("spearman"), F.round(F.avg((gap <= 1).cast("int")), 6).alias("within_one"), F.round(F.avg(gap), 6).alias("mae"))


def micro_macro(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """Sum over sum, and mean of ratios, over rows that have both and a positive denominator; null if there is none."""
    ok = F.col(num).isNotNull() & F.col(den).isNotNull()
    return df.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.when(ok, F.col(num))), F.sum(F.when(ok, F.col(den)))), 6).alias("micro"), F.round(F.avg(F.when(ok, F.try_divide(num, den))), 6).alias("macro"))


def paired(df: DataFrame, item: str, arm: str, value: str, arms: tuple[str, str], judge: str) -> DataFrame:
    """Per judge: items of either arm, items that both arms have, the means over these, their difference, and how often the first wins, ties and loses."""
    wide = df.groupBy(judge, item).agg(*[F.avg(F.when(F.col(arm) == x, F.col(value))).alias(k) for k, x in zip("ab", arms)])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    return wide.groupBy(judge).agg(
        F.count("*").alias("n_items"), n(both).alias("n"), F.round(F.avg(a), 6).alias("mean_a"), F.round(F.avg(b), 6).alias("mean_b"), F.round(F.avg(a - b), 6).alias("difference"), n(a > b).alias("wins"), n(a == b).alias("ties"), n(a < b).alias("losses"),
    )


def paired_interval(df: DataFrame, item: str, cluster: str, arm: str, value: str, arms: tuple[str, str], reps: int = 1000) -> DataFrame:
    """The mean difference of two arms over items that both have, with its cluster bootstrap interval."""
    wide = df.groupBy(cluster, item).agg(*[F.avg(F.when(F.col(arm) == x, F.col(value))).alias(k) for k, x in zip("ab", arms)])
    return cluster_bootstrap(wide.where("a IS NOT NULL AND b IS NOT NULL").select(cluster, (F.col("a") - F.col("b")).alias("d")), cluster, "d", reps)


def control_table(df: DataFrame, by: list[str], gold: str, base: str, controls: dict[str, str]) -> DataFrame:
    """Accuracy of the baseline and of each control (name: column), the difference, the exact McNemar p, and the baseline's abstentions."""
    right = lambda c: F.coalesce(F.col(c) == F.col(gold), F.lit(False))
    aggs = [F.round(F.avg(right(base).cast("int")), 6).alias("baseline"), F.round(F.avg(F.col(base).isNull().cast("int")), 6).alias("abstain")]
    for name, c in controls.items():
        aggs += [F.round(F.avg(right(c).cast("int")), 6).alias(name), F.round(F.avg(right(c).cast("int")) - F.avg(right(base).cast("int")), 6).alias(f"{name}_delta")]
        aggs += [F.count(F.when(right(base) & ~right(c), 1)).alias(f"_{name}_b"), F.count(F.when(~right(base) & right(c), 1)).alias(f"_{name}_c")]
    r = df.groupBy(*by).agg(*aggs)
    return r.withColumns({f"{name}_p": mcnemar(F.col(f"_{name}_b"), F.col(f"_{name}_c")) for name in controls}).drop(*[f"_{name}_{x}" for name in controls for x in "bc"])


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], exclusive: bool = False) -> DataFrame:
    """Per group: `n` and the quantiles named in `at`, exact, with linear interpolation; null values don't count.

    Rows are range-partitioned by group and value and numbered in that order, so no task holds a group; two order statistics of each quantile are then
    looked up by number. `exclusive`: the quantile p stands at p (n + 1), as of a sample, and beyond the ends of a small one.
    """
    rows = indexed(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), *by, "_v")
    spans = rows.groupBy(*by).agg(F.min("idx").alias("_low"), F.count("*").alias("n"))
    place = {name: F.lit(p) * (F.col("n") + 1) - 1 if exclusive else F.lit(p) * (F.col("n") - 1) for name, p in at.items()}
    below = {name: F.greatest(F.lit(0), F.least(F.floor(pos), F.col("n") - 2)).cast("long") for name, pos in place.items()}
    looked = F.array(*[F.struct(F.lit(f"{name} {i}").alias("which"), (F.col("_low") + F.least(lo + i, F.col("n") - 1)).alias("idx")) for name, lo in below.items() for i in (0, 1)])
    wanted = spans.select(*by, "n", F.explode(looked).alias("w")).select(*by, "n", "w.*")
    met = wanted.join(rows.select("idx", "_v").hint("merge"), "idx").groupBy(*by, "n").agg(*[F.max(F.when(F.col("which") == f"{name} {i}", F.col("_v"))).alias(f"{name} {i}") for name in at for i in (0, 1)])
    mixed = {name: F.col(f"`{name} 0`") + (place[name] - below[name]) * (F.col(f"`{name} 1`") - F.col(f"`{name} 0`")) for name in at}
    return met.select(*by, "n", *[v.alias(name) for name, v in mixed.items()])


def risk_schemes(df: DataFrame, by: list[str], wrong: Column, answered: Column, severity: Column, schemes: dict[str, dict[int, float]], default: float = 2.0) -> DataFrame:
    """(by, scheme, n_answered, risk): the weight of wrong answers over the number answered, 0 if nothing is, for each scheme of weights by severity.

    Severities that a scheme doesn't list weigh `default` of it (its weight of 2, as an unknown concept has severity 2). Every answered refusal counts as
    wrong: pass the union of predictions and refusals, with `wrong` true for the latter.
    """
    def weight(scheme):
        out = None
        for s, w in scheme.items():
            out = F.when(severity == s, float(w)) if out is None else out.when(severity == s, float(w))
        return out.otherwise(float(scheme.get(2, default)))

    hit = F.coalesce(answered & wrong, F.lit(False))
    sums = df.groupBy(*by).agg(F.count(F.when(answered, 1)).alias("n_answered"), *[F.sum(F.when(hit, weight(s)).otherwise(0.0)).alias(f"w_{name}") for name, s in schemes.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("scheme"), F.coalesce(F.try_divide(f"w_{name}", "n_answered"), F.lit(0.0)).alias("risk")) for name in schemes]))
    return sums.select(*by, "n_answered", each.alias("s")).select(*by, "s.scheme", "n_answered", F.round("s.risk", 6).alias("risk"))


def clean_pairs(df: DataFrame, item: str, arm: str, clean: str, arms: tuple[str, str]) -> DataFrame:
    """One row over the items that have both arms, an arm being clean if all its rows are: items, those clean in one arm only, and the exact McNemar p."""
    each = df.where(F.col(arm).isin(*arms)).groupBy(item).agg(*[F.bool_and(F.when(F.col(arm) == a, F.col(clean))).alias(f"c{i}") for i, a in enumerate(arms)]).where("c0 IS NOT NULL AND c1 IS NOT NULL")
    n = lambda c: F.count(F.when(F.expr(c), 1))
    told = each.agg(F.count("*").alias("n_items"), n("c0 AND NOT c1").alias("only_first"), n("c1 AND NOT c0").alias("only_second"))
    return told.withColumn("p", mcnemar(F.col("only_first"), F.col("only_second")))
