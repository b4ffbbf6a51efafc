"""Retrieval, attribution, abstention and agreement measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def retrieval_scores(hits: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per query with gold: recall, precision, standard NDCG at each k, and the reciprocal rank.

    hits: query_id, key, rank (ranks from 1, keys distinct per query); gold: query_id, key. Queries without hits score 0.
    """
    g = gold.select("query_id", "key").distinct()
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    h = hits.join(g, ["query_id", "key"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in ks]
    )
    j = n.join(h, "query_id", "left").fillna(0, [x for k in ks for x in (f"h{k}", f"d{k}")])
    cols = [F.col("query_id"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        best, hit = _discount(k, F.lit(0), F.least(F.col("n_gold"), F.lit(k))), F.col(f"h{k}")
        cols += [F.round(hit / F.col("n_gold"), 6).alias(f"recall_{k}"), F.round(hit / k, 6).alias(f"precision_{k}"), F.round(F.col(f"d{k}") / best, 6).alias(f"ndcg_{k}")]
    return j.select(*cols, "n_gold", *[f"h{k}" for k in ks])


def _discount(k: int, low: Column, high: Column) -> Column:
    """Sum of 1 / log2(i + 1) over the ranks i with low < i <= high, at most k."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda a, i: a + F.when((i > low) & (i <= high), 1 / F.log2(i + 1.0)).otherwise(0.0))


def tie_averaged_ndcg(hit_ranks: Column, n_gold: Column, k: int) -> Column:
    """Tie-averaged NDCG with ideal gains as truth and retrieved gains as scores.

    hit_ranks: array of the ranks at most k that hit; the truth has its ``min(n_gold, k)`` ones first. Ranks that hit form the upper
    group of ties, all others the lower; within a group each place gets the group's mean gain.
    """
    ones = F.least(n_gold, F.lit(k))
    m = F.size(hit_ranks)
    upper_gain = F.aggregate(hit_ranks, F.lit(0), lambda a, r: a + F.when(r <= ones, 1).otherwise(0))
    upper = F.when(m == 0, 0.0).otherwise(upper_gain / m * _discount(k, F.lit(0), m))
    lower = F.when(m == k, 0.0).otherwise((ones - upper_gain) / (F.lit(k) - m) * _discount(k, m, F.lit(k)))
    return (upper + lower) / _discount(k, F.lit(0), ones)


def summarize(scores: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each measure."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_pop(c), 6)))])


def confusion(rows: DataFrame, predicted: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    c = rows.groupBy(*by).agg(*[F.count_if(x).alias(n) for n, x in (("tp", predicted & truth), ("fp", predicted & ~truth), ("fn", ~predicted & truth), ("tn", ~predicted & ~truth))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*by, "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def kappas(pairs: DataFrame, labels: Sequence[int], by: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa, its linearly and quadratically weighted forms, agreement and number of pairs, from one confusion table.

    Pairs with a null are left out. An expected agreement of 1 gives kappa 1; weighted forms are null where nothing
    could disagree. Only the small confusion table is kept after the first aggregation.
    """
    k = len(labels)
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)).cast("int")
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, place(a).alias("i"), place(b).alias("j")).groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    total = F.sum("n").over(w)
    cells = cells.select(*by, "i", "j", "n", total.alias("t"))
    rows = cells.groupBy(*by, F.col("i").alias("ri")).agg(F.sum("n").alias("rn"))
    cols = cells.groupBy(*by, F.col("j").alias("cj")).agg(F.sum("n").alias("cn"), F.max("t").alias("t"))
    observed = cells.groupBy(*by).agg(F.max("t").alias("n_pairs"), (F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)) / F.max("t")).alias("po"), *[(F.sum(F.col("n") * _weight(F.col("i"), F.col("j"), k, s)) / F.max("t")).alias(f"o_{s}") for s in ("linear", "quadratic")])
    # k x k cells per group: marginals of at most k labels each
    if by:
        both = rows.join(cols, list(by))
    else:
        both = rows.withColumn("one", F.lit(1)).join(cols.withColumn("one", F.lit(1)), "one")
    share = F.col("rn") * F.col("cn") / (F.col("t") * F.col("t"))
    expected = both.groupBy(*by).agg(F.sum(F.when(F.col("ri") == F.col("cj"), share).otherwise(0.0)).alias("pe"), *[F.sum(share * _weight(F.col("ri"), F.col("cj"), k, s)).alias(f"e_{s}") for s in ("linear", "quadratic")])
    j = observed.join(expected, list(by)) if by else observed.withColumn("one", F.lit(1)).join(expected.withColumn("one", F.lit(1)), "one")
    kappa = F.when(F.abs(1 - F.col("pe")) < 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return j.select(*by, "n_pairs", F.round("po", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"), *[F.round(F.when(F.col(f"e_{s}") != 0, 1 - F.col(f"o_{s}") / F.col(f"e_{s}")), 6).alias(f"kappa_{s}") for s in ("linear", "quadratic")])


def _weight(i: Column, j: Column, k: int, kind: str) -> Column:
    d = F.abs(i - j) / float(max(1, k - 1))
    return d if kind == "linear" else d * d


def landis_koch(kappa: Column) -> Column:
    """The band of a kappa without gaps; null for null and NaN."""
    k = F.when(F.isnan(kappa), F.lit(None)).otherwise(kappa)
    out = F.when(k.isNull(), F.lit(None).cast("string")).when(k < 0, "poor")
    for top, name in ((0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial")):
        out = out.when(k <= top, name)
    return out.otherwise("almost perfect")


def index_percentile(sorted_values: Column, p: float) -> Column:
    """Element int(n * p) of a sorted array, without interpolation."""
    return F.element_at(sorted_values, F.least(F.floor(F.size(sorted_values) * p).cast("int") + 1, F.size(sorted_values)))


#: Ranges into which the values of a group are counted first.
RANGES = 4096


def percentile_ranks(rows: DataFrame, value: str, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Per group the elements at int(n * p) of the ordered values, without interpolation; nulls are left out.

    Values are counted first: a group's distinct values fall into ``RANGES`` ranges, and only those of the ranges that hold a wanted
    rank are put in order, so no group is sorted or collected as a whole.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    own = lambda df: df.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in df.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    g = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    place = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("lo")) / span * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")
    placed = counts.join(own(g.drop("mean")), same).select(*by, "v", "c", "n", place.alias("r"))
    # at most RANGES rows per group
    sizes = placed.groupBy(*by, "r").agg(F.sum("c").alias("size"), F.max("n").alias("n"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*by).orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("before", before).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    at = F.floor(F.col("n") * F.col("p"))
    wanted = wanted.filter((at >= F.col("before")) & (at < F.col("before") + F.col("size"))).select(*by, "r", "before", "p", at.alias("at"))
    within = placed.join(own(wanted).withColumnRenamed("r", "__r"), same & (F.col("r") == F.col("__r"))).select(*by, "p", "before", "at", "v", "c")
    upto = F.col("before") + F.sum("c").over(W.partitionBy(*by, "p").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    found = within.withColumn("upto", upto).filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == float(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares])
    return g.join(own(wide), same).select(*by, "n", "mean", *[f"p{round(p * 100)}" for p in shares])


def normal_tail(z: Column) -> Column:
    """Two-sided probability of a standard normal beyond ``z``: a rational approximation with an error below 1.5e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def wilcoxon(pairs: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Signed-rank sums over non-zero differences with averaged ties: (n, w_plus, w_minus, statistic, z)."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*by, (F.col(a) - F.col(b)).alias("d"))
    # one row per size of difference: ranks of ties follow from counts, whatever their number
    sizes = d.groupBy(*by, F.round(F.abs("d"), 9).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    t = s.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    stat, n = F.least("w_plus", "w_minus"), F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return t.select(*by, "n", "w_plus", "w_minus", stat.alias("statistic"), F.round(F.when(sd > 0, (stat - n * (n + 1) / 4) / sd), 6).alias("z"))


def threshold_sweep(rows: DataFrame, score: str, label: str, steps: int = 100) -> DataFrame:
    """Confusion and F1 of ``score >= t`` for t = 0, 1 / steps, ..., 1: scores are counted by step first, then cumulated."""
    by_step = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.least(F.greatest(F.floor(F.round(F.col(score) * steps, 6)), F.lit(-1)), F.lit(steps)).cast("int").alias("step")).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    grid = rows.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    w = W.partitionBy(F.lit(1))  # steps + 2 rows
    up = w.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    g = grid.join(by_step, "step", "left").fillna(0, ["pos", "neg"]).withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "p": F.sum("pos").over(w), "q": F.sum("neg").over(w)}).filter("step >= 0")
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    return g.select((F.col("step") / steps).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"), F.round(f1(pr, rc), 6).alias("f1"))
