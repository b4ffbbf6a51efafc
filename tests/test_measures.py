import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import measures as M


def test_retrieval_known_answers(spark):
    hits = spark.createDataFrame([("q", f"p{i}", i) for i in range(1, 6)], "query_id string, key string, rank int")
    gold = spark.createDataFrame([("q", k) for k in ("p1", "p3", "p5", "p6")] + [("z", "p9"), ("q", "p1")], "query_id string, key string")
    r = {x.query_id: x for x in M.retrieval_scores(hits, gold, (3, 5)).collect()}
    assert (r["q"].recall_5, r["q"].mrr) == (0.75, 1.0)
    assert r["q"].precision_3 == pytest.approx(2 / 3, abs=1e-6)
    assert (r["z"].recall_5, r["z"].mrr, r["z"].ndcg_5) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("ranks", "n", "k", "value"), [([1], 1, 10, 1.0), ([2], 1, 10, 0.3937), ([10], 1, 10, 0.3937), ([], 1, 10, 0.4544), ([], 2, 10, 0.5572), ([], 3, 10, 0.6397), ([], 1, 5, 0.5897), ([], 1, 20, 0.3520)])
def test_tie_averaged_ndcg(spark, ranks, n, k, value):
    d = spark.createDataFrame([(ranks, n)], "r array<int>, n int").select(M.tie_averaged_ndcg(F.col("r"), F.col("n"), k).alias("v"))
    assert d.first().v == pytest.approx(value, abs=1e-4)


def test_kappas(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (None, 1)], "a int, b int")
    r = M.kappas(d, [1, 2, 3]).first()
    assert r.n_pairs == 4
    assert r.kappa == pytest.approx((0.75 - 0.3125) / (1 - 0.3125), abs=1e-6)
    same = M.kappas(spark.createDataFrame([(2, 2)] * 3, "a int, b int"), [1, 2, 3]).first()
    assert (same.kappa, same.kappa_quadratic) == (1.0, None)
    k = spark.createDataFrame([(0.205,), (math.nan,), (None,)], "k double").select(M.landis_koch(F.col("k")).alias("b")).collect()
    assert [x.b for x in k] == ["fair", None, None]


def test_percentiles_are_elements(spark):
    d = spark.createDataFrame([("g", float(i)) for i in range(20)] + [("g", None)], "g string, v double")
    r = M.percentile_ranks(d, "v", ["g"], [0.5, 0.95]).first()
    assert (r.n, r.p50, r.p95) == (20, 10.0, 19.0)
    e = spark.createDataFrame([(list(range(20)),)], "v array<int>").select(M.index_percentile(F.col("v"), 0.95).alias("x")).first()
    assert e.x == 19


def test_wilcoxon_and_confusion(spark):
    d = spark.createDataFrame([("d", 5.0, 4.0), ("d", 3.0, 4.0), ("d", 5.0, 2.0), ("d", 1.0, 1.0)], "g string, a double, b double")
    r = M.wilcoxon(d, "a", "b", ["g"]).first()
    assert (r.n, r.w_plus, r.w_minus, r.statistic) == (3, 4.5, 1.5, 1.5)
    c = M.confusion(spark.createDataFrame([(True, True)] * 3 + [(False, False)], "p boolean, t boolean"), F.col("p"), F.col("t")).first()
    assert (c.tp, c.tn, c.f1) == (3, 1, 1.0)


def test_threshold_sweep(spark):
    d = spark.createDataFrame([(0.2, False), (0.29, True), (0.9, True), (None, True)], "s double, l boolean")
    best = M.threshold_sweep(d, "s", "l").orderBy(F.desc("f1"), "threshold").first()
    assert (best.threshold, best.f1) == (0.21, 1.0)
