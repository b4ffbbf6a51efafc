import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm.packing import fill_containers, pack, token_counts


def test_limits_hold_in_every_dimension():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 100, 500)
    q = rng.integers(0, t + 1)
    box = pack(t, q, 100, 5, 60)
    assert (box >= 0).all()
    for b in range(box.max() + 1):
        m = box == b
        assert t[m].sum() <= 100 and m.sum() <= 5 and (q[m].sum() <= 60 or m.sum() == 1)


def test_little_is_wasted():
    rng = np.random.default_rng(2)
    t = rng.integers(1, 2048, 4000)
    box = pack(t, t, 2048, 512, 2048)
    assert t.sum() / ((box.max() + 1) * 2048) > 0.97


def test_result_does_not_depend_on_ties():
    t = np.array([5, 5, 5, 3, 3])
    assert pack(t, t, 8, 9, 8).tolist() == [0, 1, 2, 0, 1]


def test_operator(spark):
    rows = [(1, 5000), (2, 100), (3, 0), (4, None), (5, 2048), (2, 100), (6, 40)]
    d = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("tokens", F.lit("clash")).withColumn("container", F.lit(1))
    got = fill_containers(d, 7).collect()
    assert sorted((r.doc_id, r.piece_no, r.tokens) for r in got) == [(1, 0, 2048), (1, 1, 2048), (1, 2, 904), (2, 0, 100), (5, 0, 2048), (6, 0, 40)]
    room = {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.tokens
    assert max(room.values()) <= 2048 and len(room) == 4
    assert fill_containers(d.limit(0), 0).count() == 0
    many = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("n_tokens"))
    out = fill_containers(many, 300, shard=50).groupBy("container").agg(F.sum("tokens").alias("t")).collect()
    assert sum(r.t for r in out) == sum(i % 50 + 1 for i in range(300))


def test_counts(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(d, "doc_id", "text").collect()} == {1: 2, 2: 0, 3: 0}
