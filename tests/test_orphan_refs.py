import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators.orphan_refs import canonical_id, key_parts, key_runs, orphan_references

T0 = datetime(2024, 1, 1)
REFS = "field string, item_id string, passage_id string, created_at timestamp, extra string"
PARENTS = "passage_id string, ingested_at timestamp, deleted_at timestamp, item_id string, field string"


def canon(x):
    x = x.strip(" \t\n\r").upper()
    return re.sub(r"[_\-\s]+", "_", x)


def brute(refs, parents):
    out = set()
    for f, i, p, at, _ in refs:
        if p is None or not p.strip(" \t\n\r"):
            continue
        k = canon(p)
        rows = [(b, d) for q, b, d, *_ in parents if q is not None and (canon(q) == k or re.fullmatch(re.escape(k) + r"_CHUNK_[0-9]+", canon(q)))]
        born = [r for r in rows if r[0] is not None and at is not None and r[0] <= at]
        if any(d is None or d > at for _, d in born):
            continue
        out.add((f, i, p, "missing" if not rows else "deleted" if born else "late"))
    return out


def found(spark, refs, parents):
    r = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), "passage_id", "created_at", "passage_id", "ingested_at", "deleted_at")
    return {(x.field, x.item_id, x.passage_id, x.reason) for x in r.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(7)
    ids = [f"ACT_{a}_SEC_{n}" for a in (1, 2) for n in (1, 2, 3, 7, 4095, 4096, 4097, 123456789012345678901)] + ["X_007", "X_7", "NOTE", "A_SEC_4A"]
    names = ids + [i + f"_CHUNK_{c}" for i in ids for c in (0, 1, 12)]

    def odd(x):
        return rnd.choice([x, x.lower(), f" {x}\t", x.replace("_", "-"), x.replace("_", " _ ")])

    parents = [(odd(rnd.choice(names)), T0 + timedelta(hours=rnd.randrange(100)) if rnd.random() < 0.95 else None, rnd.choice([None, T0 + timedelta(hours=rnd.randrange(120))]), "i", "f") for _ in range(60)]
    parents += [("HOT_1", T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 1), "i", "f") for m in range(0, 400, 2)] + [(None, T0, None, "i", "f"), ("  ", T0, None, "i", "f")]
    refs = [("a", f"i{k}", odd(rnd.choice(names)), T0 + timedelta(hours=rnd.randrange(120)) if rnd.random() < 0.95 else None, "x") for k in range(300)]
    refs += [("b", f"h{m}", "hot-1", T0 + timedelta(minutes=m), "x") for m in range(400)] + [("a", "n", None, T0, "x"), ("a", "e", " \n", T0, "x")] * 2
    assert found(spark, refs, parents) == brute(refs, parents)


def test_empty_tables(spark):
    one = [("a", "i", "P_1", T0, "x")]
    assert found(spark, [], []) == set()
    assert found(spark, one, []) == {("a", "i", "P_1", "missing")}
    assert found(spark, [], [("P_1", T0, None, "i", "f")]) == set()


def test_repeated_rows_and_ties(spark):
    parents = [("P_1", T0, T0, "i", "f"), ("P_1", T0, T0, "i", "f"), ("P_2", T0, T0 + timedelta(1), "i", "f")]
    refs = [("a", "i", p, T0, "x") for p in ("P_1", "P_1", "P_2")]
    assert found(spark, refs, parents) == {("a", "i", "P_1", "deleted")}


def test_runs_are_contiguous(spark):
    d = spark.createDataFrame([("s", n) for n in (1, 2, 3, 5, 6, 9, 9)], "stem string, n bigint")
    assert sorted((r.run_start, r.run_end) for r in key_runs(d).collect()) == [(1, 3), (5, 6), (9, 9)]


def test_key_parts_rebuild_the_id(spark):
    ids = ["A_1", "A_01", "A_0", "A_00", "A", "A_10", "1234567890123456789012", "B_1000000000000000000"]
    s, n = key_parts(F.col("k"))
    for r in spark.createDataFrame([(i,) for i in ids], "k string").select("k", s.alias("s"), n.alias("n")).collect():
        assert r.k == r.s + ("" if r.n == -1 else str(r.n))


def test_canonical_id(spark):
    d = spark.createDataFrame([(" act--1 _ 2\n",), ("  ",), (None,)], "k string").select(canonical_id(F.col("k")).alias("c"))
    assert [r.c for r in d.collect()] == ["ACT_1_2", None, None]
