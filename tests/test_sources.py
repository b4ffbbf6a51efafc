import json

from pyspark.sql import functions as F

from corpusloom.operators import mentions as N
from corpusloom.operators import retrieval as R
from corpusloom.operators import segment as G
from corpusloom.sources import files as S
from corpusloom.streaming import audit as A


def test_manifest_and_questions(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"acts": [{"pdf_path": "a.pdf", "name": "A", "year": 1999}, {"file_path": "b.pdf", "act_name": "B", "act_number": "7", "act_year": "x"}]}))
    assert [tuple(r) for r in S.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a.pdf", "A", None, 1999, None), ("b.pdf", "B", "7", None, None)]
    (tmp_path / "q.json").write_text(json.dumps({"version": "1", "items": [{"item_id": "Q1", "relevant_passages": ["p"], "gold_answers": []}, {"item_id": "Q2"}]}))
    assert [(r.item_id, r.relevant_passages) for r in S.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("Q1", ["p"]), ("Q2", None)]


def test_corpus_round_trip(spark, tmp_path):
    rows = [(i, f"p{i}", "word " * (20 if i else 1), "t", "section", None, {"section_number": str(i)}, "Act", "1", 2000) for i in range(3)]
    d = spark.createDataFrame(rows, "corpus_pos bigint, passage_id string, text string, title string, level string, parent_id string, metadata map<string,string>, act_name string, act_number string, act_year int")
    S.write_corpus(d, str(tmp_path / "c"))
    assert sorted((r.passage_id, r.act_year) for r in S.read_corpus(spark, str(tmp_path / "c")).collect()) == [("p1", 2000), ("p2", 2000)]


def test_ratings_and_panel(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Item ID,Correctness,Completeness,Clarity\nQ1,4,6,x\n")
    assert {(r.dimension, r.rating) for r in S.read_ratings(spark, str(tmp_path / "r.csv")).collect()} == {("correctness", 4), ("completeness", None), ("clarity", None)}
    head, row = ",".join(["h"] * 36), lambda i, v: ",".join([i, *["d"] * 10, *[v, "5", "4", "c", "2024"] * 5])
    (tmp_path / "p.csv").write_text("﻿" + "\n".join([head, head, row("..Q1", "3"), row("Q1", "1"), row("Q2", "n")]))
    got = {(r.item_id, r.rater, r.rating) for r in S.read_panel(spark, str(tmp_path / "p.csv")).filter("dimension = 'correctness'").collect()}
    assert ("Q1", "rater_5", 3.0) in got and ("Q2", "rater_1", None) in got and len(got) == 10


def test_index_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, "a b b"), (1, "b c"), (2, None)], "corpus_pos bigint, text string")
    S.write_index(R.postings(p), str(tmp_path / "i"), 8)
    assert sorted((r.term, r.corpus_pos, r.tf) for r in S.read_index(spark, str(tmp_path / "i"), ["b"], 8).collect()) == [("b", 0, 2), ("b", 1, 1)]


def test_audit_stream_equals_batch(spark, tmp_path):
    lines = [{"entry_id": f"e{i}", "timestamp": f"2024-01-01T00:0{i % 3}:00", "user_id": "u", "retrieval_method": "bm25", "abstained": i % 2 == 0} for i in range(9)] + [{"entry_id": "x", "type": "error", "timestamp": "2024-01-01T00:00:00", "retrieval_method": "bm25"}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]) + "\n")
    batch = S.read_audit(spark, str(tmp_path / "log"))
    assert batch.count() == 10
    for name, f, mode in (("totals", A.audit_totals, "complete"), ("rates", lambda d: A.rate_limited(d, limit=2), "complete")):
        q = f(A.audit_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(batch).collect()))


def test_segmentation(spark):
    text = "PART I - General\n1. Short title\nThis Act may be cited.\n\n2. Rules\nBody of it\n(1) first point here\n(2) second point here\n"
    rows = G.segment_acts(spark.createDataFrame([("ACT_1", "T", text), ("ACT_2", "N", None)], "act_id string, title string, text string")).collect()
    assert {r.section_id for r in rows} == {"ACT_1", "ACT_1_PART_I", "ACT_1_SEC_1", "ACT_1_SEC_2", "ACT_1_SEC_2_SUBSEC_1", "ACT_1_SEC_2_SUBSEC_2", "ACT_2"}
    long = spark.createDataFrame([("S", "section", "t", "A sentence here. " * 20, "A", "1", 0), ("T", "section", "t", "short", "A", "2", 1)], G.SECTIONS)
    p = G.passages_of(long, 100)
    assert p.count() == 3 and p.filter("passage_id = 'T'").count() == 0
    c = spark.createDataFrame([("e", "CHAPTER I THE PEOPLE 1. Alpha is here and long enough.\n2. Beta text. CHAPTER II THE STATE 3. Gamma text")], "edition string, text string")
    assert [(r.article_number, r.chapter) for r in G.segment_articles(c).orderBy("place").collect()] == [("1", "Chapter I: THE PEOPLE"), ("2", "Chapter I: THE PEOPLE"), ("3", "Chapter II: THE STATE")]


def test_mentions(spark):
    t = "amended by Act No. 3 of 1999. Subject to section 4(1), see section 5; as defined in section 6. amended by Act No. 3 of 1999"
    got = [(r.kind, r.target) for r in N.mentions(spark.createDataFrame([("k", t), ("n", None), ("e", "")], "k string, text string"), "k").orderBy("no").collect()]
    assert got == [("amendment", "3 of 1999"), ("condition", "4(1)"), ("see_also", "5"), ("definition", "6")]
    d = spark.createDataFrame([("A fine applies. Prison.", ), (None,)], "t string").select(N.penalties(F.col("t")).alias("p"), N.conditions(F.col("t")).alias("c"))
    assert d.first().p == ["A fine applies"]
