import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.operators import measures as M
from corpusloom.operators import records as R
from corpusloom.settings import Settings
from corpusloom.sources import files
from corpusloom.streaming.audit import audit_sink, audit_stream


def test_dispatch():
    assert R.dispatch("hybrid", True) == "hybrid"
    assert R.dispatch("hybrid_rerank", False) == "bm25"
    with pytest.raises(ValueError):
        R.dispatch("magic", True)


def test_settings():
    assert Settings.load({}).k1 == 1.5
    assert Settings.load({"CORPUSLOOM_TOP_K": "7", "CORPUSLOOM_ALPHA": "0.25"}) == Settings(top_k=7, alpha=0.25)


def test_filters(spark):
    d = spark.createDataFrame([("QAC_001", "criminal", "factual"), ("QAC_075", "civil", "factual"), ("QAC_076", None, None), (None, "civil", None)], "item_id string, legal_domain string, query_type string")
    ids = lambda x: sorted(r.item_id or "" for r in x.collect())
    assert ids(R.filter_items(d, ids="QAC_001-QAC_075")) == ["QAC_001", "QAC_075"]
    assert ids(R.filter_items(d, ids=["QAC_076"])) == ["QAC_076"]
    assert ids(R.filter_items(d, domain="civil", query_type="factual")) == ["QAC_075"]
    assert R.filter_items(d.limit(0), domain="civil").count() == 0


def test_expansion_by_a_table(spark):
    q = spark.createDataFrame([("a", "What is the Penalty for theft?"), ("b", "Who appeals?"), ("c", None)], "query_id string, query string")
    t = spark.createDataFrame([(1, "theft", ["dishonest taking", "fine"]), (0, "penalty", ["fine", "imprisonment"])], "pos int, concept string, terms array<string>")
    got = {r.query_id: r.retrieval_query for r in R.expand_by_table(q, t).collect()}
    assert got == {"a": "What is the Penalty for theft? fine imprisonment dishonest taking", "b": "Who appeals?", "c": None}
    assert R.expand_by_table(q, t.limit(0)).count() == 3


def test_scalars(spark):
    row = spark.range(1).select(
        R.scrubbed(F.lit("a Page 3 b  c\n\n\n\nd")).alias("s"), R.entailment(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("e"), R.entailment(F.lit(900.0), F.lit(0.0), F.lit(-900.0)).alias("z"),
        R.in_scope(F.lit(1.0), F.lit(None).cast("boolean")).alias("open"), R.in_scope(F.lit(1.0), F.lit(False)).alias("shut"), R.severity_order(F.lit("odd")).alias("odd"), R.summary(F.lit("One. Two. Three.")).alias("sum"),
        R.simple_confidence(F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("boolean")).alias("c"), M.normal_tail(F.lit(1.959964)).alias("p"), R.extracted(F.lit(None).cast("string"), F.lit("x")).alias("x"),
    ).first()
    assert row.s == "a b c\n\nd" and abs(row.e - 1 / 3) < 1e-12 and row.z == 0 and row.open and not row.shut and row.odd == 5
    assert row.sum == "One.  Two." and row.c == 0.8 and abs(row.p - 0.05) < 1e-6 and row.x == "x"


def test_percentiles_against_sorting(spark):
    rows = [(g, float(v)) for g, vs in {"a": [3, 1, 2, 2, 2, 9], "b": [5] * 7, None: [1, 2]}.items() for v in vs] + [("a", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.p0, r.p50, r.p95) for r in M.percentile_ranks(d, "v", ["g"], [0.0, 0.5, 0.95]).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), v[0], v[int(len(v) * 0.5)], v[int(len(v) * 0.95)])
    assert M.percentile_ranks(d.limit(0), "v", ["g"], [0.5]).count() == 0


def test_realigned_gold_and_labels(spark):
    gold = spark.createDataFrame([("q", "x"), ("r", "y")], "query_id string, key string")
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "y", 1), ("s", "z", 1)], "query_id string, key string, rank int")
    assert sorted(map(tuple, R.realigned_gold(gold, hits).collect())) == [("q", "a", 1), ("q", "b", 2)]
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, label string")
    assert {r.k: r.unique for r in R.labelled(d, "label", ["k"]).collect()} == {1: "x", 2: "x (2)", 3: None}


def test_indices_and_sheets(spark, tmp_path):
    post = spark.createDataFrame([("tax", 1, 2)], "term string, corpus_pos bigint, tf int")
    vec = spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<float>")
    files.write_search_index(post, f"{tmp_path}/i", vec, "m")
    files.write_search_index(post, f"{tmp_path}/j")
    p, v = files.read_search_index(spark, f"{tmp_path}/i", "m")
    assert p.count() == 1 and v.columns == ["vec_id", "embedding"]
    assert files.read_search_index(spark, f"{tmp_path}/j")[1] is None
    with pytest.raises(ValueError):
        files.read_search_index(spark, f"{tmp_path}/i", "other")
    r = spark.createDataFrame([("i", "rater_1", "clarity", 4.0), ("i", "rater_5", "correctness", 2.0)], "item_id string, rater string, dimension string, rating double")
    files.write_panel(r, f"{tmp_path}/p")
    back = files.read_panel(spark, f"{tmp_path}/p", header_rows=0).filter("rating IS NOT NULL")
    assert sorted(map(tuple, back.select("item_id", "rater", "dimension", "rating").collect())) == sorted(map(tuple, r.collect()))
    assert {x.file.split(".")[-1] for x in files.list_files(spark, f"{tmp_path}/p/*.csv").collect()} == {"csv"}

    def extract(it: "pd.Series") -> "pd.Series":
        return pd.Series([bytes(x).decode() for x in it])

    (tmp_path / "t.bin").write_bytes(b"text layer")

    extract.__annotations__ = {"it": pd.Series, "return": pd.Series}
    assert files.read_documents(spark, f"{tmp_path}/t.bin", extract).first().text == "text layer"


def test_questions_and_audit(spark, tmp_path):
    q = spark.createDataFrame([("i", "What?")], "item_id string, question string")
    files.write_questions(q, f"{tmp_path}/q")
    assert files.read_written_questions(spark, f"{tmp_path}/q").first().question == "What?"
    a = spark.createDataFrame([("e1", "2024-01-01T00:00:00", "u")], "entry_id string, timestamp string, user_id string")
    files.append_audit(a, f"{tmp_path}/a")
    files.append_audit(a, f"{tmp_path}/a")
    assert files.read_audit(spark, f"{tmp_path}/a").count() == 2
    audit_sink(audit_stream(spark, f"{tmp_path}/a"), f"{tmp_path}/b", f"{tmp_path}/c").awaitTermination()
    assert spark.read.json(f"{tmp_path}/b").count() == 2


def test_command_line(spark, tmp_path):
    p = spark.createDataFrame([(1, "p1", "the harbour master grants a licence to moor a vessel in the harbour", "t", "section", None, "Act", None, 1990), (2, "p2", "an appeal lies to the tribunal within thirty days of the notice given", "t", "section", None, "Act", None, 1990)], "corpus_pos bigint, passage_id string, text string, title string, level string, parent_id string, act_name string, act_number string, act_year int")
    files.write_corpus(p.withColumn("metadata", F.create_map(F.lit("a"), F.lit("b"))), f"{tmp_path}/c")
    spark.createDataFrame([("q", "appeal to the tribunal")], "query_id string, query string").write.json(f"{tmp_path}/q")
    main(["build-index", f"{tmp_path}/c", f"{tmp_path}/i"], spark)
    assert files.read_index(spark, f"{tmp_path}/i", ["tribunal"]).count() == 1
    main(["search", f"{tmp_path}/c", f"{tmp_path}/q", f"{tmp_path}/o", "--top-k", "1"], spark)
    assert spark.read.json(f"{tmp_path}/o").count() == 1


def test_typed_and_plain_citations(spark):
    from corpusloom.operators.answers import plain_citations, typed_citations

    h = spark.createDataFrame(
        [("q", 1, "p1", "Harbour Act", "nothing here", ("5", None)), ("q", 2, "p2", "Harbour Act", "as section 7 says", (None, None)), ("q", 3, "p3", None, None, (None, "9"))],
        "query_id string, rank int, passage_id string, act_name string, text string, metadata struct<section_number string, article_number string>",
    )
    a = spark.createDataFrame(
        [("q", "See [Harbour Act, Section 7] and [Harbour Act, 5] and [Harbour Act, Section 8] and [Constitution, 9]. Also [Harbour Act, General]."), ("q", None), ("q", ""), ("other", "[Harbour Act, Section 5]")], "query_id string, answer string"
    )
    got = {(r.query_id, r.section, r.label, r.passage_id) for r in typed_citations(a, h).collect()}
    assert got == {("q", "7", "Section", "p2"), ("q", "5", "Section", "p1"), ("q", "8", "Section", "p1"), ("q", "9", "Article", "p3"), ("q", "General", "Section", "p1"), ("other", "5", "Section", None)}
    plain = {(r.query_id, r.section, r.passage_id) for r in plain_citations(spark.createDataFrame([("q", "[Harbour Act, Section 5] [harbour act, Section 7]")], "query_id string, answer string"), h).collect()}
    assert plain == {("q", "5", "p1"), ("q", "7", None)}
    assert typed_citations(a.limit(0), h).count() == 0 and plain_citations(a, h.limit(0)).count() == 3


def test_parsed_questions(spark):
    from corpusloom.functions.text import parsed_query, question_kind

    d = spark.createDataFrame([("What is  the pc  rule on acts.?",), ("Can I appeal?",), ("",), (None,)], "q string").select("q", parsed_query(F.col("q")).alias("p"), question_kind(F.col("q")).alias("k"))
    assert [(r.p, r.k) for r in d.collect()] == [("what is the penal code rule on actsection ?", "factual"), ("can i appeal?", "advisory"), ("", "general"), (None, "general")]
