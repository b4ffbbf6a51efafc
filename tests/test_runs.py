import os

import pytest

import __spark_entry__ as entry

ANSWERS = {"exp_01": "The quick answer cites nothing at all here.", "exp_02": "The act decides this point clearly [Evidence Ordinance, Section 5]. Zebras juggle violet teapots nightly.", "exp_03": None}


@pytest.fixture(scope="module")
def runs(spark, sf, tmp_path_factory):
    """The smallest tables, where one item has answers of three runs, one of them null and one repeated."""
    d = tmp_path_factory.mktemp("runs")
    for name in os.listdir(sf):
        if name != "annotation_sheet.parquet":
            os.symlink(f"{sf}/{name}", d / name)
    item = spark.read.parquet(f"{sf}/annotation_sheet.parquet").agg({"item_id": "min"}).first()[0]
    rows = [(r, item, a, False, 0.9) for r, a in ANSWERS.items()]
    spark.createDataFrame(rows + rows[1:2], "run_id string, item_id string, rag_answer string, rag_abstained boolean, rag_attribution_f1 double").write.parquet(str(d / "annotation_sheet.parquet"))
    return str(d), item


def test_claims_and_citations_of_every_run(spark, runs):
    d, item = runs
    f = {(r.run_id, r.query_id): r.n_claims for r in entry.queries()["faithfulness"](spark, d).collect()}
    assert f == {("exp_01", item): 1, ("exp_02", item): 2}
    c = {(r.run_id, r.query_id): r.n_citations for r in entry.queries()["citation_validity"](spark, d).collect()}
    assert c == {("exp_02", item): 1}


def test_verdicts_of_every_run(spark, runs):
    d, item = runs
    v = [(r.run_id, r.query_id) for r in entry.queries()["answer_verdicts"](spark, d).collect()]
    assert sorted(v) == [("exp_01", item), ("exp_02", item)]


@pytest.fixture(scope="module")
def flags(spark, sf, tmp_path_factory):
    """One item that has gold, well answered by the first run, badly by the second, refused by the third."""
    d = tmp_path_factory.mktemp("flags")
    for name in os.listdir(sf):
        if name != "annotation_sheet.parquet":
            os.symlink(f"{sf}/{name}", d / name)
    item, kind = spark.read.parquet(f"{sf}/qac_items.parquet").filter("size(relevant_passages) > 0 AND question IS NOT NULL").selectExpr("item_id", "query_type").orderBy("item_id").first()
    rows = [("exp_01", item, False, 0.9), ("exp_02", item, False, 0.0), ("exp_03", item, True, 0.0)]
    spark.createDataFrame(rows + rows[1:2], "run_id string, item_id string, rag_abstained boolean, rag_attribution_f1 double").write.parquet(str(d / "annotation_sheet.parquet"))
    return str(d), item, kind


def test_failures_of_every_run(spark, flags):
    d, item, kind = flags
    rows = entry.queries()["failure_modes"](spark, d).collect()
    own = {r.run_id: r for r in rows if r.query_id == item}
    assert len(rows) == len({r.query_id for r in rows}) + 2 and set(own) == {"exp_01", "exp_02", "exp_03"}
    assert {r for r in own if "faithfulness_failure" in own[r].modes} == {"exp_02"} and own["exp_02"].severity == "critical"
    assert {r for r in own if "wrong_abstention" in own[r].modes} == {"exp_03"}
    c = {(r.query_type, r.mode): r.n for r in entry.queries()["failure_crosstab"](spark, d).collect()}
    assert c[(kind, "faithfulness_failure")] == 1 and c[(kind, "wrong_abstention")] == 1
