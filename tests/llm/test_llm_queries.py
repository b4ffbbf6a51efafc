import pytest

from corpusloom.llm.queries import QUERIES

COLUMNS = {
    "p2_found": "run_id item_id answer_field defect", "p3_found": "record_type record_id boundary", "p4_found": "record_type record_id answer_no citation_no",
    "p5_found": "record_type record_id noise", "p6_ids": "doc_id ids", "p7_containers": "container doc_id piece_no tokens", "p8_found": "doc_id band",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert rows.columns == COLUMNS[name].split()
    assert (rows.count() > 0) == (name != "p7_violations")
    if name.endswith("_found"):
        assert rows.count() == rows.distinct().count()
