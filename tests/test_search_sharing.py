from corpusloom.plans import comparison_queries as C
from corpusloom.plans import record_queries as D
from corpusloom.plans import retrieval_queries as V


def test_significance_computes_its_two_methods_only(spark, sf, monkeypatch):
    """Vectors feed the fused search once; neither the dense nor the reranked hits are ranked beside it."""
    kept = []
    keep = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: kept.append(df) or keep(df))
    got = C.method_significance(spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(kept) == 1 and "final_score" not in plan
    s = C._method_scores(spark, sf).filter("method IN ('bm25', 'hybrid')").collect()
    two = {m: {r.query_id.split("|")[1]: round(r.mrr, 6) for r in s if r.method == m} for m in ("bm25", "hybrid")}
    assert got.first().n == sum(two["bm25"][q] != two["hybrid"][q] for q in two["bm25"])


def test_confidence_searches_once(spark, sf, monkeypatch):
    calls = []
    search = V.R.bm25_topk
    monkeypatch.setattr(V.R, "bm25_topk", lambda *a, **k: calls.append(a) or search(*a, **k))
    assert D.simple_confidence(spark, sf).count() == V._queries(spark, sf).count() and len(calls) == 1
