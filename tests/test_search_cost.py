import random

import pytest

from corpusloom.operators import retrieval as R
from tests.test_retrieval import bm25, passages

WORDS = ["the", "of", "act", "section", "boat", "theft", "sea", "toll", "market", "lamp", "7", "12"]


@pytest.mark.parametrize("chunk, common", [(7, 1 / 16), (16, 2.0), (1 << 14, 0.5)])
def test_slices_and_lists_equal_brute_force(spark, monkeypatch, chunk, common):
    """Common and rare terms, slices smaller than k and larger, repeated texts as ties, ids in no order."""
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(R, "COMMON", common)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, [9, 8, 6, 5, 2, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 9))) for _ in range(120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    asked = [(f"q{i}", " ".join(rng.choices([*WORDS, "unknown"], k=4))) for i in range(15)] + [("same1", "boat toll"), ("same2", "Toll, boat"), ("none", None)]
    got = {}
    for r in R.bm25_topk(spark.createDataFrame(rows, "corpus_pos bigint, text string"), spark.createDataFrame(asked, "query_id string, query string"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.corpus_pos, r.score))
    for name, text in asked:
        s = [round(x, 6) for x in bm25(texts, text or "")]
        want = sorted(range(120), key=lambda i: (-s[i], i))[:10]
        assert sorted((k, i) for k, i, _ in got[name]) == list(enumerate(want, 1))
        assert all(abs(x - s[i]) < 2e-6 for _, i, x in got[name])


def test_same_terms_are_scored_once(spark, monkeypatch):
    blocks = []
    monkeypatch.setattr(R, "materialize", lambda df: blocks.append(df) or df)
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["theft boat", "Boat theft", "theft, boat."])], "query_id string, query string")
    hits = R.bm25_topk(passages(spark), q, 2, block=1).collect()
    assert not blocks and len(hits) == 6 and len({(r.corpus_pos, r.score) for r in hits}) == 2


def test_first_exact_matches(spark):
    """The first of each query are the same as without a limit, whichever number or passage comes twice."""
    meta = (None, None, None, None, False, None, None, None)
    p = passages(spark)
    more = [(10 + i, f"P_{i // 2}", None, None, None, "Boats Act", ("1", "3" if i % 3 else "4", *meta[2:])) for i in range(30)]
    p = p.unionByName(spark.createDataFrame(more, p.schema))
    q = spark.createDataFrame([("s", "Section 1"), ("t", "section 1 again"), ("c", "Article 4 and Article 3 in Section 1"), ("e", "Section 1 of the Evidence Ordinance"), ("a", "Article 9")], "query_id string, query string")
    every, few = (sorted(map(tuple, R.exact_matches(q, p, *m).collect())) for m in ((), (4,)))
    assert few == [r for r in every if r[4] <= 4] and 8 < len(few) < len(every)
