from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.splitting import boundary_of, split_oversized, split_text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\t;é", max_size=400), st.sampled_from([(40, 8), (25, 5), (60, 0)]))
def test_pieces_cover_the_text(text, sizes):
    limit, overlap = sizes
    spans = split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:]))


def test_boundaries():
    assert boundary_of("a" * 9 + "\n \n" + "b" * 9, 10) == "paragraph"
    assert boundary_of("a" * 9 + "\n" + "b" * 9, 10) == "line"
    assert boundary_of("aaaa bb. " + "b" * 9, 10) == "sentence"
    assert boundary_of("aaaa bbb " + "b" * 9, 10) == "word"
    assert boundary_of("a" * 11, 10) == "none"


def test_cuts_fall_on_paragraphs():
    text = "\n\n".join(["word " * 150] * 6)
    assert all(text[:b].endswith("\n") or b == len(text) for _, b in split_text(text))


def test_operator(spark):
    rows = [("section", "a", "x" * 1600, "p"), ("section", "a", "x" * 1600, "q"), ("section", "b", None, "p"), ("article", "c", "", "p"), (None, None, "y " * 900, "p"), ("section", "d", "x" * 1500, "p")]
    d = spark.createDataFrame(rows, "record_type string, record_id string, text string, piece string")
    got = split_oversized(d).collect()
    assert {(r.record_id, r.boundary) for r in got} == {("a", "none"), (None, "word")}
    assert sorted(r.piece_no for r in got if r.record_id == "a") == [0, 1]
    assert split_oversized(d.limit(0)).count() == 0
