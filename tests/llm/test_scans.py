import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import scans
from corpusloom.llm.scans import Lexicon, distance, furniture, repair_scans, repair_text, running

TEXT = "the licensing authority shall within thirty days of the notice certify the original instrument and may for that purpose require the owner to attend an inspector-general twenty-one regulation "


@pytest.fixture(scope="module")
def lexicon():
    words = TEXT.split()
    pairs = {f"{a} {b}": 40 for a, b in zip(words, words[1:])}
    return Lexicon({w: 50 for w in words}, pairs, {"Revised Statutes of Somewhere": 9})


def kinds(text, lexicon):
    return repair_text(text, lexicon)


def test_hyphens(lexicon):
    assert kinds("the licens-\ning authority", lexicon) == ("the licensing authority", {"hyphenation"})
    assert kinds("an inspector-\ngeneral shall", lexicon) == ("an inspector-general shall", set())
    assert kinds("Plan D-\n171 of", lexicon)[1] == set()
    assert kinds("the origi¬ \nnal notice", lexicon) == ("the original notice", {"hyphenation"})


@pytest.mark.parametrize("bad", ["instrurnent", "instrum^ent", "instrumen†", "ínstrument", "instrumcnt", "1nstrument"])
def test_characters(lexicon, bad):
    assert kinds(f"the original {bad} and may", lexicon) == ("the original instrument and may", {"characters"})


def test_words_that_are_no_noise(lexicon):
    for t in ("the original K8349A and may", "within 15(3)(a) of the notice", "Zanzibar shall attend", "_____ · === 1470"):
        assert kinds(t, lexicon)[1] == set()


def test_furniture(lexicon):
    for line, want in (("Page 12", {"page_number"}), ("- 7 -", {"page_number"}), ("lxxxviii", {"page_number"}), ("[p. 4]", {"page_number"}), ("43", {"page_number"}), ("CAP. 12] HARBOUR WATERS ACT", {"header"}), ("Harbour Waters Act — continued", {"header"}), ("H A R B O U R  A C T", {"header"}), ("Revised Statutes of Somewhere", {"header"}), ("Revised Statiites of Somewhere", {"header"}), ("17  HARBOUR DUES ACT", {"page_number", "header"}), ("FIRST SCHEDULE", set()), ("The owner shall attend.", set()), ("Article 12", set())):
        assert furniture(line, False, lexicon) == want, line
    assert furniture("1470", True, lexicon) == set()
    assert kinds("FIRST SCHEDULE\n1. the notice\n1470\n2. the instrument\n80", lexicon)[1] == set()


def test_page_breaks_do_not_split_words_or_paragraphs(lexicon):
    t = "the licensing authority shall within thirty days of the no-\nPage 3\nHarbour Waters Act — continued\n\ntice certify the original instrument.\n(1) the owner shall attend"
    fixed, found = kinds(t, lexicon)
    assert fixed == "the licensing authority shall within thirty days of the notice certify the original instrument.\n\n(1) the owner shall attend"
    assert found == {"hyphenation", "page_number", "header"}


def test_distance(lexicon):
    assert distance("modern", "modern") == 0
    assert distance("summons", "siimmons") == pytest.approx(0.3)
    assert distance("owner", "other") > 1


def test_operator(spark):
    rows = [("section", f"s{i}", TEXT * 3, 0, "x") for i in range(3)] + [("section", "n", "the licens-\ning authority shall", 0, "x")] * 2 + [("section", "null", None, 0, "x"), ("article", "e", "", None, "x")]
    d = spark.createDataFrame(rows, "record_type string, record_id string, text string, heading int, noise string")
    got = {r.record_id: r.noise for r in repair_scans(d).collect()}
    assert got == {"s0": [], "s1": [], "s2": [], "n": ["hyphenation"]}
    assert repair_scans(d.limit(0)).count() == 0


@pytest.mark.parametrize("line,want", [("[12]", {"page_number"}), ("— 12 —", {"page_number"}), ("pg. 12", {"page_number"}), ("12 / 40", {"page_number"}), ("Seite 12", {"page_number"}), ("HARBOUR ACT 1978 page 3", {"page_number", "header"}), ("p e n a l c o d e", {"header"}), ("(12)", set()), ("12. the notice", set())])
def test_page_marks(lexicon, line, want):
    assert furniture(line, False, lexicon) == want


_PIECES = st.sampled_from("the owner shall ACT LAW Harbour Waters of and 12 — continued - Page [p. 3] *** CAP. 9] p e n a l c Revised Statutes Somewhere ( ) ~ xii notice original".split())


@settings(max_examples=400, deadline=None)
@given(st.lists(_PIECES, min_size=1, max_size=14).map(" ".join))
def test_the_quick_test_for_running_text_drops_nothing(line):
    known = Lexicon({}, {}, {"Revised Statutes of Somewhere": 9, "Harbour Waters": 9})
    if running(line):
        full, scans.running = scans.running, lambda _: False
        try:
            assert furniture(line, False, known) == set(), line
        finally:
            scans.running = full


def test_groups_decide_as_the_whole_corpus_in_memory(spark, sf):
    """Distributed decisions in many small groups give what counts of the whole corpus held in memory give."""
    from corpusloom.llm.queries import _law

    texts = _law(spark, sf, "full_text").filter("text <> ''").distinct()
    rows = [(r.record_type, r.record_id, r.text) for r in texts.collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"pid": [0] * len(rows), "key": list(range(len(rows))), "text": [t for _, _, t in rows]})
    counts = [{}, {}, {}]
    for b in scans._count(iter([batch])):
        for kind, what, n in zip(*(b.column(c).to_pylist() for c in ("kind", "what", "n"))):
            if kind < 3:
                counts[kind][what] = counts[kind].get(what, 0) + n
    known = Lexicon(*counts)
    want = {(t, i, *repair_text(x, known)[:1], tuple(sorted(repair_text(x, known)[1]))) for t, i, x in rows}
    got = {(r.record_type, r.record_id, r.repaired, tuple(r.noise)) for r in repair_scans(texts.selectExpr("*", "0 AS heading"), 20_000).collect()}
    assert got == want
