import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm.language import language_of
from corpusloom.llm.pairs import broken_pairs, defect_of, lcs, tokens_of

Q = "Is a permit required for storage of goods under the Harbour Act?"


@pytest.mark.parametrize(("answer", "defect"), [
    (None, "empty"), (" ​", "empty"), ("N/A", "empty"), ("[no answer]", "empty"), ("Error: upstream_timeout", "empty"), ("...", "empty"),
    (Q, "copy"), (Q.upper(), "copy"), (f"You asked: {Q}", "copy"), (f"{Q} {Q}", "copy"), (f'"{Q}"', "copy"),
    ("I cannot answer this question based on the material available to me.", "refusal"), ("Unfortunately, no answer can be given with any confidence.", "refusal"), ("Diese Frage kann ich nicht beantworten.", "refusal"),
    ("Der Antrag ist nicht zulässig, wenn die Gebühr nicht bezahlt wurde.", "other_language"), ("உரிமம் பெற்றவர் உறுப்பினர் பதிவேட்டை வெளியிட வேண்டும்.", "other_language"),
    ("Yes", None), ("Within sixty days", None), ("I cannot confirm the exact date, but the permit shall be issued within thirty days.", None), ("The Registrar cannot refuse an application without giving reasons.", None),
    (f"{Q} The permit is required for any goods that are kept for more than three days in a store.", None), ("Error is no excuse for the owner of the goods, who shall pay the fee in full.", None),
])
def test_defects(answer, defect):
    assert defect_of(Q, answer) == defect


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert lcs(a, b) == t[-1][-1]


def test_language():
    assert [language_of(t) for t in ("the law of the land is clear", "Nul ne peut exploiter un étal sans l'accord du service", "zzz qqq", None)] == ["en", "fr", None, None]
    assert tokens_of("It's  “Fine”, no?") == ["it's", "fine", "no"]


def test_operator(spark):
    rows = [("a", "s", Q, None), ("b", "s", None, "Fine."), ("c", "s", Q, Q), ("c", "s", Q, Q), ("d", "s", Q, "The permit is required for storage, and the owner shall apply for it in writing.")]
    d = spark.createDataFrame(rows, "key string, source string, question string, answer string").selectExpr("*", "'x' AS defect", "1 AS text")
    assert {(r.key, r.defect) for r in broken_pairs(d).collect()} == {("a", "empty"), ("c", "copy")}
    assert broken_pairs(d.limit(0)).count() == 0


@pytest.mark.parametrize("question,answer,want", [
    ("Is a permit required for storage of goods under the Harbour Act?", "Yes, a permit is required for storage of goods under the Harbour Act.", None),
    ("How is a summons answered?", "It is not possible to answer that summons by post; the owner must attend in person.", None),
    ("Is a void contract enforceable?", "Void", None),
    ("What happens if one does not pay?", "Failed to pay: fine of Rs. 500.", None),
    ("What is the fee?", "Void", "empty"),
    ("What is the fee?", "Failed to connect to upstream", "empty"),
    ("What is the fee?", "Error: model_offline " + "x " * 300, "empty"),
    ("Who decides disputes?", "My guidelines prevent me from commenting on legal disputes.", "refusal"),
    ("Who decides disputes?", "Sorry, but I'd prefer not to discuss that matter.", "refusal"),
    ("What is the fee?", "I cannot answer this question based on the sources. " + "They concern the duties of owners and the powers of the board in other matters of the act. " * 4, "refusal"),
    ("What is the fee?", "I cannot answer this question with certainty, but under section 5 of the Act the fee shall be 500 rupees for each boat.", None),
    ("Is a permit required for the storage of goods?", "Lupa vaaditaan tavaroiden säilyttämiseen satamassa ennen käyttöä", "other_language"),
    ("Is a permit required for the storage of goods?", "Zezwolenie jest wymagane przed składowaniem towarów według właściwych przepisów", "other_language"),
])
def test_ordinary_cases(question, answer, want):
    assert defect_of(question, answer) == want
