import re

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import spans as S


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    assert one(spark, T.clean_text, " a\n\n b\té ") == "a b "
    assert one(spark, T.normalize_whitespace, None) is None
    assert one(spark, T.tokens, " Hello, 'World'!  -- x.y ") == ["hello", "world", "--", "x.y"]
    assert one(spark, T.tokens, None) == []


def test_references(spark):
    assert one(spark, T.section_number, "see Sec. 12A(1)(b) of it") == "12A(1)(b)"
    assert one(spark, T.section_number, "nothing") is None
    assert one(spark, T.act_reference, "Penal Code (Act No. 2 of 1883)").asDict() == {"name": "Penal Code", "number": "2", "year": "1883"}
    assert str(one(spark, T.parse_date, "03/04/1999")) == "1999-04-03"
    assert one(spark, T.parse_date, "1999-13-40") is None
    assert one(spark, T.years, "in 1999 and 2001") == ["1999", "2001"]
    assert one(spark, lambda c: T.years(c, True), "in 1999 and 2001") == ["19", "20"]
    for i, a in (("ACT__1978_SEC_13", "ACT__1978_SEC_13"), ("ACT__1978_SEC_13_CHUNK_0", "ACT__1978_SEC_13"), ("ACT__1978_SEC_41A_SUBSEC_1_CHUNK_0", "ACT__1978_SEC_41A"), ("ACT__1978_SEC_79_SUBSEC_3", "ACT__1978_SEC_79")):
        assert one(spark, T.article_id, i) == a


def test_query_functions(spark):
    assert one(spark, T.expand_abbreviations, "Sec. 3 no. 4 of the ACT") == "section 3 number 4 of the Act"
    assert one(spark, T.query_type, "How is a form filed?") == "procedural"
    assert one(spark, T.query_type, "Section 1 or Section 2") == "cross_referenced"
    assert one(spark, T.act_filter, "What does Article 14 say?") == ""
    assert one(spark, T.act_filter, "section 300 of the penal code") == "Penal Code"
    assert one(spark, T.act_filter, "Article 3 in section 4") is None
    assert one(spark, T.classify_query, "zzz")["name"] == "general"
    assert one(spark, T.identify_domain, "a theft and a contract")["name"] == "criminal"


def test_quality_and_edit_accuracy(spark):
    assert one(spark, T.scan_quality, "x" * 99) == 0.0
    assert one(spark, T.scan_quality, "plain words " * 20) == 1.0
    d = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "a")], "a string, b string").select(T.edit_accuracy(F.col("a"), F.col("b")).alias("y"))
    assert [r.y for r in d.collect()] == [0.75, 1.0, 0.0]


def greedy(text, limit, sep=0):
    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if cur and n + len(s) > limit:
            out.append(" ".join(cur))
            cur, n = [s], len(s)
        else:
            cur.append(s)
            n += len(s) + sep
    return [*out, " ".join(cur)]


def overlapping(text, limit, overlap):
    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if cur and n + len(s) > limit:
            out.append(" ".join(cur))
            kept, size = [], 0
            for x in reversed(cur):
                if size + len(x) > overlap:
                    break
                kept.insert(0, x)
                size += len(x)
            cur, n = kept, size
        cur.append(s)
        n += len(s)
    return [*out, " ".join(cur)]


def test_chunks_against_folds(spark):
    texts = ["One two. Three four five! Six? Seven eight nine ten.", "x" * 70, "", "A. B. C. D. E.", "a.  b!\nc? " * 20]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for limit, overlap in ((10, 4), (25, 12), (60, 20)):
        got = rows.select("x", S.greedy_chunks(F.col("x"), limit).alias("a"), S.greedy_chunks(F.col("x"), limit, True).alias("b"), S.overlapping_chunks(F.col("x"), limit, overlap).alias("c")).collect()
        for r in got:
            assert r.a == greedy(r.x, limit)
            assert r.b == greedy(r.x, limit, 1)
            assert r.c == overlapping(r.x, limit, overlap)
    assert one(spark, lambda c: S.greedy_chunks(c, 10), None) is None


def test_clauses_claims_citations(spark):
    assert one(spark, lambda c: S.clause_chunks(c, 30), "Intro text.\n(1) first clause is here\n(2) second") == ["Intro text.", "(1) first clause is here", "(2) second"]
    assert one(spark, S.claims, "The rule holds [A, Section 1]. Short. This is not legal advice at all.") == ["The rule holds"]
    got = one(spark, S.citations, "x [Evidence Act, Section 3(1)(a)] y [Act, Article 4] [none]")
    assert [(g.act_name, g.section) for g in got] == [("Evidence Act", "3(1)(a)"), ("Act", "4")]
    f = one(spark, S.citation_format, "[A, Section 1] [see above]")
    assert (f.total, f.well_formed) == (2, 1)
    assert one(spark, S.citation_density, "") == 0.0
