import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import evidence as E
from corpusloom.operators import retrieval as R

META = "metadata struct<section_number:string,article_number:string,chapter:string,chunk_index:int,is_repealed:boolean,enactment_date:string,content_type:string,compares:array<string>>"
PASSAGE = f"corpus_pos bigint, passage_id string, text string, title string, parent_id string, act_name string, {META}"


def meta(sec=None, art=None, repealed=False, date=None):
    return (sec, art, None, None, repealed, date, None, None)


def passages(spark):
    rows = [
        (0, "ACT_1_SEC_1", "theft of a boat shall be an offence under Section 2", "One", "ACT_1", "Boats Act", meta("1")),
        (1, "ACT_1_SEC_2", "Section 1 applies. No person shall not pay", "Two", "ACT_1", "Boats Act", meta("2", date="2010-01-01")),
        (2, "ACT__1978_SEC_9", "9. The Republic shall protect the sea", "Nine", None, "", meta(None, "9")),
        (3, "ACT_1", "boats", "Boats title", None, "Boats Act", meta()),
        (4, "OLD_1", "theft", "Old", None, None, meta("1", repealed=True)),
        (5, "NULL_1", None, None, None, None, meta()),
    ]
    return spark.createDataFrame(rows, PASSAGE)


def bm25(docs, query, k1=1.5, b=0.75):
    toks = [[w.strip(".,;:!?'\"").lower() for w in (d or "").split()] for d in docs]
    toks = [[w for w in t if w] for t in toks]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    q = [w.strip(".,;:!?'\"").lower() for w in query.split()]
    return [sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in q) for t in toks]


def test_bm25_blocks_equal_brute_force(spark):
    p = passages(spark)
    texts = [r.text for r in p.orderBy("corpus_pos").collect()]
    qs = [("a", "theft theft boat"), ("b", "the sea"), ("c", "zzz"), ("d", "")]
    q = spark.createDataFrame(qs, "query_id string, query string")
    for block in (4096, 1):
        got = {}
        for r in R.bm25_topk(p, q, 3, block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.corpus_pos))
        for name, text in qs:
            s = [round(x, 6) for x in bm25(texts, text)]
            want = sorted(range(6), key=lambda i: (-s[i], i))[:3]
            assert [i for _, i in sorted(got[name])] == want


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<float>")
    q = d.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for r in R.vector_topk(d, q, 4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("h")).collect():
        s = np.round(u @ u[r.query_id], 6)
        assert [x.vec_id for x in r.h] == sorted(range(40), key=lambda i: (-s[i], i))[:4]


def test_exact_matches_and_expansions(spark):
    p = passages(spark)
    q = spark.createDataFrame([("a", "Article 9"), ("s", "Section 1 of something"), ("n", "boats")], "query_id string, query string")
    e = {(r.query_id, r.corpus_pos, r.score) for r in R.exact_matches(q, p).collect()}
    assert e == {("a", 2, 1000.0), ("s", 0, 950.0), ("s", 4, 950.0)}
    b = R.boosted(q, p, R.bm25_topk(p, q, 100), 20)
    assert b.filter("query_id = 'a' AND rank = 1").first().corpus_pos == 2
    hits = R.bm25_topk(p, q, 3).join(p, "corpus_pos")
    c = {r.corpus_pos: r.parent_context_added for r in R.with_parent_title(hits, p).filter("query_id = 's'").collect()}
    assert c.get(0) is True
    assert {r.corpus_pos for r in R.temporal_filter(p, 2005).collect()} == {0, 2, 3, 5}
    x = R.cross_references(hits.filter("corpus_pos = 0").withColumn("rank", F.lit(1)), p)
    assert {r.corpus_pos for r in x.collect()} <= {1}


def test_fusion_rules(spark):
    a = spark.createDataFrame([("q", 1, "p1", 5.0, False), ("q", 2, "p2", 5.0, False)], "query_id string, corpus_pos bigint, passage_id string, score double, exact_match boolean")
    b = spark.createDataFrame([("q", 2, "p2", 0.9), ("q", 3, "p3", 0.1)], "query_id string, corpus_pos bigint, passage_id string, score double")
    f = {r.passage_id: (r.bm25_score, r.dense_score, r.score) for r in R.fuse(a, b).collect()}
    assert f == {"p1": (1.0, 0.0, 0.5), "p2": (1.0, 1.0, 1.0), "p3": (0.0, 0.0, 0.0)}
    d = spark.createDataFrame([(-2.0, "what is it", "restrictions except provided that"), (-2.0, "why", "restrictions except")], "l double, q string, t string")
    assert [r.y for r in d.select(R.intent_adjusted(F.col("l"), F.col("q"), F.col("t")).alias("y")).collect()] == [-1.4, -2.0]


def test_evidence(spark):
    p = passages(spark)
    h = p.withColumn("query_id", F.lit("q")).withColumn("score", F.lit(1.0)).withColumn("rank", (F.col("corpus_pos") + 1).cast("int"))
    assert E.confidence_filter(h, 0.5).count() == 6
    roles = E.primary_and_supporting(E.confidence_filter(h)).collect()
    assert sorted((r.place, r.role) for r in roles)[0] == (1, "primary")
    assert {r.section for r in roles if r.passage_id == "ACT__1978_SEC_9"} == {"9"}
    assert E.rules(p).filter("corpus_pos = 1").count() == 0
    claims = spark.createDataFrame([("q", 0, "The theft of a boat"), ("q", 1, "Nothing similar here")], "query_id string, no int, claim string")
    assert {(r.no, r.supported) for r in E.claim_support(claims, h).collect()} == {(0, True), (1, False)}
    cited = spark.createDataFrame([("q", 0, "Boats Act", "2"), ("q", 1, "Boats Act", "77"), ("q", 2, "Other", "1")], "query_id string, no int, act_name string, section string")
    assert {(r.no, r.is_valid) for r in E.citation_validity(cited, h).collect()} == {(0, True), (1, True), (2, False)}
    assert {(r.no, r.is_valid) for r in E.citation_validity(cited, h, strict=True).collect()} == {(0, True), (1, False), (2, False)}


def test_denials_and_document_facts(spark):
    h = passages(spark).withColumn("query_id", F.lit("q")).withColumn("rank", (F.col("corpus_pos") + 1).cast("int"))
    rows = [("q", 0, "The Act does not state that theft of a boat"), ("q", 1, "The Act does not provide for whales"), ("q", 2, "There is no definition"), ("q", 3, "theft of a boat"), ("z", 4, "anything at all")]
    got = {r.no: (r.method, r.supported) for r in E.verified_claims(spark.createDataFrame(rows, "query_id string, no int, claim string"), h).collect()}
    assert got == {0: ("denial", False), 1: ("denial", True), 2: ("denial_overlap", False), 3: ("overlap", True), 4: ("none", False)}
    facts = spark.createDataFrame([("q", 0, "Article 9 is in the Constitution"), ("q", 1, "Article 8 is in the Tax Code"), ("q", 2, "plain")], "query_id string, no int, claim string")
    assert sorted((r.no, r.passage_id) for r in E.document_facts(facts, h).collect()) == [(0, "ACT__1978_SEC_9"), (1, "OLD_1")]
