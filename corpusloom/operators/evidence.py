"""Evidence gating, rule extraction, conflicts, claim support and citation checks over ranked passages.

``hits`` are rows of (query_id, corpus_pos, passage_id, text, act_name, metadata, score, rank), at most k per query; pairs are
formed within the first few hits of a query only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import CONTAINMENT_STOP, base_id, containment, content_words, has_any, jaccard, valid_section

# Contradictory wordings, and keywords of rules in the order they are looked for.
CONTRADICTIONS = [("shall", "shall not"), ("prohibited", "allowed"), ("forbidden", "permitted"), ("must not", "must"), ("cannot", "can"), ("may not", "may")]
RULE_CONTRADICTIONS = [("shall", "shall not"), ("must", "must not"), ("entitled", "not entitled"), ("liable", "not liable")]
CONDITIONS = ["if", "where", "when", "unless", "provided that", "subject to"]
CONSEQUENCES = ["shall", "may", "must", "will", "is entitled to"]
EXCEPTIONS = ["except", "but", "excluding", "other than"]


def confidence_filter(hits: DataFrame, least: float = 0.3) -> DataFrame:
    """Hits whose score, scaled within their query, reaches ``least``; all of them, unscaled, where scores do not differ."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    n = F.when(hi - lo >= 1e-6, (F.col("score") - lo) / (hi - lo))
    return hits.withColumn("normalized_score", n).filter(F.col("normalized_score").isNull() | (F.col("normalized_score") >= least))


def section_label(hits: DataFrame) -> DataFrame:
    """Adds section and is_article: a valid number of the metadata, else the id's, else the first numbered opening in the text."""
    art, sec = (F.when(valid_section(F.col(f"metadata.{c}")), F.col(f"metadata.{c}")) for c in ("article_number", "section_number"))
    from_id = F.nullif(F.regexp_extract("passage_id", "^ACT__\\d+_SEC_([0-9]+[A-Z]?)", 1), F.lit(""))
    from_text = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), "(?<!\\d)(\\d{1,3}[A-Z]?)\\.\\s+[A-Z][a-z]", 1), F.lit(""))
    none = art.isNull() & sec.isNull()
    article = F.coalesce(art, F.when(none, F.coalesce(from_id, from_text)))
    return hits.withColumn("section", F.coalesce(article, sec)).withColumn("is_article", article.isNotNull())


def primary_and_supporting(hits: DataFrame, most: int = 9) -> DataFrame:
    """The best hit of each query as 'primary' and up to ``most`` others with another passage_id as 'supporting', with place."""
    value = F.coalesce("normalized_score", "score")
    w = W.partitionBy("query_id").orderBy(F.desc(value), "rank")
    h = hits.withColumn("place", F.row_number().over(w)).withColumn("primary_id", F.first("passage_id").over(w))
    rest = h.filter((F.col("place") == 1) | (F.col("passage_id") != F.col("primary_id")))
    rest = rest.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most + 1)
    return section_label(rest).withColumn("role", F.when(F.col("place") == 1, "primary").otherwise("supporting"))


def by_act(hits: DataFrame) -> DataFrame:
    """(query_id, act_name, n, passages): passages of each act in their rank order; acts without a name count as 'Unknown'."""
    g = hits.groupBy("query_id", F.coalesce("act_name", F.lit("Unknown")).alias("act_name"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"]).alias("passages"))


def _opposed(a: Column, b: Column, pairs: list[tuple[str, str]], both_ways: bool = True) -> Column:
    out = F.lit(False)
    for p, q in pairs:
        out = out | (a.contains(p) & b.contains(q))
        if both_ways:
            out = out | (a.contains(q) & b.contains(p))
    return out


def conflict_pairs(hits: DataFrame, top: int = 3, overlap: float = 0.10) -> DataFrame:
    """Pairs among the first ``top`` hits of a query on the same section of the same act, from different articles, with little
    overlap and contradictory wording. Substrings count, so 'shall' is found within 'shall not'."""
    sec = F.coalesce(F.nullif(F.col("metadata.section_number"), F.lit("")), F.nullif(F.col("metadata.article_number"), F.lit("")))
    h = hits.filter(F.col("rank") <= top).select("query_id", "rank", "passage_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("act_name", F.lit("")).alias("act"), sec.alias("sec")).filter("sec IS NOT NULL")
    b = h.select("query_id", "act", "sec", F.col("rank").alias("rank2"), F.col("passage_id").alias("passage_id2"), F.col("t").alias("t2"))
    p = h.join(b, ["query_id", "act", "sec"]).filter((F.col("rank") < F.col("rank2")) & (base_id(F.col("passage_id")) != base_id(F.col("passage_id2"))))
    j = jaccard(F.col("t"), F.col("t2"))
    return p.withColumn("overlap", j).filter((j < overlap) & _opposed(F.col("t"), F.col("t2"), CONTRADICTIONS))


def sufficiency(hits: DataFrame, queries: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(query_id, n, gate): the first gate that fails or 'sufficient'. Gates: 'no_passages', 'relevance' (no exact match and the
    best logit below -0.5), 'confidence' (no score of 0.5), 'coverage' (several sections asked, one passage), 'conflict'.

    queries: query_id, query_type, n_sections; hits with exact_match, rerank_score, normalized_score.
    """
    a = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("exact_match").alias("exact"), F.max("rerank_score").alias("best"), F.max(F.coalesce("normalized_score", "score")).alias("top"))
    j = queries.join(a, "query_id", "left").join(conflicts.select("query_id").distinct().withColumn("opposed", F.lit(True)), "query_id", "left")
    gate = (
        F.when(F.col("n").isNull(), "no_passages")
        .when(~F.col("exact") & (F.col("best") < -0.5), "relevance")
        .when(F.col("top") < 0.5, "confidence")
        .when((F.col("query_type") == "cross_referenced") & (F.col("n_sections") > 1) & (F.col("n") < 2), "coverage")
        .when(F.col("opposed"), "conflict")
        .otherwise("sufficient")
    )
    return j.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), gate.alias("gate"))


def _clause(text: Column, words: list[str], size: int, default: Column) -> Column:
    """From the first keyword of the list that occurs: ``size`` characters, up to the first full stop."""
    out = default
    for w in reversed(words):
        at = F.locate(w, F.lower(text))
        out = F.when(at > 0, F.trim(F.substring_index(F.substring(text, at, F.lit(size)), ".", 1))).otherwise(out)
    return out


def rules(passages: DataFrame) -> DataFrame:
    """Passages that have a condition and a consequence, with both clauses and the exceptions; keywords are substrings."""
    t = F.col("text")
    low = F.lower(t)
    exceptions = F.filter(F.array(*[F.when(low.contains(w), _clause(t, [w], 150, F.lit(""))) for w in EXCEPTIONS]), lambda x: x.isNotNull())
    return passages.filter(has_any(low, CONDITIONS) & has_any(low, CONSEQUENCES)).withColumns({"condition": _clause(t, CONDITIONS, 200, F.lit("General applicability")), "consequence": _clause(t, CONSEQUENCES, 200, F.substring(t, 1, 200)), "exceptions": exceptions})


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))


def applicable(rule_hits: DataFrame, facts: Column, least: int = 3) -> DataFrame:
    """Rules that share more than ``least`` words with the facts, with relevance as the share of their own words and place."""
    own = _words(F.concat_ws(" ", "condition", "consequence"))
    n = F.size(F.array_intersect(own, _words(facts)))
    r = rule_hits.withColumn("n_shared", n).filter(F.col("n_shared") > least).withColumn("relevance", F.col("n_shared") / F.size(own))
    return r.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")))


def rule_conflicts(found: DataFrame) -> DataFrame:
    """Pairs of applicable rules of a query on the same section of the same act, from different articles, where the earlier states a
    duty and the later its negation; only in this direction."""
    r = found.select("query_id", "place", "passage_id", "act_name", F.col("metadata.section_number").alias("sec"), F.lower("consequence").alias("c")).filter("act_name <> '' AND sec <> ''")
    s = r.select("query_id", "act_name", "sec", F.col("place").alias("place2"), F.col("passage_id").alias("passage_id2"), F.col("c").alias("c2"))
    p = r.join(s, ["query_id", "act_name", "sec"]).filter((F.col("place") < F.col("place2")) & (base_id(F.col("passage_id")) != base_id(F.col("passage_id2"))))
    return p.filter(_opposed(F.col("c"), F.col("c2"), RULE_CONTRADICTIONS, both_ways=False))


def claim_support(claims: DataFrame, hits: DataFrame, nli: str | None = None, nli_least: float = 0.3, overlap_least: float = 0.4) -> DataFrame:
    """Per claim (query_id, no, claim and any further key, as a run): best containment in a hit of its query, the hit, and whether it is supported.

    ``nli`` names a column of ``hits`` with entailment probabilities; containment counts only for hits below ``nli_least``.
    """
    # words are split once per claim and once per hit, not for every pair
    words = lambda c: content_words(F.coalesce(c, F.lit("")), CONTAINMENT_STOP)
    h = hits.select("query_id", "rank", "passage_id", words(F.col("text")).alias("y"), (F.col(nli) if nli else F.lit(0.0)).alias("p"))
    j = claims.withColumn("x", words(F.col("claim"))).join(h, "query_id", "left")
    share = F.when((F.size("x") == 0) | F.col("y").isNull(), 0.0).otherwise(F.size(F.array_intersect("x", "y")) / F.size("x"))
    j = j.withColumn("o", F.when(F.coalesce("p", F.lit(0.0)) < nli_least, share).otherwise(0.0))
    best = j.groupBy(*claims.columns).agg(F.max("o").alias("overlap"), F.max("p").alias("nli"), F.min_by("passage_id", F.struct((-F.col("o")).alias("o"), F.col("rank").alias("r"))).alias("passage_id"))
    return best.withColumn("supported", (F.coalesce("nli", F.lit(0.0)) >= nli_least) | (F.col("overlap") >= overlap_least))


# What denies that something is said.
DENIALS = ["does\\s+not\\s+(?:explicitly\\s+)?(?:declare|state|say|provide|define|establish)", "not\\s+(?:explicitly\\s+)?(?:declared|stated|said|provided|defined|established)", "no\\s+(?:explicit\\s+)?(?:declaration|statement|definition)"]


def denied_part(claim: Column) -> Column:
    """What a claim denies: the words behind the first denial that has any; '' for a denial of nothing named; null for other claims."""
    low = F.lower(claim)
    rests = [F.when(low.rlike(p), F.trim(F.regexp_extract(low, f"(?s){p}(.*)$", 1))) for p in DENIALS]
    rest = F.coalesce(*[F.nullif(r, F.lit("")) for r in rests], *rests)
    return F.regexp_replace(rest, "^(?:as|that|which)\\s+", "")


def verified_claims(claims: DataFrame, hits: DataFrame, overlap_least: float = 0.4) -> DataFrame:
    """(query_id, no, claim, method, overlap, supported). A denial holds if no hit contains what it denies ('denial'), or, if it
    names nothing, at an overlap of 0.3 ('denial_overlap'); all other claims at ``overlap_least`` ('overlap'). Without hits nothing holds ('none')."""
    h = hits.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.lit(True).alias("hit"))
    j = claims.withColumn("denied", denied_part(F.col("claim"))).join(h, "query_id", "left")
    says = (F.col("denied") != "") & F.col("t").contains(F.col("denied"))
    g = j.groupBy("query_id", "no", "claim", "denied").agg(F.count("hit").alias("n"), F.max(containment(F.col("claim"), F.coalesce("t", F.lit("")))).alias("overlap"), F.bool_or(F.coalesce(says, F.lit(False))).alias("said"))
    method = F.when(F.col("n") == 0, "none").when(F.col("denied").isNull(), "overlap").when(F.col("denied") == "", "denial_overlap").otherwise("denial")
    held = F.when(method == "none", False).when(method == "denial", ~F.col("said")).when(method == "denial_overlap", F.col("overlap") >= 0.3).otherwise(F.col("overlap") >= overlap_least)
    return g.select("query_id", "no", "claim", method.alias("method"), "overlap", held.alias("supported"))


def document_facts(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, no, passage_id): claims that place an article in a document ('Article 9 is in the Evidence Act'), with the first
    hit of that document and article. A hit without an article number fits every article, one without an act every document."""
    num = "(\\d+[a-z]?(?:\\([0-9]+\\))?(?:\\([a-z]\\))?)"
    inside, holds = f"article\\s+{num}\\s+is\\s+(?:in|contained\\s+in)\\s+([^,.]+)", f"([^,.]+)\\s+contains\\s+article\\s+{num}"
    low = F.lower("claim")
    c = claims.withColumn("art", F.when(low.rlike(inside), F.regexp_extract(low, inside, 1)).otherwise(F.regexp_extract(low, holds, 2))).withColumn("doc", F.trim(F.when(low.rlike(inside), F.regexp_extract(low, inside, 2)).otherwise(F.regexp_extract(low, holds, 1)))).filter("art <> '' AND doc <> ''")
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[()]", "")
    h = hits.select("query_id", "rank", "passage_id", bare(F.col("metadata.article_number")).alias("has"), F.lower(F.coalesce("act_name", F.lit(""))).alias("act"))
    j = c.join(h, "query_id")
    number = F.col("has").contains(bare(F.col("art"))) | bare(F.col("art")).contains(F.col("has"))
    same = F.when(F.col("doc").contains("constitution"), (F.col("act") == "") | F.col("act").contains("constitution")).otherwise(F.col("act").contains(F.col("doc")) | F.col("doc").contains(F.col("act")))
    return j.filter(number & same).groupBy("query_id", "no").agg(F.min_by("passage_id", "rank").alias("passage_id"))


def citation_validity(cited: DataFrame, hits: DataFrame, strict: bool = False) -> DataFrame:
    """Per citation (query_id, no, act_name, section and any further key, as a run): whether a hit of that act exists and the hit that fits best.

    Acts match if one name contains the other; a hit without an act is the constitution. A hit whose text mentions the
    section comes first; without one any hit of the act is accepted, unless ``strict``.
    """
    h = hits.select("query_id", "rank", "passage_id", F.lower(F.coalesce("act_name", F.lit(""))).alias("act"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    c, s = F.lower("act_name"), F.lower("section")
    j = cited.join(h, "query_id", "left")
    act_ok = F.when(F.col("act") == "", c.contains("constitution")).otherwise(F.col("act").contains(c) | c.contains(F.col("act")))
    says = F.lit(False)
    for form in ("article ", "section ", "chapter ", "article", "section"):
        says = says | F.col("t").contains(F.concat(F.lit(form), s))
    says = says | F.col("t").contains(F.concat(s, F.lit(".")))
    fits = act_ok & says if strict else act_ok
    j = j.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("says", F.coalesce(says, F.lit(False)))
    order = F.struct((~F.col("says")).alias("a"), F.col("rank").alias("b"))
    return j.groupBy(*cited.columns).agg(F.bool_or("fits").alias("is_valid"), F.min_by(F.when(F.col("fits"), F.col("passage_id")), F.when(F.col("fits"), order)).alias("passage_id"))
