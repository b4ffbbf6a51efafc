"""Queries over evidence gating, rules, claims, citations and mentions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import CONTAINMENT_STOP, JACCARD_STOP, section_references
from corpusloom.operators import evidence as E
from corpusloom.operators import mentions as N
from corpusloom.operators.spans import citations, claims
from corpusloom.plans.retrieval_queries import _BASE, _lexical, _passages, _queries
from corpusloom.plans.text_queries import _CITE, _WS
from corpusloom.operators.spans import DISCLAIMERS
from corpusloom.sources.tables import table


def _hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return _lexical(spark, d, k).join(_passages(spark, d), "corpus_pos")


def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return E.confidence_filter(_hits(spark, d), 0.3).select("query_id", "corpus_pos", F.round("normalized_score", 4).alias("normalized_score"))


def primary_evidence(spark: SparkSession, d: str) -> DataFrame:
    h = E.primary_and_supporting(E.confidence_filter(_hits(spark, d), 0.3))
    return h.select("query_id", "passage_id", "role", "place", "section", "is_article")


def evidence_by_act(spark: SparkSession, d: str) -> DataFrame:
    return E.by_act(_hits(spark, d)).select("query_id", "act_name", "n", F.array_join("passages", "|").alias("passages"))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.conflict_pairs(_hits(spark, d, 20), top=20, overlap=0.6).select("query_id", "passage_id", "passage_id2", F.round("overlap", 6).alias("overlap"))


def sufficiency_of(spark: SparkSession, d: str, lexical: DataFrame) -> DataFrame:
    """Gates over the filtered evidence, with a synthetic logit; only the first hits, which are compared, take their texts along."""
    p = _passages(spark, d)
    h = E.confidence_filter(lexical, 0.3)
    all_of = h.join(p.select("corpus_pos"), "corpus_pos").withColumn("exact_match", F.lit(False)).withColumn("rerank_score", ((F.col("corpus_pos") * 37) % 200) / 20.0 - 9.0)
    q = _queries(spark, d).select("query_id", "query_type", F.size(section_references(F.col("query"))).alias("n_sections"))
    return E.sufficiency(all_of, q, E.conflict_pairs(h.filter("rank <= 3").join(p, "corpus_pos"), top=3))


def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    return sufficiency_of(spark, d, _lexical(spark, d))


def legal_rules(spark: SparkSession, d: str) -> DataFrame:
    r = E.rules(_passages(spark, d))
    return r.select("corpus_pos", "condition", "consequence", F.array_join("exceptions", "|").alias("exceptions"))


def _applicable(spark: SparkSession, d: str, lexical: DataFrame | None = None) -> DataFrame:
    """Rules are taken from each passage once, not from every hit of it."""
    hits = (lexical or _lexical(spark, d)).join(E.rules(_passages(spark, d)), "corpus_pos")
    return E.applicable(hits.join(_queries(spark, d).select("query_id", "query"), "query_id"), F.col("query"))


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return _applicable(spark, d).select("query_id", "corpus_pos", "n_shared", F.round("relevance", 6).alias("relevance"))


def rule_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return E.rule_conflicts(_applicable(spark, d)).select("query_id", "passage_id", "passage_id2")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of all runs, repeated rows once."""
    a = table(spark, d, "annotation_sheet").filter("rag_answer IS NOT NULL")
    return a.select("run_id", F.col("item_id").alias("query_id"), F.col("rag_answer").alias("answer")).distinct()


def faithfulness_of(answers: DataFrame, hits: DataFrame) -> DataFrame:
    c = answers.select("run_id", "query_id", F.posexplode(claims(F.col("answer"))).alias("no", "claim"))
    s = E.claim_support(c, hits).groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("supported").alias("n_supported"))
    share = F.col("n_supported") / F.col("n_claims")
    return s.select("run_id", "query_id", "n_claims", "n_supported", F.round(share, 6).alias("faithfulness"), (share >= 0.8).alias("is_faithful"))


def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Per run and answered item: claims, supported claims by containment in the item's evidence, their share and whether it reaches 0.8."""
    return faithfulness_of(_answers(spark, d), _hits(spark, d))


def claim_verification(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the gold answers against the evidence of their questions, denials included."""
    g = table(spark, d, "qac_items").select(F.col("item_id").alias("query_id"), F.posexplode("gold_answers").alias("a", "g")).select("query_id", "a", F.posexplode(claims(F.col("g.answer_text"))).alias("k", "claim")).select("query_id", (F.col("a") * 1000 + F.col("k")).alias("no"), "claim").distinct()
    return E.verified_claims(g, _hits(spark, d)).select("query_id", "no", "method", F.round("overlap", 6).alias("overlap"), "supported").distinct()


def validity_of(answers: DataFrame, hits: DataFrame) -> DataFrame:
    c = answers.select("run_id", "query_id", F.posexplode(citations(F.col("answer"))).alias("no", "c")).select("run_id", "query_id", "no", "c.act_name", "c.section")
    a, b = E.citation_validity(c, hits), E.citation_validity(c, hits, strict=True).select("run_id", "query_id", "no", F.col("is_valid").alias("is_strict"))
    return a.join(b, ["run_id", "query_id", "no"]).groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("n_citations"), F.count_if("is_valid").alias("n_valid"), F.count_if("is_strict").alias("n_strict"))


def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    """Per run and answered item with citations: valid ones among the evidence, in the lenient and in the strict way."""
    return validity_of(_answers(spark, d), _hits(spark, d))


def section_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    s = table(spark, d, "legal_sections").filter("text <> ''").select("section_id", "text").distinct()
    return s.select("section_id", F.md5("text").alias("text_hash"), N.has_subsections(t).alias("has_subsections"), F.size(N.penalties(t)).alias("n_penalties"), F.md5(F.array_join(N.penalties(t), "|")).alias("penalties_hash"), N.repealed_by(t).isNotNull().alias("is_repealed"), N.definitions_section(t).alias("definitions_section"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "legal_sections").select("section_id", "text").distinct()
    return N.mentions(s, "section_id").groupBy("section_id", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (confidence_filter, primary_evidence, evidence_by_act, conflict_pairs, sufficiency, legal_rules, rule_matches, rule_conflicts, faithfulness, claim_verification, citation_validity, section_metadata, mentions)}

_HB = _BASE + """,
hp AS (SELECT h.query_id, h.corpus_pos, h.score, h.rank, p.passage_id, p.text, p.act_name, p.metadata FROM hits h JOIN pas p USING (corpus_pos)),
cf AS (SELECT * FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w >= 1e-6 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normalized_score FROM hp WINDOW w AS (PARTITION BY query_id)) WHERE normalized_score IS NULL OR normalized_score >= 0.3)
"""
_VALID = "regexp_full_match(trim({c}), '[0-9]+[A-Z]?(\\([0-9]+\\))?(\\([a-z]\\))?')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _content(c: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '{_WS}+'), lambda w: length(w) > 2 AND NOT list_contains({_list(stop)}, w)))"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _clause(words: list[str], size: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN trim(string_split(substring(text, strpos(lower(text), '{w}')::INT, {size}), '.')[1], ' ')" for w in words) + f" ELSE {default} END"


def _opposed(a: str, b: str, pairs: list[tuple[str, str]], both: bool = True) -> str:
    return "(" + " OR ".join([f"(contains({a}, '{p}') AND contains({b}, '{q}'))" for p, q in pairs] + [f"(contains({a}, '{q}') AND contains({b}, '{p}'))" for p, q in pairs if both]) + ")"


def _pairs(src: str, top: int, overlap: float) -> str:
    a, b = _content("a.t", JACCARD_STOP), _content("b.t", JACCARD_STOP)
    return f""",
    cp0 AS (SELECT query_id, rank, passage_id, lower(coalesce(text, '')) AS t, coalesce(act_name, '') AS act, coalesce(nullif(metadata.section_number, ''), nullif(metadata.article_number, '')) AS sec FROM {src} WHERE rank <= {top}),
    cp AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS overlap FROM (
      SELECT a.query_id, a.passage_id, b.passage_id AS passage_id2, a.t AS t, b.t AS t2, {a} AS x, {b} AS y FROM cp0 a JOIN cp0 b ON a.query_id = b.query_id AND a.act = b.act AND a.sec = b.sec AND a.rank < b.rank AND string_split(a.passage_id, '_CHUNK_')[1] <> string_split(b.passage_id, '_CHUNK_')[1])),
    cpx AS (SELECT * FROM cp WHERE overlap < {overlap} AND {_opposed('t', 't2', E.CONTRADICTIONS)})"""


_RULE = f"""{_any('lower(text)', E.CONDITIONS)} AND {_any('lower(text)', E.CONSEQUENCES)}"""
_COND, _CONS = _clause(E.CONDITIONS, 200, "'General applicability'"), _clause(E.CONSEQUENCES, 200, "left(text, 200)")
_RW = f"list_distinct(list_filter(string_split_regex(lower({{c}}), '{_WS}+'), lambda w: w <> ''))"
_APP = f""",
  rl AS (SELECT hp.*, {_COND} AS condition, {_CONS} AS consequence FROM hp WHERE {_RULE}),
  ap AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_shared / len(ow) DESC, rank) AS place FROM (SELECT rl.*, {_RW.format(c="condition || ' ' || consequence")} AS ow, len(list_intersect({_RW.format(c="condition || ' ' || consequence")}, {_RW.format(c='query')}))::INT AS n_shared FROM rl JOIN q USING (query_id)) WHERE n_shared > 3)"""
_ANS = ", ans AS (SELECT item_id AS query_id, arg_min(rag_answer, {'a': run_id, 'b': rag_answer}) AS answer FROM annotation_sheet WHERE rag_answer IS NOT NULL GROUP BY 1)"
_CON = f"CASE WHEN len({_content('claim', CONTAINMENT_STOP)}) = 0 THEN 0.0 ELSE len(list_intersect({_content('claim', CONTAINMENT_STOP)}, {_content("coalesce(text, '')", CONTAINMENT_STOP)})) / len({_content('claim', CONTAINMENT_STOP)}) END"
_ACT = "CASE WHEN coalesce(h.act_name, '') = '' THEN contains(lower(c.act_name), 'constitution') ELSE contains(lower(h.act_name), lower(c.act_name)) OR contains(lower(c.act_name), lower(h.act_name)) END"
_SAYS = "(" + " OR ".join(f"contains(lower(h.text), '{f}' || lower(c.section))" for f in ("article ", "section ", "chapter ", "article", "section")) + " OR contains(lower(h.text), lower(c.section) || '.'))"
SQL = {
    "confidence_filter": _HB + "SELECT query_id, corpus_pos, round(normalized_score, 4) AS normalized_score FROM cf",
    "primary_evidence": _HB + f""", p1 AS (SELECT *, row_number() OVER w AS pl, first_value(passage_id) OVER w AS pid FROM cf WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(normalized_score, score) DESC, rank)),
      p2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(normalized_score, score) DESC, rank)::INT AS place FROM p1 WHERE pl = 1 OR passage_id <> pid),
      p3 AS (SELECT *, CASE WHEN {_VALID.format(c='metadata.article_number')} THEN metadata.article_number END AS a, CASE WHEN {_VALID.format(c='metadata.section_number')} THEN metadata.section_number END AS s,
        nullif(regexp_extract(passage_id, '^ACT__\\d+_SEC_([0-9]+[A-Z]?)', 1), '') AS fi, nullif(regexp_extract(coalesce(text, ''), '(?:^|[^0-9])(\\d{{1,3}}[A-Z]?)\\.\\s+[A-Z][a-z]', 1), '') AS ft FROM p2 WHERE place <= 10)
      SELECT query_id, passage_id, CASE WHEN place = 1 THEN 'primary' ELSE 'supporting' END AS role, place, coalesce(a, CASE WHEN s IS NULL THEN coalesce(fi, ft) END, s) AS section, coalesce(a, CASE WHEN s IS NULL THEN coalesce(fi, ft) END) IS NOT NULL AS is_article FROM p3""",
    "evidence_by_act": _HB + "SELECT query_id, coalesce(act_name, 'Unknown') AS act_name, count(*) AS n, string_agg(passage_id, '|' ORDER BY rank) AS passages FROM hp GROUP BY 1, 2",
    "conflict_pairs": _HB + _pairs("hp", 20, 0.6) + " SELECT query_id, passage_id, passage_id2, round(overlap, 6) AS overlap FROM cpx",
    "sufficiency": _HB + _pairs("cf", 3, 0.10) + """, a AS (SELECT query_id, count(*) AS n, max(((corpus_pos * 37) % 200) / 20.0 - 9.0) AS best, max(coalesce(normalized_score, score)) AS top FROM cf GROUP BY 1)
      SELECT query_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_passages' WHEN best < -0.5 THEN 'relevance' WHEN top < 0.5 THEN 'confidence'
        WHEN query_type = 'cross_referenced' AND len(regexp_extract_all(query, '[Ss]ection\\s+(\\d+[A-Z]?(?:\\([a-z0-9]+\\))?)', 1)) > 1 AND n < 2 THEN 'coverage' WHEN query_id IN (SELECT query_id FROM cpx) THEN 'conflict' ELSE 'sufficient' END AS gate FROM q LEFT JOIN a USING (query_id)""",
    "legal_rules": f"SELECT corpus_pos, {_COND} AS condition, {_CONS} AS consequence, array_to_string(list_filter([{', '.join(f'''CASE WHEN contains(lower(text), '{w}') THEN {_clause([w], 150, "''")} END''' for w in E.EXCEPTIONS)}], lambda x: x IS NOT NULL), '|') AS exceptions FROM passages WHERE {_RULE}",
    "rule_matches": _HB + _APP + " SELECT query_id, corpus_pos, n_shared, round(n_shared / len(ow), 6) AS relevance FROM ap",
    "rule_conflicts": _HB + _APP + f""" SELECT a.query_id, a.passage_id, b.passage_id AS passage_id2 FROM ap a JOIN ap b ON a.query_id = b.query_id AND a.act_name = b.act_name AND a.metadata.section_number = b.metadata.section_number AND a.place < b.place
      WHERE a.act_name <> '' AND a.metadata.section_number <> '' AND string_split(a.passage_id, '_CHUNK_')[1] <> string_split(b.passage_id, '_CHUNK_')[1] AND {_opposed('lower(a.consequence)', 'lower(b.consequence)', E.RULE_CONTRADICTIONS, False)}""",
    "faithfulness": _HB + _ANS + f""", cl AS (SELECT query_id, unnest(range(len(c))) AS no, unnest(c) AS claim FROM (SELECT query_id, list_filter(list_transform(string_split_regex(regexp_replace(answer, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(DISCLAIMERS)}')) AS c FROM ans)),
      su AS (SELECT query_id, no, max({_CON}) >= 0.4 AS supported FROM cl LEFT JOIN hp USING (query_id) GROUP BY 1, 2)
      SELECT query_id, count(*) AS n_claims, count(*) FILTER (supported) AS n_supported, round(count(*) FILTER (supported) / count(*), 6) AS faithfulness, count(*) FILTER (supported) / count(*) >= 0.8 AS is_faithful FROM su GROUP BY 1""",
    "claim_verification": _HB + f""", c0 AS (SELECT item_id AS query_id, gold_answers AS g FROM qac_items), c1 AS (SELECT query_id, unnest(range(len(g))) AS a, unnest(g) AS g FROM c0),
      c2 AS (SELECT query_id, a, list_filter(list_transform(string_split_regex(regexp_replace(g.answer_text, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(DISCLAIMERS)}')) AS c FROM c1),
      c3 AS (SELECT DISTINCT query_id, (a * 1000 + k)::INT AS no, claim FROM (SELECT query_id, a, unnest(range(len(c))) AS k, unnest(c) AS claim FROM c2)),
      c4 AS (SELECT *, regexp_replace(coalesce({', '.join(f"nullif(CASE WHEN regexp_matches(lower(claim), '{p}') THEN trim(regexp_extract(lower(claim), '(?s){p}(.*)$', 1)) END, '')" for p in E.DENIALS)}, {', '.join(f"CASE WHEN regexp_matches(lower(claim), '{p}') THEN '' END" for p in E.DENIALS)}), '^(?:as|that|which)\\s+', '') AS denied FROM c3),
      c5 AS (SELECT query_id, no, claim, denied, count(h.corpus_pos) AS n, max({_CON}) AS overlap, bool_or(coalesce(denied <> '' AND contains(lower(coalesce(text, '')), denied), false)) AS said FROM c4 LEFT JOIN hp h USING (query_id) GROUP BY 1, 2, 3, 4)
      SELECT DISTINCT query_id, no, CASE WHEN n = 0 THEN 'none' WHEN denied IS NULL THEN 'overlap' WHEN denied = '' THEN 'denial_overlap' ELSE 'denial' END AS method, round(overlap, 6) AS overlap,
        CASE WHEN n = 0 THEN false WHEN denied IS NULL THEN overlap >= 0.4 WHEN denied = '' THEN overlap >= 0.3 ELSE NOT said END AS supported FROM c5""",
    "citation_validity": _HB + _ANS + f""", ci AS (SELECT query_id, no, trim(a) AS act_name, trim(s) AS section FROM (SELECT query_id, unnest(range(len(regexp_extract_all(answer, '{_CITE}', 1, 'i')))) AS no, unnest(regexp_extract_all(answer, '{_CITE}', 1, 'i')) AS a, unnest(regexp_extract_all(answer, '{_CITE}', 2, 'i')) AS s FROM ans)),
      cv AS (SELECT c.query_id, c.no, coalesce(bool_or({_ACT}), false) AS v, coalesce(bool_or({_ACT} AND {_SAYS}), false) AS st FROM ci c LEFT JOIN hp h USING (query_id) GROUP BY 1, 2)
      SELECT query_id, count(*) AS n_citations, count(*) FILTER (v) AS n_valid, count(*) FILTER (st) AS n_strict FROM cv GROUP BY 1""",
    "section_metadata": f"""SELECT section_id, md5(text) AS text_hash, regexp_matches(text, '\\(\\d+[a-z]?\\)') AS has_subsections, len(p)::INT AS n_penalties, md5(array_to_string(p, '|')) AS penalties_hash, regexp_matches(left(text, 2000), 'repealed by.*?Act No\\.\\s*(\\d+)\\s+of\\s+(\\d{{4}})', 'i') AS is_repealed,
      coalesce(nullif(regexp_extract(left(text, 5000), '(\\d+)\\.\\s+Definitions', 1, 'i'), ''), nullif(regexp_extract(left(text, 5000), '(\\d+)\\.\\s+Interpretation', 1, 'i'), '')) AS definitions_section
      FROM (SELECT *, list_filter(list_transform({_list(N.PENALTY_WORDS)}, lambda w: regexp_replace(list_filter(string_split_regex(text, '[.!?]'), lambda s: contains(lower(s), w))[1], '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x IS NOT NULL) AS p FROM (SELECT DISTINCT section_id, text FROM legal_sections WHERE text <> ''))""",
}
