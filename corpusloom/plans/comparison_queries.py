"""Comparisons of search methods and checks of whole answers, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import article_id
from corpusloom.operators import answers as A
from corpusloom.operators import evidence as E
from corpusloom.operators import measures as M
from corpusloom.operators import retrieval as R
from corpusloom.operators.spans import DISCLAIMERS, citation_density, citation_format, citations, claims
from corpusloom.plans.evidence_queries import SQL as EVIDENCE_SQL
from corpusloom.plans.evidence_queries import _answers, _hits, faithfulness_of, validity_of
from corpusloom.plans.retrieval_queries import _BASE, _EXACT, _FUSE, _dense, _fused, _gold, _lexical, _passages, _queries, _signs, reranked
from corpusloom.plans.text_queries import _CITE, _WS
from corpusloom.session import materialize
from corpusloom.sources.tables import table


_COMPARED = ("bm25", "dense", "hybrid", "hybrid_rerank")


def _methods(spark: SparkSession, d: str, wanted: tuple[str, ...] = _COMPARED) -> DataFrame:
    """(method, query_id, key, rank): the hits of the wanted methods at article level; what no wanted method needs is not computed."""
    p = _passages(spark, d).select("corpus_pos", "passage_id")
    several = len(set(wanted) & {"hybrid", "hybrid_rerank"}) > 1
    # what is used several times is computed once
    pool = materialize(_lexical(spark, d, 100)) if len(set(wanted) - {"dense"}) > 1 else _lexical(spark, d, 100)
    fused = _fused(spark, d, pool)
    f = materialize(fused) if several else fused
    hits = {
        "bm25": lambda: pool.filter("rank <= 20").join(p, "corpus_pos"),
        "dense": lambda: _dense(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos"))),
        "hybrid": lambda: f,
        "hybrid_rerank": lambda: reranked(spark, d, f).withColumn("rank", F.col("final_rank")),
    }
    every = reduce(DataFrame.unionByName, [hits[m]().select(F.lit(m).alias("method"), "query_id", "passage_id", "rank") for m in wanted]).withColumn("key", article_id(F.col("passage_id")))
    first = every.groupBy("method", "query_id", "key").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("method", "query_id").orderBy("rank")))


def _method_scores(spark: SparkSession, d: str, wanted: tuple[str, ...] = _COMPARED) -> DataFrame:
    h = _methods(spark, d, wanted).withColumn("query_id", F.concat_ws("|", "method", "query_id")).drop("method")
    g = _gold(spark, d).join(_queries(spark, d).select("query_id"), "query_id").withColumn("m", F.explode(F.array(*[F.lit(m) for m in wanted]))).select(F.concat_ws("|", "m", "query_id").alias("query_id"), "key")
    return M.retrieval_scores(h, g, (10,)).withColumn("method", F.substring_index("query_id", "|", 1))


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return M.summarize(_method_scores(spark, d), ["method"], ["mrr", "recall_10", "ndcg_10"])


def method_significance(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank sums of the reciprocal ranks of the lexical and the fused search, paired by item."""
    s = _method_scores(spark, d, ("bm25", "hybrid")).select(F.substring_index("query_id", "|", -1).alias("item"), "method", F.round("mrr", 6).alias("mrr"))
    p = s.groupBy("item").agg(F.max(F.when(F.col("method") == "bm25", F.col("mrr"))).alias("a"), F.max(F.when(F.col("method") == "hybrid", F.col("mrr"))).alias("b")).withColumn("pair", F.lit("bm25-hybrid"))
    return M.wilcoxon(p, "a", "b", ["pair"])


def statute_references(spark: SparkSession, d: str) -> DataFrame:
    return A.statute_references(_queries(spark, d))


def reasoning_steps(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_log").filter("answer IS NOT NULL").select("entry_id", "answer").distinct()
    s = a.select("entry_id", F.posexplode(A.reasoning_steps(F.col("answer"))).alias("no", "s"))
    return s.select("entry_id", "no", F.md5("s.text").alias("text_hash"), "s.source", A.step_type(F.col("s.text")).alias("kind")).distinct()


def evidence_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = A.evidence_prompt(E.primary_and_supporting(E.confidence_filter(_hits(spark, d), 0.3)))
    return p.select("query_id", F.length("prompt").alias("n_chars"), F.size(F.split("prompt", "Act: ")).alias("n_parts"))


def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per run and answered item: whether the answer is faithful, validly cited, covered and well formed, all of it, and the confidence of it."""
    a = _answers(spark, d).select("run_id", "query_id", citation_density(F.col("answer")).alias("density"), citation_format(F.col("answer")).alias("f"))
    hits = materialize(_hits(spark, d))  # one search for both checks
    j = a.join(faithfulness_of(_answers(spark, d), hits), ["run_id", "query_id"], "left").join(validity_of(_answers(spark, d), hits), ["run_id", "query_id"], "left").fillna(0, ["n_claims", "n_supported", "n_citations", "n_valid"])
    faith, bad = M.ratio(F.col("n_supported"), F.col("n_claims")), F.col("n_citations") - F.col("n_valid")
    valid = (F.col("n_citations") > 0) & (bad == 0)
    rate = M.ratio(F.col("n_valid"), F.col("n_citations"))
    passed = (faith >= 0.8) & valid & (F.col("density") >= 0.35) & (F.col("f.total") == F.col("f.well_formed"))
    c = A.confidence(F.lit(None).cast("double"), A.penalized(faith, F.col("n_claims") - F.col("n_supported"), 0.1, 0.3), F.when(valid, 1.0).otherwise(A.penalized(rate, bad, 0.15, 0.5)), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return j.select("run_id", "query_id", (faith >= 0.8).alias("is_faithful"), valid.alias("all_valid"), passed.alias("passed"), ((bad > 0) | (faith < 0.5)).alias("abstain"), F.round(c, 6).alias("confidence"), A.confidence_level(F.round(c, 6)).alias("level"))


def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Per run: answers of both systems with citations, and claims per answer."""
    s = table(spark, d, "annotation_sheet").distinct()
    long = s.select("run_id", "item_id", F.lit("rag").alias("system"), F.col("rag_answer").alias("a")).unionByName(s.select("run_id", "item_id", F.lit("no_rag").alias("system"), F.col("no_rag_answer").alias("a")))
    n, k = F.coalesce(F.size(citations(F.col("a"))), F.lit(0)), F.coalesce(F.size(claims(F.col("a"))), F.lit(0))
    return long.groupBy("run_id", "system").agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 0).alias("n_with_citations"), F.sum(F.greatest(n, F.lit(0))).alias("n_citations"), F.sum(F.greatest(k, F.lit(0))).alias("n_claims"))


def renumbered_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that have gold, numbered anew in the order of their ids."""
    q = _queries(spark, d).join(_gold(spark, d).select("query_id").distinct(), "query_id", "left_semi")
    # ranges of ids carry their offsets, so that no window holds all rows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = materialize(q.select("query_id").repartitionByRange(n, "query_id").withColumn("block", F.spark_partition_id()))
    sizes = b.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("query_id"))
    return b.join(sizes, "block").select("query_id", F.format_string("QAC_%03d", place).alias("new_id"))


QUERIES = {f.__name__: f for f in (method_comparison, method_significance, statute_references, reasoning_steps, evidence_prompt, answer_verdicts, baseline_comparison, renumbered_items)}

_METHODS = _BASE + _EXACT + _FUSE + f""",
  lg AS (SELECT fu.*, lower(query) AS lq, lower(coalesce(text, '')) AS t, ((fu.corpus_pos * 37 + length(query_id) * 11) % 200) / 20.0 - 5.0 AS l FROM fu JOIN q USING (query_id) JOIN pas ON pas.corpus_pos = fu.corpus_pos),
  ad AS (SELECT *, {_signs(R.RESTRICTION_SIGNS)} AS r, {_signs(R.CONTENT_SIGNS)} AS c FROM lg),
  rs AS (SELECT *, CASE WHEN NOT regexp_matches(lq, '{'|'.join(R.DEFINITION_SIGNS)}') THEN l WHEN r > c AND r >= 2 THEN l * 0.7 WHEN c >= 2 AND c > r THEN l * 1.15 ELSE l END AS rr FROM ad),
  rb AS (SELECT *, CASE WHEN exact_match THEN score ELSE round(0.7 * (rr - min(rr) OVER w) / CASE WHEN max(rr) OVER w > min(rr) OVER w THEN max(rr) OVER w - min(rr) OVER w ELSE 1 END
    + 0.3 * (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END, 9) END AS fs FROM rs WINDOW w AS (PARTITION BY query_id, exact_match)),
  mh AS (SELECT 'bm25' AS method, query_id, passage_id, rank FROM hits JOIN pas USING (corpus_pos)
    UNION ALL SELECT 'dense', query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos) FROM dn
    UNION ALL SELECT 'hybrid', query_id, passage_id, rank FROM fu
    UNION ALL SELECT 'hybrid_rerank', query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, CASE WHEN exact_match THEN rank END NULLS FIRST, fs DESC, corpus_pos) FROM rb),
  mk AS (SELECT method, query_id, key, row_number() OVER (PARTITION BY method, query_id ORDER BY r) AS rank FROM (SELECT method, query_id, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') AS key, min(rank) AS r FROM mh GROUP BY 1, 2, 3)),
  mg AS (SELECT unnest(['bm25', 'dense', 'hybrid', 'hybrid_rerank']) AS method, query_id, key FROM gold JOIN (SELECT query_id FROM q) USING (query_id)),
  mm AS (SELECT method, query_id, coalesce(1.0 / min(rank), 0.0) AS mrr, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10,
    round(coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_10 FROM mg LEFT JOIN mk USING (method, query_id, key) GROUP BY 1, 2)
"""
_STAT = "coalesce(" + ", ".join([f"CASE WHEN x = '{k}' THEN '{v}' END" for k, v in A.STATUTES] + [f"CASE WHEN contains(x, '{k}') THEN '{v}' END" for k, v in A.STATUTES]) + ", array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '))"
_NAMED = "coalesce(" + ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in A.STATUTES) + ", CASE WHEN regexp_matches(t, 'theft|murder|assault|criminal') THEN 'Penal Code' WHEN contains(t, 'evidence') THEN 'Evidence Ordinance' WHEN regexp_matches(t, 'civil|suit') THEN 'Civil Procedure Code' END)"
_BOTH = " UNION ALL ".join([f"SELECT query_id, unnest(regexp_extract_all(t, '{p}', 1)) AS section, unnest(regexp_extract_all(t, '{p}', 2)) AS x FROM ql" for p in A.SECTION_FIRST] + [f"SELECT query_id, unnest(regexp_extract_all(t, '{A.STATUTE_FIRST}', 2)), unnest(regexp_extract_all(t, '{A.STATUTE_FIRST}', 1)) FROM ql"])
SQL = {
    "method_comparison": _METHODS + "SELECT method, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("mrr", "recall_10", "ndcg_10")) + " FROM mm GROUP BY 1",
    "method_significance": _METHODS + """, pp AS (SELECT round(max(mrr) FILTER (method = 'bm25'), 6) - round(max(mrr) FILTER (method = 'hybrid'), 6) AS d FROM mm GROUP BY query_id),
      z AS (SELECT round(abs(d), 9) AS size, count(*) AS n, count(*) FILTER (d > 0) AS up FROM pp WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM z),
      t AS (SELECT sum(n)::BIGINT AS n, sum(rank * up) AS w_plus, sum(rank * (n - up)) AS w_minus, sum(n * n * n - n) AS ties FROM r)
      SELECT 'bm25-hybrid' AS pair, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""",
    "statute_references": _BASE + f""", ql AS (SELECT query_id, lower(query) AS t FROM q), bo AS (SELECT query_id, section, regexp_replace(lower(trim(x, ' ' || chr(9) || chr(10))), '\\s+', ' ', 'g') AS x FROM ({_BOTH})),
      ev AS (SELECT query_id, section, {_STAT} AS statute, 0.9 AS confidence FROM bo UNION ALL SELECT query_id, unnest(regexp_extract_all(t, '\\bsection\\s+(\\d+[a-z]?)\\b', 1)), {_NAMED}, 0.5 FROM ql WHERE {_NAMED} IS NOT NULL)
      SELECT query_id, section, statute, max(confidence)::DOUBLE AS confidence FROM ev GROUP BY 1, 2, 3""",
    "renumbered_items": _BASE + "SELECT query_id, 'QAC_' || lpad((row_number() OVER (ORDER BY query_id))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY query_id))::VARCHAR))::INT, '0') AS new_id FROM q WHERE query_id IN (SELECT query_id FROM gold)",
    "baseline_comparison": f"""SELECT run_id, system, count(*) AS n, count(*) FILTER (c > 0) AS n_with_citations, sum(c)::BIGINT AS n_citations, sum(k)::BIGINT AS n_claims FROM (
      SELECT run_id, system, coalesce(len(regexp_extract_all(a, '{_CITE}', 0, 'i')), 0) AS c, coalesce(len(list_filter(list_transform(string_split_regex(regexp_replace(a, '\\[.*?\\]', '', 'g'), '[.!?]+'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(lower(s), '{'|'.join(DISCLAIMERS)}'))), 0) AS k
      FROM (SELECT run_id, 'rag' AS system, rag_answer AS a FROM (SELECT DISTINCT * FROM annotation_sheet) UNION ALL SELECT run_id, 'no_rag', no_rag_answer FROM (SELECT DISTINCT * FROM annotation_sheet))) GROUP BY 1, 2""",
    "reasoning_steps": f"""WITH s AS (SELECT entry_id, list_filter(list_transform(regexp_extract_all(answer, '(?:Step\\s+)?(\\d+)[.:)\\s]+([^\\n]+)', 2, 'i'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: length(x) > 10)[1:10] AS l,
        list_filter(list_transform(string_split_regex(answer, '\\n\\n')[1:10], lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: length(x) > 20) AS p FROM (SELECT DISTINCT entry_id, answer FROM audit_log WHERE answer IS NOT NULL)),
      t AS (SELECT entry_id, CASE WHEN len(l) > 0 THEN 'answer_text' ELSE 'paragraph' END AS source, unnest(range(len(CASE WHEN len(l) > 0 THEN l ELSE p END)))::INT AS no, unnest(CASE WHEN len(l) > 0 THEN l ELSE p END) AS x FROM s)
      SELECT DISTINCT entry_id, no, md5(x) AS text_hash, source, CASE {' '.join(f"WHEN regexp_matches(lower(x), '{'|'.join(w)}') THEN '{n}'" for n, w in A.STEP_WORDS)} ELSE 'general' END AS kind FROM t""",
    "answer_verdicts": f"""WITH f AS ({EVIDENCE_SQL['faithfulness']}), v AS ({EVIDENCE_SQL['citation_validity']}),
      ans AS (SELECT item_id AS query_id, arg_min(rag_answer, {{'a': run_id, 'b': rag_answer}}) AS answer FROM annotation_sheet WHERE rag_answer IS NOT NULL GROUP BY 1),
      a0 AS (SELECT query_id, regexp_extract_all(answer, '\\[[^\\]]+\\]') AS b, string_split_regex(regexp_replace(regexp_replace(answer, '\\*?This information is for general reference[^*]*\\*?', '', 'gi'), '^{_WS}+|{_WS}+$', '', 'g'), '[.!?]+') AS p FROM ans),
      a1 AS (SELECT query_id, len(b) = len(list_filter(b, lambda x: regexp_matches(x, '^{_CITE}', 'i'))) AS formed, len(list_filter(p, lambda x: regexp_matches(x, '{_CITE}', 'i'))) AS nc, len(list_filter(p, lambda x: length(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) > 10)) AS ns FROM a0),
      j AS (SELECT query_id, formed, CASE WHEN ns = 0 THEN 0.0 ELSE nc / ns END AS density, coalesce(n_claims, 0) AS nk, coalesce(n_supported, 0) AS sk, coalesce(n_citations, 0) AS ci, coalesce(n_valid, 0) AS va FROM a1 LEFT JOIN f USING (query_id) LEFT JOIN v USING (query_id)),
      k AS (SELECT *, CASE WHEN nk = 0 THEN 0.0 ELSE sk / nk END AS faith, ci > 0 AND ci = va AS valid, CASE WHEN ci = 0 THEN 0.0 ELSE va / ci END AS rate FROM j),
      c AS (SELECT *, round(0.5 * 0.25 + greatest(faith - least((nk - sk) * 0.1, 0.3), 0) * 0.30 + CASE WHEN valid THEN 1.0 ELSE greatest(rate - least((ci - va) * 0.15, 0.5), 0) END * 0.20 + 0.5 * 0.15 + 0.5 * 0.10, 6) AS confidence FROM k)
      SELECT query_id, faith >= 0.8 AS is_faithful, valid AS all_valid, faith >= 0.8 AND valid AND density >= 0.35 AND formed AS passed, ci > va OR faith < 0.5 AS abstain, confidence,
        CASE WHEN confidence >= 0.85 THEN 'very_high' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM c""",
}
