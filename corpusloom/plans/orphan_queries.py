"""Queries of P1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.orphan_refs import orphan_references, qac_references
from corpusloom.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = qac_references(table(spark, d, "qac_items"))
    return orphan_references(refs, table(spark, d, "passages"), "passage_id", "created_at", "passage_id", "ingested_at", "deleted_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("field", "item_id", "passage_id", "reason").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and references per field and month of ``created_at``, with the share."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    every = qac_references(table(spark, d, "qac_items")).filter("trim(BOTH ' \t\n\r' FROM passage_id) <> ''").distinct().groupBy("field", month).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = _orphans(spark, d).groupBy("field", month).agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late")])
    bad = bad.select(F.col("field").alias("f"), F.col("month").alias("m"), *[f"n_{r}" for r in ("missing", "deleted", "late")])
    out = every.join(bad, (every.field == bad.f) & every.month.eqNullSafe(bad.m), "left")
    n = {r: F.coalesce(f"n_{r}", F.lit(0)) for r in ("missing", "deleted", "late")}
    return out.select("field", "month", "n_refs", *[c.alias(f"n_{r}") for r, c in n.items()], F.round((n["missing"] + n["deleted"] + n["late"]) / F.col("n_refs"), 6).alias("orphan_share"))


_CANON = "regexp_replace(regexp_replace(upper({c}), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[_\\-\\s]+', '_', 'g')"
_CASES = f"""
WITH refs AS (
  SELECT DISTINCT field, item_id, passage_id, created_at, {_CANON.format(c='passage_id')} AS k FROM (
    SELECT 'relevant_passages' AS field, item_id, created_at, unnest(relevant_passages) AS passage_id FROM qac_items
    UNION ALL
    SELECT 'citation', item_id, created_at, c.passage_id FROM (
      SELECT item_id, created_at, unnest(g.citations) AS c FROM (SELECT item_id, created_at, unnest(gold_answers) AS g FROM qac_items)))
  WHERE trim(passage_id, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
par AS (SELECT {_CANON.format(c='passage_id')} AS k, ingested_at, deleted_at FROM passages WHERE passage_id IS NOT NULL),
keys AS (SELECT k, ingested_at, deleted_at FROM par UNION ALL
  SELECT regexp_replace(k, '_CHUNK_[0-9]+$', ''), ingested_at, deleted_at FROM par WHERE regexp_matches(k, '_CHUNK_[0-9]+$')),
st AS (
  SELECT r.field, r.item_id, r.passage_id, r.created_at,
    count(p.k) AS n, coalesce(bool_or(p.ingested_at <= r.created_at), false) AS seen,
    coalesce(bool_or(p.ingested_at <= r.created_at AND (p.deleted_at IS NULL OR p.deleted_at > r.created_at)), false) AS ok
  FROM refs r LEFT JOIN keys p ON p.k = r.k GROUP BY ALL),
cases AS (SELECT *, CASE WHEN ok THEN NULL WHEN n = 0 THEN 'missing' WHEN seen THEN 'deleted' ELSE 'late' END AS reason FROM st)
"""
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _CASES + "SELECT DISTINCT field, item_id, passage_id, reason FROM cases WHERE reason IS NOT NULL",
    "p1_report": _CASES + """SELECT field, strftime(created_at, '%Y-%m') AS month, count(*) AS n_refs,
      count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'late') AS n_late,
      round(count(reason) / count(*), 6) AS orphan_share FROM cases GROUP BY 1, 2""",
}
