"""Queries that build a corpus from its parts, and expand questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import segment as G
from corpusloom.sources.tables import table


def _acts(spark: SparkSession, d: str) -> DataFrame:
    """Act texts put together from their sections in order of their numbers."""
    s = table(spark, d, "legal_sections").filter("level IN ('section', 'subsection')").select(F.concat_ws("_", F.lit("ACT"), "act_number", "act_year").alias("act_id"), F.expr("try_cast(regexp_extract(section_number, '^([0-9]+)', 1) AS int)").alias("n"), "section_id", F.when(F.col("section_number").isNotNull(), F.concat("section_number", F.lit(". "), "title", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text")).distinct()
    return G.reassemble(s, "act_id", ["n", "section_id"]).withColumn("title", F.col("act_id"))


def act_segments(spark: SparkSession, d: str) -> DataFrame:
    return G.segment_acts(_acts(spark, d)).select("section_id", "level", "title", "parent_id", "place", F.length("text").alias("n_chars"))


def act_passages(spark: SparkSession, d: str) -> DataFrame:
    return G.passages_of(G.segment_acts(_acts(spark, d)))


def article_segments(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "constitution_articles").select("edition", "start_pos", "article_id", "full_text").distinct()
    return G.article_passages(G.segment_articles(G.reassemble(a, "edition", ["start_pos", "article_id"], "full_text")))


def expand_terms(query: Column, concepts: list[tuple[str, list[str]]]) -> Column:
    """The query and, behind it, the distinct terms of every concept that occurs in it, in the order of the table."""
    low = F.lower(query)
    extra = F.array_distinct(F.flatten(F.array(*[F.when(low.contains(c), F.array(*[F.lit(t) for t in ts])).otherwise(F.array().cast("array<string>")) for c, ts in concepts])))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


#: A small table for the test query; the real one is a parameter.
CONCEPTS = [("penalty", ["fine", "imprisonment", "liable on conviction"]), ("appeal", ["appeal against", "appellate panel"]), ("licence", ["permit", "licensing authority"]), ("boundary", ["survey", "Surveyor-General"]), ("water", ["Water Authority", "common channel"])]


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qac_items").filter("item_id IS NOT NULL AND question IS NOT NULL").select("item_id", "question").distinct()
    return q.select("item_id", expand_terms(F.col("question"), CONCEPTS).alias("retrieval_query"))


def _sql_case(c: str, ts: list[str]) -> str:
    return f"CASE WHEN contains(lower(question), '{c}') THEN {ts!r} ELSE [] END"


QUERIES = {f.__name__: f for f in (act_segments, act_passages, article_segments, query_expansion)}
_PARTS = [_sql_case(c, ts) for c, ts in CONCEPTS]
_CAT = _PARTS[0]
for _p in _PARTS[1:]:
    _CAT = f"list_concat({_CAT}, {_p})"
SQL = {"query_expansion": f"SELECT DISTINCT item_id, CASE WHEN len(e) > 0 THEN question || ' ' || array_to_string(e, ' ') ELSE question END AS retrieval_query FROM (SELECT item_id, question, {_CAT} AS e FROM qac_items WHERE item_id IS NOT NULL AND question IS NOT NULL)"}
