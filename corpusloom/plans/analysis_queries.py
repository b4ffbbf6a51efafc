"""Queries over answers, ratings, failures, audit entries and tables as a whole, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import article_id
from corpusloom.operators import measures as M
from corpusloom.plans.retrieval_queries import _BASE, _gold, _lexical, _passages, _queries
from corpusloom.sources.tables import table
from corpusloom.streaming.audit import rate_limited


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_sheet").distinct()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qac_items").select("item_id", "query_type", "legal_domain", "difficulty", F.size("relevant_passages").alias("n_relevant"), F.size("gold_answers").alias("n_answers"), F.coalesce(F.size(F.get("gold_answers", F.lit(0))["citations"]), F.lit(0)).alias("n_citations")).groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("query_type", "legal_domain", "difficulty", "n_relevant", "n_answers", "n_citations")])


def abstention_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Abstentions against items without any relevant passage, by query type; unknown flags are left out."""
    j = _sheet(spark, d).filter("rag_abstained IS NOT NULL").select("run_id", "item_id", "rag_abstained").join(_items(spark, d), "item_id")
    return M.confusion(j, F.col("rag_abstained"), F.coalesce("n_relevant", F.lit(0)) <= 0, ["query_type"])


def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the three ratings and of their mean per run, over answers that have all three."""
    s = _sheet(spark, d)
    long = s.select("run_id", F.lit("rag").alias("system"), *[F.col(f"rag_{c}").alias(c) for c in ("correctness", "completeness", "clarity")]).unionByName(s.select("run_id", F.lit("no_rag").alias("system"), *[F.col(f"no_rag_{c}").alias(c) for c in ("correctness", "completeness", "clarity")]))
    full = long.dropna(subset=["correctness", "completeness", "clarity"]).withColumn("rubric", (F.col("correctness") + F.col("completeness") + F.col("clarity")) / 3)
    return M.summarize(full, ["run_id", "system"], ["correctness", "completeness", "clarity", "rubric"])


def _rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Band pairs of two raters on one document; at most a few raters label a document."""
    r = table(spark, d, "reading_labels").groupBy("doc_id", "rater_id").agg(F.min("band").alias("band"))
    s = r.select("doc_id", F.col("rater_id").alias("rater2"), F.col("band").alias("b"))
    return r.select("doc_id", F.col("rater_id").alias("rater1"), F.col("band").alias("a")).join(s, "doc_id").filter("rater1 < rater2")


def rater_kappas(spark: SparkSession, d: str) -> DataFrame:
    k = M.kappas(_rater_pairs(spark, d), [1, 2, 3, 4], ["rater1", "rater2"])
    return k.withColumn("band", M.landis_koch(F.col("kappa")))


def rater_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _rater_pairs(spark, d).filter(F.abs(F.col("a") - F.col("b")) >= 2).select("doc_id", "rater1", "rater2", "a", "b")


def rating_kappas(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the ratings of both systems' answers per dimension, rounded half up to 1 to 5."""
    s = _sheet(spark, d)
    half_up = lambda c: F.least(F.greatest(F.floor(F.col(c) + 0.5), F.lit(1)), F.lit(5)).cast("int")
    parts = [s.select(F.lit(c).alias("dimension"), half_up(f"rag_{c}").alias("a"), half_up(f"no_rag_{c}").alias("b")) for c in ("correctness", "completeness", "clarity")]
    return M.kappas(parts[0].unionByName(parts[1]).unionByName(parts[2]), [1, 2, 3, 4, 5], ["dimension"])


def _failures(spark: SparkSession, d: str) -> DataFrame:
    """The modes of every run and item; an item that no run answered has one row, without a run."""
    h = _lexical(spark, d).join(_passages(spark, d).select("corpus_pos", "passage_id"), "corpus_pos").select("query_id", article_id(F.col("passage_id")).alias("key"), "rank")
    first = h.join(_gold(spark, d), ["query_id", "key"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    n = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    gold = _gold(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    flag = table(spark, d, "annotation_sheet").select("run_id", F.col("item_id").alias("query_id"), F.col("rag_abstained").alias("abstained"), F.col("rag_attribution_f1").alias("support")).distinct()
    j = _queries(spark, d).join(gold, "query_id", "left").join(first, "query_id", "left").join(n, "query_id", "left").join(flag, "query_id", "left").fillna(0, ["n_gold", "n_hits"])
    should, did = F.col("n_gold") == 0, F.coalesce("abstained", F.lit(False))
    modes = [
        (F.col("n_gold") > 0) & F.col("first").isNull(), (F.col("n_gold") > 0) & (F.col("first") > 5), (F.col("query_type") == "cross_referenced") & (F.col("n_hits") < 2),
        did & ~should, ~did & should, ~did & (F.col("support") < 0.1),
    ]
    names = ["retrieval_miss", "partial_retrieval", "coverage_failure", "wrong_abstention", "missed_abstention", "faithfulness_failure"]
    found = F.filter(F.array(*[F.when(c, n) for c, n in zip(modes, names)]), lambda x: x.isNotNull())
    j = j.withColumn("modes", F.when(F.size(found) == 0, F.array(F.lit("no_failure"))).otherwise(found))
    has = lambda *ms: F.arrays_overlap("modes", F.array(*[F.lit(m) for m in ms]))
    return j.withColumn("severity", F.when(has("faithfulness_failure"), "critical").when(has("retrieval_miss", "missed_abstention"), "high").when(has("wrong_abstention", "coverage_failure"), "medium").when(has("partial_retrieval"), "low").otherwise("none"))


def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).select("run_id", "query_id", F.array_join("modes", "|").alias("modes"), "severity")


def failure_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Runs and items per failure mode and query type with the rate over all of the type."""
    f = _failures(spark, d)
    n = f.groupBy("query_type").agg(F.count(F.lit(1)).alias("n_items"))
    c = f.select("query_type", F.explode("modes").alias("mode")).groupBy("query_type", "mode").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, c.query_type.eqNullSafe(n.query_type)).select(c.query_type, "mode", "n", F.round(F.col("n") / F.col("n_items"), 4).alias("rate"))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Items and mean citations of the first answer by query type, domain and difficulty, each on its own, and overall."""
    i = _items(spark, d)
    g = i.groupingSets([[F.col("query_type")], [F.col("legal_domain")], [F.col("difficulty")], []], "query_type", "legal_domain", "difficulty")
    kind = F.when(F.grouping("query_type") == 0, "query_type").when(F.grouping("legal_domain") == 0, "legal_domain").when(F.grouping("difficulty") == 0, "difficulty").otherwise("all")
    return g.agg(kind.alias("kind"), F.count(F.lit(1)).alias("n_items"), F.round(F.avg("n_citations"), 6).alias("mean_citations")).select("kind", F.coalesce("query_type", "legal_domain", "difficulty").alias("value"), "n_items", "mean_citations")


def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    """Per item: missing fields and incomplete citations."""
    i = table(spark, d, "qac_items")
    cites = F.flatten(F.transform(F.coalesce("gold_answers", F.array()), lambda g: F.coalesce(g["citations"], F.array())))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return i.select("item_id", blank(F.col("question")).alias("no_question"), (F.coalesce(F.size("gold_answers"), F.lit(0)) <= 0).alias("no_answers"), (F.coalesce(F.size("relevant_passages"), F.lit(0)) <= 0).alias("no_passages"), F.size(F.filter(cites, lambda c: blank(c["passage_id"]))).alias("citations_without_id"), F.size(F.filter(cites, lambda c: blank(c["passage_text"]) | c["start_char"].isNull())).alias("citations_incomplete")).distinct()


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    p = _passages(spark, d)
    return p.groupBy(F.coalesce("act_name", F.lit("Unknown")).alias("act_name")).agg(F.count(F.lit(1)).alias("n_passages"), F.count_distinct("passage_id").alias("n_ids"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 50).alias("n_kept"), F.sum(F.length("text")).alias("n_chars"))


def corpus_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Passages that begin in the middle of a sentence, end in one, or name several articles."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return _passages(spark, d).select("corpus_pos", t.rlike("^[a-z]").alias("starts_inside"), ((t != "") & ~t.rlike("[.;:)\\]\"]$")).alias("ends_inside"), (F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("Article (\\d+[A-Z]?)"), F.lit(1)))) > 1).alias("several_articles"))


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per day and retrieval method over entries counted once; errors count apart."""
    a = table(spark, d, "audit_log").groupBy("entry_id").agg(*[F.min_by(c, F.struct("received_at", "ts")).alias(c) for c in ("entry_type", "ts", "retrieval_method", "abstained", "flagged_for_review", "verification_passed", "faithfulness_score")])
    ok = F.col("entry_type").isNull() | (F.col("entry_type") != "error")
    return a.groupBy(F.to_date("ts").alias("day"), "retrieval_method").agg(F.count_if(ok).alias("n_queries"), F.count_if(~ok).alias("n_errors"), F.count_if(ok & F.col("abstained")).alias("n_abstained"), F.count_if(ok & F.col("flagged_for_review")).alias("n_flagged"), F.count_if(ok & F.col("verification_passed")).alias("n_passed"))


def user_history(spark: SparkSession, d: str) -> DataFrame:
    """The first ten entries of every user in time order."""
    a = table(spark, d, "audit_log").filter("user_id IS NOT NULL").groupBy("entry_id").agg(F.min("user_id").alias("user_id"), F.min("ts").alias("ts"))
    w = W.partitionBy("user_id").orderBy("ts", "entry_id")
    return a.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("user_id", "place", "entry_id")


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Faithfulness scores of the audited answers by method: exact order statistics."""
    a = table(spark, d, "audit_log").select("entry_id", "retrieval_method", "faithfulness_score").distinct()
    return M.percentile_ranks(a, "faithfulness_score", ["retrieval_method"], [0.0, 0.25, 0.5, 0.75, 0.95])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Event values by type: count, mean, and the elements at int(n * p)."""
    return M.percentile_ranks(table(spark, d, "events"), "value", ["event_type"], [0.5, 0.95, 0.99])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of 'confidence_score >= t predicts a passed verification' at 101 thresholds."""
    a = table(spark, d, "audit_log").select("entry_id", "confidence_score", "verification_passed").distinct()
    return M.threshold_sweep(a, "confidence_score", "verification_passed")


def wilcoxon_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank sums of both systems' ratings per dimension."""
    s = _sheet(spark, d)
    parts = [s.select("run_id", "item_id", F.lit(c).alias("dimension"), F.col(f"rag_{c}").alias("a"), F.col(f"no_rag_{c}").alias("b")) for c in ("correctness", "completeness", "clarity")]
    return M.wilcoxon(parts[0].unionByName(parts[1]).unionByName(parts[2]), "a", "b", ["dimension"])


def group_accuracy(spark: SparkSession, d: str) -> DataFrame:
    j = _sheet(spark, d).filter("rag_abstained IS NOT NULL").select("run_id", "item_id", "rag_abstained").join(_items(spark, d), "item_id")
    return j.groupBy("run_id", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("rag_abstained") == (F.coalesce("n_relevant", F.lit(0)) <= 0), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def act_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Per act: years in which its passages were enacted, in order, and the latest."""
    y = F.expr("try_cast(regexp_extract(metadata.enactment_date, '(\\\\d{4})', 1) AS int)")
    return _passages(spark, d).filter("act_name <> ''").groupBy("act_name").agg(F.array_join(F.array_sort(F.collect_set(y)).cast("array<string>"), "|").alias("years"), F.max(y).alias("last_year"))


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Requests per user and minute with those above the limit of two."""
    return rate_limited(table(spark, d, "events"), limit=2)


QUERIES = {f.__name__: f for f in (abstention_confusion, rubric_scores, rater_kappas, rater_disagreements, rating_kappas, failure_modes, failure_crosstab, dataset_stats, dataset_validation, corpus_stats, corpus_anomalies, audit_stats, user_history, score_distribution, latency_percentiles, threshold_sweep, wilcoxon_ratings, group_accuracy, act_timeline, rate_windows)}

_S = "(SELECT DISTINCT * FROM annotation_sheet)"
_I = "(SELECT item_id, min(query_type) AS query_type, min(legal_domain) AS legal_domain, min(difficulty) AS difficulty, min(len(relevant_passages)) AS n_relevant, min(coalesce(len(gold_answers[1].citations), 0)) AS n_citations FROM qac_items GROUP BY 1)"
_RP = "(SELECT x.doc_id, x.rater_id AS rater1, y.rater_id AS rater2, x.band AS a, y.band AS b FROM rl x JOIN rl y ON x.doc_id = y.doc_id AND x.rater_id < y.rater_id)"
_RL = "rl AS (SELECT doc_id, rater_id, min(band) AS band FROM reading_labels GROUP BY 1, 2)"


def _kappa(src: str, by: str, k: int) -> str:
    w = f"abs(i - j) / {k - 1}.0"
    return f"""c AS (SELECT {by}, a AS i, b AS j, count(*) AS n, sum(count(*)) OVER (PARTITION BY {by}) AS t FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {by}, a, b),
      o AS (SELECT {by}, max(t)::BIGINT AS n_pairs, sum(n) FILTER (i = j) / max(t) AS po, sum(n * {w}) / max(t) AS ol, sum(n * ({w}) * ({w})) / max(t) AS oq FROM c GROUP BY {by}),
      e AS (SELECT {by}, coalesce(sum(s) FILTER (i = j), 0) AS pe, sum(s * {w}) AS el, sum(s * ({w}) * ({w})) AS eq FROM (SELECT {by}, i, j, rn * cn / (t * t) AS s FROM (SELECT {by}, i, sum(n) AS rn FROM c GROUP BY {by}, i) JOIN (SELECT {by}, j, sum(n) AS cn, max(t)::DOUBLE AS t FROM c GROUP BY {by}, j) USING ({by})) GROUP BY {by}),
      kk AS (SELECT {by}, n_pairs, round(coalesce(po, 0), 6) AS agreement, round(CASE WHEN abs(1 - pe) < 1e-12 THEN 1.0 ELSE (coalesce(po, 0) - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN el <> 0 THEN 1 - ol / el END, 6) AS kappa_linear, round(CASE WHEN eq <> 0 THEN 1 - oq / eq END, 6) AS kappa_quadratic FROM o JOIN e USING ({by}))"""


def _half(c: str) -> str:
    return f"least(greatest(floor({c} + 0.5), 1), 5)::INT"


_DIMS = ("correctness", "completeness", "clarity")
_FAIL = _BASE + f""",
  h AS (SELECT query_id, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') AS key, rank FROM hits JOIN pas USING (corpus_pos)),
  fl AS (SELECT item_id AS query_id, arg_min_null(rag_abstained, {{'a': run_id, 'b': rag_abstained}}) AS abstained, arg_min_null(rag_attribution_f1, {{'a': run_id, 'b': rag_abstained}}) AS support FROM {_S} GROUP BY 1),
  fj AS (SELECT query_id, query_type, coalesce(n_gold, 0) AS n_gold, first, coalesce(n_hits, 0) AS n_hits, coalesce(abstained, false) AS did, support FROM q
    LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, min(rank) AS first FROM h JOIN gold USING (query_id, key) GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS n_hits FROM h GROUP BY 1) USING (query_id) LEFT JOIN fl USING (query_id)),
  fm0 AS (SELECT *, list_filter([CASE WHEN n_gold > 0 AND first IS NULL THEN 'retrieval_miss' END, CASE WHEN n_gold > 0 AND first > 5 THEN 'partial_retrieval' END, CASE WHEN query_type = 'cross_referenced' AND n_hits < 2 THEN 'coverage_failure' END,
    CASE WHEN did AND n_gold > 0 THEN 'wrong_abstention' END, CASE WHEN NOT did AND n_gold = 0 THEN 'missed_abstention' END, CASE WHEN NOT did AND support < 0.1 THEN 'faithfulness_failure' END], lambda x: x IS NOT NULL) AS m FROM fj),
  fm AS (SELECT *, CASE WHEN len(m) = 0 THEN ['no_failure'] ELSE m END AS modes FROM fm0)
"""
SQL = {
    "abstention_confusion": f"""SELECT query_type, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM (
      SELECT query_type, count(*) FILTER (x AND y) AS tp, count(*) FILTER (x AND NOT y) AS fp, count(*) FILTER (NOT x AND y) AS fn, count(*) FILTER (NOT x AND NOT y) AS tn FROM (SELECT i.query_type, rag_abstained AS x, coalesce(n_relevant, 0) = 0 AS y FROM {_S} JOIN {_I} i USING (item_id) WHERE rag_abstained IS NOT NULL) GROUP BY 1))""",
    "rubric_scores": "SELECT run_id, system, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in (*_DIMS, "rubric")) + f""" FROM (SELECT *, (correctness + completeness + clarity) / 3 AS rubric FROM (
      SELECT run_id, 'rag' AS system, {', '.join(f'rag_{c} AS {c}' for c in _DIMS)} FROM {_S} UNION ALL SELECT run_id, 'no_rag', {', '.join(f'no_rag_{c}' for c in _DIMS)} FROM {_S})) WHERE rubric IS NOT NULL GROUP BY 1, 2""",
    "rater_kappas": f"""WITH {_RL}, {_kappa(f"(SELECT rater1 || ',' || rater2 AS g, a, b FROM {_RP})", 'g', 4)} SELECT string_split(g, ',')[1] AS rater1, string_split(g, ',')[2] AS rater2, n_pairs, agreement, kappa, kappa_linear, kappa_quadratic,
      CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS band FROM kk""",
    "rater_disagreements": f"WITH {_RL} SELECT doc_id, rater1, rater2, a, b FROM {_RP} WHERE abs(a - b) >= 2",
    "rating_kappas": f"WITH s AS ({' UNION ALL '.join(f'''SELECT '{c}' AS dimension, {_half(f'rag_{c}')} AS a, {_half(f'no_rag_{c}')} AS b FROM {_S}''' for c in _DIMS)}), {_kappa('s', 'dimension', 5)} SELECT * FROM kk",
    "failure_modes": _FAIL + """SELECT query_id, array_to_string(modes, '|') AS modes, CASE WHEN list_contains(modes, 'faithfulness_failure') THEN 'critical' WHEN list_has_any(modes, ['retrieval_miss', 'missed_abstention']) THEN 'high'
      WHEN list_has_any(modes, ['wrong_abstention', 'coverage_failure']) THEN 'medium' WHEN list_contains(modes, 'partial_retrieval') THEN 'low' ELSE 'none' END AS severity FROM fm""",
    "failure_crosstab": _FAIL + "SELECT c.query_type, mode, n, round(n / n_items, 4) AS rate FROM (SELECT query_type, mode, count(*) AS n FROM (SELECT query_type, unnest(modes) AS mode FROM fm) GROUP BY 1, 2) c JOIN (SELECT query_type, count(*) AS n_items FROM fm GROUP BY 1) i ON c.query_type IS NOT DISTINCT FROM i.query_type",
    "dataset_stats": " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, count(*) AS n_items, round(avg(n_citations), 6) AS mean_citations FROM {_I} GROUP BY ALL" for k, v in (("query_type", "query_type"), ("legal_domain", "legal_domain"), ("difficulty", "difficulty"), ("all", "NULL"))),
    "dataset_validation": """SELECT DISTINCT item_id, trim(coalesce(question, '')) = '' AS no_question, coalesce(len(gold_answers), 0) = 0 AS no_answers, coalesce(len(relevant_passages), 0) = 0 AS no_passages,
      len(list_filter(c, lambda x: trim(coalesce(x.passage_id, '')) = ''))::INT AS citations_without_id, len(list_filter(c, lambda x: trim(coalesce(x.passage_text, '')) = '' OR x.start_char IS NULL))::INT AS citations_incomplete
      FROM (SELECT *, flatten(list_transform(coalesce(gold_answers, []), lambda g: coalesce(g.citations, []))) AS c FROM qac_items)""",
    "corpus_stats": "SELECT coalesce(act_name, 'Unknown') AS act_name, count(*) AS n_passages, count(DISTINCT passage_id) AS n_ids, count(*) FILTER (length(trim(coalesce(text, ''))) >= 50) AS n_kept, sum(length(text))::BIGINT AS n_chars FROM passages GROUP BY 1",
    "corpus_anomalies": "SELECT corpus_pos, regexp_matches(t, '^[a-z]') AS starts_inside, t <> '' AND NOT regexp_matches(t, '[.;:)\\]\"]$') AS ends_inside, len(list_distinct(regexp_extract_all(t, 'Article (\\d+[A-Z]?)', 1))) > 1 AS several_articles FROM (SELECT corpus_pos, trim(coalesce(text, '')) AS t FROM passages)",
    "audit_stats": """WITH a AS (SELECT entry_id, min(ts) AS ts, arg_min_null(entry_type, {'a': received_at, 'b': ts}) AS entry_type, arg_min_null(retrieval_method, {'a': received_at, 'b': ts}) AS retrieval_method, arg_min_null(abstained, {'a': received_at, 'b': ts}) AS abstained, arg_min_null(flagged_for_review, {'a': received_at, 'b': ts}) AS flagged, arg_min_null(verification_passed, {'a': received_at, 'b': ts}) AS passed, arg_min_null(ts, {'a': received_at, 'b': ts}) AS ts2 FROM audit_log GROUP BY 1)
      SELECT ts2::DATE AS day, retrieval_method, count(*) FILTER (ok) AS n_queries, count(*) FILTER (NOT ok) AS n_errors, count(*) FILTER (ok AND abstained) AS n_abstained, count(*) FILTER (ok AND flagged) AS n_flagged, count(*) FILTER (ok AND passed) AS n_passed FROM (SELECT *, entry_type IS NULL OR entry_type <> 'error' AS ok FROM a) GROUP BY 1, 2""",
    "user_history": "SELECT user_id, place, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, entry_id)::INT AS place FROM (SELECT entry_id, min(user_id) AS user_id, min(ts) AS ts FROM audit_log WHERE user_id IS NOT NULL GROUP BY 1)) WHERE place <= 10",
    "score_distribution": "SELECT retrieval_method, count(*) AS n, round(avg(v), 6) AS mean, " + ", ".join(f"max(v) FILTER (i = floor(n * {p})) AS p{round(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 0.95)) + " FROM (SELECT retrieval_method, faithfulness_score AS v, row_number() OVER (PARTITION BY retrieval_method ORDER BY faithfulness_score) - 1 AS i, count(*) OVER (PARTITION BY retrieval_method) AS n FROM (SELECT DISTINCT entry_id, retrieval_method, faithfulness_score FROM audit_log) WHERE faithfulness_score IS NOT NULL) GROUP BY 1",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, " + ", ".join(f"max(v) FILTER (i = floor(n * {p})) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "threshold_sweep": """WITH a AS (SELECT DISTINCT entry_id, confidence_score AS s, verification_passed AS l FROM audit_log), b AS (SELECT * FROM a WHERE s IS NOT NULL AND l IS NOT NULL)
      SELECT threshold, tp, fp, fn, tn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM (SELECT g / 100 AS threshold, coalesce(count(*) FILTER (floor(round(s * 100, 6)) >= g AND l), 0) AS tp, count(*) FILTER (floor(round(s * 100, 6)) >= g AND NOT l) AS fp, count(*) FILTER (floor(round(s * 100, 6)) < g AND l) AS fn, count(*) FILTER (floor(round(s * 100, 6)) < g AND NOT l) AS tn FROM b CROSS JOIN (SELECT unnest(range(101)) AS g) GROUP BY g)""",
    "wilcoxon_ratings": f"""WITH s AS ({' UNION ALL '.join(f'''SELECT '{c}' AS dimension, rag_{c} - no_rag_{c} AS d FROM {_S} WHERE rag_{c} <> no_rag_{c}''' for c in _DIMS)}),
      z AS (SELECT dimension, round(abs(d), 9) AS size, count(*) AS n, count(*) FILTER (d > 0) AS up FROM s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dimension ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM z),
      t AS (SELECT dimension, sum(n)::BIGINT AS n, sum(rank * up) AS w_plus, sum(rank * (n - up)) AS w_minus, sum(n * n * n - n) AS ties FROM r GROUP BY 1)
      SELECT dimension, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""",
    "group_accuracy": f"SELECT run_id, difficulty, count(*) AS n, round(avg((rag_abstained = (coalesce(n_relevant, 0) = 0))::INT), 6) AS accuracy FROM {_S} s JOIN {_I} i USING (item_id) WHERE rag_abstained IS NOT NULL GROUP BY 1, 2",
    "act_timeline": "SELECT act_name, array_to_string(list_sort(list(DISTINCT y) FILTER (y IS NOT NULL)), '|') AS years, max(y) AS last_year FROM (SELECT act_name, try_cast(regexp_extract(metadata.enactment_date, '(\\d{4})', 1) AS INT) AS y FROM passages WHERE act_name <> '') GROUP BY 1",
    "rate_windows": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, greatest(count(*) - 2, 0) AS n_rejected FROM events GROUP BY 1, 2",
}
