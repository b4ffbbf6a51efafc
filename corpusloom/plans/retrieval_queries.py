"""Queries over index tables, search, fusion, expansions and retrieval measures, and their SQL.

Queries are the distinct questions of ``qac_items``, the corpus is ``passages``. Vectors have no text of their own:
passage p stands for vector p and item n for vector n modulo the number of vectors, a convention of the test data.
``synthetic_*`` columns are formulas that stand for model outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import act_filter as wanted_act
from corpusloom.functions.text import act_passes, article_id
from corpusloom.operators import measures as M
from corpusloom.operators import retrieval as R
from corpusloom.plans.text_queries import _TOK
from corpusloom.sources.tables import table


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Distinct items with a question: query_id, query, query_type."""
    q = table(spark, d, "qac_items").filter("item_id IS NOT NULL AND question IS NOT NULL")
    return q.groupBy(F.col("item_id").alias("query_id")).agg(F.min("question").alias("query"), F.min("query_type").alias("query_type"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").select("corpus_pos", "passage_id", "text", "title", "parent_id", "act_name", "metadata")


def _lexical(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return R.bm25_topk(table(spark, d, "passages").select("corpus_pos", "text"), _queries(spark, d).select("query_id", "query"), k)


def _with_passage(hits: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return hits.join(_passages(spark, d), "corpus_pos")


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per term of the corpus: passages, occurrences and idf."""
    p = _passages(spark, d)
    tf = R.postings(p).groupBy("term").agg(F.sum("tf").alias("n_tokens"))
    return R.term_stats(p).join(tf, "term").select("term", "df", "n_tokens", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("query_id", "corpus_pos", "score", "rank")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Cosine top 10 for every vector whose id is divisible by 20, against all vectors."""
    v = table(spark, d, "embeddings")
    hits = R.vector_topk(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return hits.select("query_id", "vec_id", "score", "rank")


def vector_label_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the top 10 that have the query's label, by label."""
    v = table(spark, d, "embeddings")
    hits = R.vector_topk(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    own = v.select(F.col("vec_id").alias("query_id"), "label")
    j = hits.join(own, "query_id").join(v.select("vec_id", F.col("label").alias("found")), "vec_id")
    return j.groupBy("label").agg(F.count_distinct("query_id").alias("n_queries"), F.round(F.avg(F.when(F.col("label") == F.col("found"), 1.0).otherwise(0.0)), 6).alias("precision_10"))


def act_filter(spark: SparkSession, d: str) -> DataFrame:
    """The lexical hits that pass the act which their question means."""
    h = _with_passage(_lexical(spark, d), spark, d).join(_queries(spark, d), "query_id")
    return h.filter(act_passes(wanted_act(F.col("query")), F.col("act_name"))).select("query_id", "corpus_pos", "rank")


def temporal_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.temporal_filter(_passages(spark, d), 2005).select("corpus_pos", "passage_id")


def exact_boost(spark: SparkSession, d: str) -> DataFrame:
    hits = R.boosted(_queries(spark, d), _passages(spark, d), _lexical(spark, d, 100))
    return hits.select("query_id", "corpus_pos", "exact_match", "rank")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    n = v.count()
    number = F.regexp_extract("query_id", "(\\d+)$", 1).cast("bigint")
    asked = _queries(spark, d).select("query_id", F.pmod(F.coalesce(number, F.lit(0)), F.lit(n)).alias("asked"))
    # one search per vector, not per question that has it
    wanted = v.join(asked.select("asked").distinct(), F.col("vec_id") == F.col("asked")).select(F.col("asked").alias("query_id"), "embedding")
    near = R.vector_topk(v, wanted, 20).select(F.col("query_id").alias("asked"), F.col("vec_id").alias("corpus_pos"), "score", "rank")
    hits = asked.join(near, "asked").drop("asked")
    q = _queries(spark, d).select("query_id", wanted_act(F.col("query")).alias("wanted"))
    h = hits.join(_passages(spark, d).select("corpus_pos", "passage_id", "act_name"), "corpus_pos").join(q, "query_id")
    return h.filter(act_passes(F.col("wanted"), F.col("act_name"))).select("query_id", "corpus_pos", "passage_id", "score")


def _fused(spark: SparkSession, d: str, lexical: DataFrame | None = None) -> DataFrame:
    return R.fuse(R.boosted(_queries(spark, d), _passages(spark, d), lexical or _lexical(spark, d, 100)), _dense(spark, d))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "passage_id", F.round("bm25_score", 4).alias("bm25_score"), F.round("dense_score", 4).alias("dense_score"), F.round("score", 4).alias("score"))


def reranked(spark: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    """The fused hits by a synthetic logit and their fused score; texts are looked at before they meet the hits."""
    r, c = R.signs(F.col("text"))
    f = fused.join(_queries(spark, d).select("query_id", "query"), "query_id").join(_passages(spark, d).select("corpus_pos", r.alias("r"), c.alias("c")), "corpus_pos")
    logit = ((F.col("corpus_pos") * 37 + F.length("query_id") * 11) % 200) / 20.0 - 5.0
    return R.rerank_blend(f.withColumn("rerank_score", R.adjusted(logit, F.col("query"), F.col("r"), F.col("c"))))


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d, _fused(spark, d)).select("query_id", "passage_id", "exact_match", F.round("final_score", 4).alias("final_score"))


def parent_context(spark: SparkSession, d: str) -> DataFrame:
    h = R.with_parent_title(_with_passage(_lexical(spark, d), spark, d), _passages(spark, d))
    return h.select("query_id", "corpus_pos", "parent_context_added", F.md5("text").alias("text_hash"))


def cross_reference(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_references(_with_passage(_lexical(spark, d), spark, d), _passages(spark, d)).select("query_id", "corpus_pos", F.round("score", 4).alias("score"))


def article_dedup(spark: SparkSession, d: str) -> DataFrame:
    h = _lexical(spark, d).join(_passages(spark, d).select("corpus_pos", "passage_id"), "corpus_pos")
    return R.article_dedup(h).select("query_id", "corpus_pos", "article_id", "rank")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "qac_items").select(F.col("item_id").alias("query_id"), F.explode("relevant_passages").alias("p"))
    return g.filter("trim(p) <> ''").select("query_id", article_id(F.col("p")).alias("key")).distinct()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    h = R.article_dedup(_lexical(spark, d).join(_passages(spark, d).select("corpus_pos", "passage_id"), "corpus_pos")).select("query_id", F.col("article_id").alias("key"), "rank")
    return M.retrieval_scores(h, _gold(spark, d)).join(_queries(spark, d).select("query_id", "query_type"), "query_id")


_NAMES = ["mrr", *[f"{m}_{k}" for m in ("recall", "precision", "ndcg") for k in (5, 10, 20)]]


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision, NDCG and reciprocal rank of the lexical search at article level, per query type: mean and deviation."""
    return M.summarize(_scores(spark, d), ["query_type"], _NAMES)


def ndcg_compat(spark: SparkSession, d: str) -> DataFrame:
    """Tie-averaged NDCG at 10 per item, with ideal gains as truth; for comparison only, a miss is not 0."""
    h = R.article_dedup(_lexical(spark, d).join(_passages(spark, d).select("corpus_pos", "passage_id"), "corpus_pos")).select("query_id", F.col("article_id").alias("key"), "rank")
    g = _gold(spark, d)
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_gold"))
    hit = h.filter("rank <= 10").join(g, ["query_id", "key"]).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))  # at most 10 each
    j = n.join(hit, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    # the retrieved list is 1 at its hits: hits form the upper group of ties, whatever their ranks
    return j.select("query_id", F.round(M.tie_averaged_ndcg(F.col("ranks"), F.col("n_gold"), 10), 6).alias("ndcg_compat_10"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Per item: precision, recall and F1 of the cited passages of its gold answers against its relevant passages."""
    c = table(spark, d, "qac_items").select("item_id", F.explode("gold_answers").alias("g")).select("item_id", F.explode("g.citations").alias("c")).select("item_id", F.col("c.passage_id").alias("p"))
    g = table(spark, d, "qac_items").select("item_id", F.explode("relevant_passages").alias("p"))
    both = c.filter("p IS NOT NULL").distinct().withColumn("cited", F.lit(1)).join(g.filter("p IS NOT NULL").distinct().withColumn("gold", F.lit(1)), ["item_id", "p"], "full")
    s = both.groupBy("item_id").agg(F.count("cited").alias("n_cited"), F.count("gold").alias("n_gold"), F.sum(F.when(F.col("cited").isNotNull() & F.col("gold").isNotNull(), 1).otherwise(0)).alias("tp"))
    p, r = M.ratio(F.col("tp"), F.col("n_cited")), M.ratio(F.col("tp"), F.col("n_gold"))
    return s.select("item_id", "n_cited", "n_gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(M.f1(p, r), 6).alias("f1"))


def best_passage(spark: SparkSession, d: str) -> DataFrame:
    """The passage that stands best for each article: the article itself, its first chunk, its first subsection, else the first by name."""
    p = _passages(spark, d).filter("passage_id IS NOT NULL").select("passage_id", article_id(F.col("passage_id")).alias("article_id")).distinct()
    a = F.col("article_id")
    pref = F.when(F.col("passage_id") == a, 0).when(F.col("passage_id") == F.concat(a, F.lit("_CHUNK_0")), 1).when(F.col("passage_id") == F.concat(a, F.lit("_SUBSEC_1_CHUNK_0")), 2).when(F.col("passage_id") == F.concat(a, F.lit("_SUBSEC_1")), 3).otherwise(4)
    return p.groupBy("article_id").agg(F.min_by("passage_id", F.struct(pref, "passage_id")).alias("passage_id"))


def chapter_asof(spark: SparkSession, d: str) -> DataFrame:
    """The chapter of each article as the last chapter that starts before it, in its edition; chapters start at their first article."""
    a = table(spark, d, "constitution_articles").select("edition", "article_id", "chapter", "start_pos").distinct()
    starts = a.filter("chapter IS NOT NULL").groupBy("edition", "chapter").agg(F.min("start_pos").alias("start_pos"))
    rows = a.select("edition", "article_id", "start_pos", F.lit(None).cast("string").alias("chapter"), F.lit(1).alias("kind")).unionByName(starts.select("edition", F.lit(None).cast("string").alias("article_id"), "start_pos", "chapter", F.lit(0).alias("kind")))
    w = W.partitionBy("edition").orderBy("start_pos", "kind", "chapter").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("current", F.last("chapter", ignorenulls=True).over(w)).filter("kind = 1").select("edition", "article_id", "start_pos", F.col("current").alias("chapter"))


QUERIES = {f.__name__: f for f in (postings_stats, bm25_topk, vector_topk, vector_label_recall, act_filter, temporal_filter, exact_boost, hybrid_fusion, hybrid_rerank, parent_context, cross_reference, article_dedup, retrieval_eval, ndcg_compat, attribution, best_passage, chapter_asof)}

_WANTED = """CASE WHEN regexp_matches(lower(query), '\\bconstitution\\b') THEN '' WHEN regexp_matches(lower(query), '\\bpenal\\s+code\\b') THEN 'Penal Code' WHEN regexp_matches(lower(query), '\\bcivil\\s+procedure\\s+code\\b') THEN 'Civil Procedure Code'
  WHEN regexp_matches(lower(query), '\\bevidence\\s+ordinance\\b') THEN 'Evidence Ordinance' WHEN regexp_matches(lower(query), '\\bcriminal\\s+procedure\\s+code\\b') THEN 'Criminal Procedure Code'
  WHEN regexp_matches(lower(query), 'article\\s+\\d+') AND NOT regexp_matches(lower(query), '\\bsection\\b') THEN '' END"""
_PASS = "({w} IS NULL OR CASE WHEN {w} = '' THEN coalesce({a}, '') = '' OR contains(lower({a}), 'constitution') ELSE contains(lower(coalesce({a}, '')), lower({w})) END)"
_BASE = f"""
WITH q AS (SELECT item_id AS query_id, min(question) AS query, min(query_type) AS query_type FROM qac_items WHERE item_id IS NOT NULL AND question IS NOT NULL GROUP BY 1),
qw AS (SELECT *, {_WANTED} AS wanted FROM q),
tok AS (SELECT corpus_pos, {_TOK.format(c='text')} AS t FROM passages),
post AS (SELECT corpus_pos, term, count(*) AS tf FROM (SELECT corpus_pos, unnest(t) AS term FROM tok) GROUP BY 1, 2),
cs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
ts0 AS (SELECT term, count(*) AS df, sum(tf) AS n_tokens, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, cs GROUP BY term),
ts AS (SELECT term, df, n_tokens, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ts0) ELSE raw END AS idf FROM ts0),
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({_TOK.format(c='query')}) AS term FROM q) GROUP BY 1, 2),
sc AS (SELECT query_id, corpus_pos, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) AS s FROM qt JOIN ts USING (term) JOIN post USING (term) JOIN tok USING (corpus_pos), cs GROUP BY 1, 2),
allhits AS (SELECT query_id, corpus_pos, round(coalesce(s, 0), 6) AS score FROM q CROSS JOIN (SELECT corpus_pos FROM passages) LEFT JOIN sc USING (query_id, corpus_pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos)::INT AS rank FROM allhits),
hits AS (SELECT * FROM ranked WHERE rank <= 20),
pas AS (SELECT corpus_pos, passage_id, text, title, parent_id, act_name, trim(coalesce(metadata.section_number, '')) AS sec, trim(coalesce(CASE WHEN trim(metadata.article_number) <> '' THEN metadata.article_number END, metadata.section_number, '')) AS art, metadata FROM passages),
dd AS (SELECT query_id, corpus_pos, article_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM (
  SELECT query_id, corpus_pos, rank, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') AS article_id, row_number() OVER (PARTITION BY query_id, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') ORDER BY rank) AS n FROM hits JOIN pas USING (corpus_pos)) WHERE n = 1),
gold AS (SELECT DISTINCT query_id, regexp_replace(p, '_(CHUNK|SUBSEC)_.*$', '') AS key FROM (SELECT item_id AS query_id, unnest(relevant_passages) AS p FROM qac_items) WHERE trim(p) <> '')
"""
_EXACT = f""",
na AS (SELECT query_id, wanted, unnest(range(len(a))) AS no, unnest(a) AS num FROM (SELECT query_id, wanted, list_sort(list_distinct(regexp_extract_all(query, 'Article\\s+(\\d+[A-Z]?)', 1, 'i'))) AS a FROM qw)),
ex1 AS (SELECT query_id, no, num, corpus_pos, passage_id, 1000.0 AS score FROM na JOIN pas ON na.num = pas.art WHERE {_PASS.format(w='wanted', a='act_name')}),
ex2 AS (SELECT DISTINCT query_id, no, num, corpus_pos, passage_id, 900.0 FROM (SELECT * FROM na WHERE (query_id, no) NOT IN (SELECT (query_id, no) FROM ex1)) n JOIN (SELECT corpus_pos, passage_id, act_name, unnest(regexp_extract_all(left(text, 200), '(?im)(?:^|chapter[^0-9]+)\\s*(\\d+[A-Z]?)\\.\\s', 1)) AS o FROM pas) p ON lower(n.num) = lower(p.o) WHERE {_PASS.format(w='wanted', a='act_name')}),
ex3 AS (SELECT query_id, 0, num, corpus_pos, passage_id, 950.0 FROM (SELECT query_id, wanted, regexp_extract(query, 'section\\s+(\\d+[A-Z]?)', 1, 'i') AS num FROM qw WHERE NOT regexp_matches(query, 'article\\s+\\d', 'i')) n JOIN pas ON n.num <> '' AND n.num = pas.sec WHERE {_PASS.format(w='wanted', a='act_name')}),
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY no, corpus_pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY no, corpus_pos) AS n FROM (SELECT * FROM ex1 UNION ALL SELECT * FROM ex2 UNION ALL SELECT * FROM ex3)) WHERE n = 1),
pool AS (SELECT r.query_id, r.corpus_pos, passage_id, r.score, r.rank FROM ranked r JOIN qw USING (query_id) JOIN pas USING (corpus_pos)
  WHERE r.rank <= CASE WHEN regexp_matches(query, '(article|section)\\s+\\d', 'i') THEN 60 ELSE 100 END
    AND ((NOT regexp_matches(query, 'article\\s+\\d', 'i') AND regexp_matches(query, 'section\\s+\\d', 'i')) OR {_PASS.format(w='wanted', a='act_name')})
    AND (r.query_id, passage_id) NOT IN (SELECT (query_id, passage_id) FROM ex)),
boost AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, o)::INT AS rank FROM (
  SELECT query_id, corpus_pos, passage_id, score, true AS exact_match, place AS o FROM ex UNION ALL SELECT query_id, corpus_pos, passage_id, score, false, rank FROM pool)) WHERE rank <= 20)
"""
_FUSE = f""",
un AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
dq AS (SELECT query_id, wanted, v FROM (SELECT query_id, wanted, coalesce(try_cast(regexp_extract(query_id, '(\\d+)$', 1) AS BIGINT), 0) % (SELECT count(*) FROM embeddings) AS vec_id FROM qw) JOIN un USING (vec_id)),
dn0 AS (SELECT query_id, wanted, vec_id AS corpus_pos, round(list_inner_product(dq.v, un.v), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(dq.v, un.v), 6) DESC, vec_id) AS rank FROM dq CROSS JOIN un),
dn AS (SELECT query_id, corpus_pos, passage_id, score FROM dn0 JOIN pas USING (corpus_pos) WHERE rank <= 20 AND {_PASS.format(w='wanted', a='act_name')}),
fa AS (SELECT query_id, passage_id, max(s) AS bm25_score, bool_or(exact_match) AS exact_match, min(corpus_pos) AS pa FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-6 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM boost WINDOW w AS (PARTITION BY query_id)) GROUP BY 1, 2),
fb AS (SELECT query_id, passage_id, max(s) AS dense_score, min(corpus_pos) AS pb FROM (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-6 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM dn WINDOW w AS (PARTITION BY query_id)) GROUP BY 1, 2),
fu0 AS (SELECT query_id, passage_id, coalesce(pa, pb) AS corpus_pos, coalesce(exact_match, false) AS exact_match, coalesce(bm25_score, 0.0) AS bm25_score, coalesce(dense_score, 0.0) AS dense_score, round(0.5 * coalesce(bm25_score, 0.0) + 0.5 * coalesce(dense_score, 0.0), 9) AS score FROM fa FULL JOIN fb USING (query_id, passage_id)),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_pos) AS rank FROM fu0) WHERE rank <= 20)
"""


def _signs(words: list[str]) -> str:
    return "(" + " + ".join("contains(t, '" + w.replace("'", "''") + "')::INT" for w in words) + ")"


_K = (5, 10, 20)
_DCG = "coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= {k}), 0)"
_IDCG = "list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda i: 1 / log2(i + 1.0)))"
_EVAL = f"""SELECT query_type, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std' for m in _NAMES)} FROM (
  SELECT query_type, coalesce(1.0 / first, 0.0) AS mrr, {', '.join(f'round(h{k} / n_gold, 6) AS recall_{k}, round(h{k} / {k}, 6) AS precision_{k}, round(d{k} / {_IDCG.format(k=k)}, 6) AS ndcg_{k}' for k in _K)}
  FROM (SELECT query_id, query_type, count(*) AS n_gold, min(rank) AS first, {', '.join(f"count(*) FILTER (rank <= {k}) AS h{k}, {_DCG.format(k=k)} AS d{k}" for k in _K)}
    FROM gold JOIN q USING (query_id) LEFT JOIN (SELECT query_id, article_id AS key, rank FROM dd) USING (query_id, key) GROUP BY 1, 2)) GROUP BY 1"""
SQL = {
    "postings_stats": _BASE + "SELECT term, df, n_tokens::BIGINT AS n_tokens, round(idf, 6) AS idf FROM ts",
    "bm25_topk": _BASE + "SELECT query_id, corpus_pos, score, rank FROM hits",
    "vector_topk": """WITH un AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
      SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM un a CROSS JOIN un b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10""",
    "vector_label_recall": """WITH un AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, a.label, b.vec_id, b.label AS found, round(list_inner_product(a.v, b.v), 6) AS score FROM un a CROSS JOIN un b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10)
      SELECT label, count(DISTINCT query_id) AS n_queries, round(avg((label = found)::INT), 6) AS precision_10 FROM h GROUP BY 1""",
    "act_filter": _BASE + f"SELECT query_id, corpus_pos, rank FROM hits JOIN qw USING (query_id) JOIN pas USING (corpus_pos) WHERE {_PASS.format(w='wanted', a='act_name')}",
    "temporal_filter": "SELECT corpus_pos, passage_id FROM passages WHERE NOT coalesce(metadata.is_repealed, false) AND (try_cast(left(metadata.enactment_date, 4) AS INT) IS NULL OR try_cast(left(metadata.enactment_date, 4) AS INT) <= 2005)",
    "exact_boost": _BASE + _EXACT + "SELECT query_id, corpus_pos, exact_match, rank FROM boost",
    "hybrid_fusion": _BASE + _EXACT + _FUSE + "SELECT query_id, passage_id, round(bm25_score, 4) AS bm25_score, round(dense_score, 4) AS dense_score, round(score, 4) AS score FROM fu",
    "hybrid_rerank": _BASE + _EXACT + _FUSE + f""",
      lg AS (SELECT fu.*, lower(query) AS lq, lower(coalesce(text, '')) AS t, ((fu.corpus_pos * 37 + length(query_id) * 11) % 200) / 20.0 - 5.0 AS l FROM fu JOIN q USING (query_id) JOIN pas ON pas.corpus_pos = fu.corpus_pos),
      ad AS (SELECT *, {_signs(R.RESTRICTION_SIGNS)} AS r, {_signs(R.CONTENT_SIGNS)} AS c FROM lg),
      rs AS (SELECT *, CASE WHEN NOT regexp_matches(lq, '{'|'.join(R.DEFINITION_SIGNS)}') THEN l WHEN r > c AND r >= 2 THEN l * 0.7 WHEN c >= 2 AND c > r THEN l * 1.15 ELSE l END AS rr FROM ad)
      SELECT query_id, passage_id, exact_match, round(CASE WHEN exact_match THEN score ELSE round(
        0.7 * (rr - min(rr) OVER w) / CASE WHEN max(rr) OVER w > min(rr) OVER w THEN max(rr) OVER w - min(rr) OVER w ELSE 1 END
        + 0.3 * (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END, 9) END, 4) AS final_score FROM rs WINDOW w AS (PARTITION BY query_id, exact_match)""",
    "parent_context": _BASE + """SELECT query_id, corpus_pos, added AS parent_context_added, md5(CASE WHEN added THEN '[' || pt || ']' || chr(10) || text ELSE text END) AS text_hash FROM (
      SELECT query_id, h.corpus_pos, text, pt, coalesce(pt, '') <> '' AND NOT contains(coalesce(left(text, 50), ''), coalesce(pt, '')) AS added
      FROM hits h JOIN pas USING (corpus_pos) LEFT JOIN (SELECT passage_id AS pid, arg_max_null(title, corpus_pos) AS pt FROM pas GROUP BY 1) par ON pas.parent_id = par.pid)""",
    "cross_reference": _BASE + """,
      rf AS (SELECT query_id, rank, score, coalesce(act_name, '') AS act, unnest(range(len(l))) AS no, unnest(l) AS ref FROM (SELECT query_id, rank, score, act_name, regexp_extract_all(coalesce(text, ''), '[Ss]ection\\s+(\\d+[A-Z]?)', 1)[1:3] AS l FROM hits JOIN pas USING (corpus_pos) WHERE rank <= 3)),
      rn AS (SELECT *, row_number() OVER (PARTITION BY query_id, act, ref ORDER BY rank, no) AS nth FROM rf),
      tg AS (SELECT passage_id, first_pos, p.corpus_pos AS corpus_pos, coalesce(p.act_name, '') AS act, coalesce(nullif(p.metadata.section_number, ''), p.metadata.article_number) AS ref FROM (SELECT passage_id, min(corpus_pos) AS first_pos, arg_max({'corpus_pos': corpus_pos, 'act_name': act_name, 'metadata': metadata}, corpus_pos) AS p FROM pas GROUP BY 1)),
      cd AS (SELECT *, row_number() OVER (PARTITION BY query_id, act, ref ORDER BY first_pos) AS nth FROM (SELECT DISTINCT query_id, act, ref FROM rf) JOIN tg USING (act, ref) WHERE (query_id, passage_id) NOT IN (SELECT (query_id, passage_id) FROM hits JOIN pas USING (corpus_pos)))
      SELECT query_id, corpus_pos, round(round(score * 0.6, 9), 4) AS score FROM (SELECT query_id, cd.corpus_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, no) AS k FROM rn JOIN cd USING (query_id, act, ref, nth)) WHERE k <= 2""",
    "article_dedup": _BASE + "SELECT query_id, corpus_pos, article_id, rank FROM dd",
    "retrieval_eval": _BASE + _EVAL,
    "ndcg_compat": _BASE + """, g2 AS (SELECT query_id, count(*) AS n_gold, coalesce(list(rank ORDER BY rank) FILTER (rank <= 10), []) AS ranks FROM gold LEFT JOIN (SELECT query_id, article_id AS key, rank FROM dd) USING (query_id, key) GROUP BY 1),
      g3 AS (SELECT *, least(n_gold, 10) AS ones, len(ranks) AS m, len(list_filter(ranks, lambda r: r <= least(n_gold, 10))) AS up FROM g2)
      SELECT query_id, round((CASE WHEN m = 0 THEN 0 ELSE up / m * list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1.0))) END
        + CASE WHEN m = 10 THEN 0 ELSE (ones - up) / (10 - m) * list_sum(list_transform(range(m + 1, 11), lambda i: 1 / log2(i + 1.0))) END)
        / list_sum(list_transform(range(1, ones + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_compat_10 FROM g3""",
    "attribution": """WITH c AS (SELECT DISTINCT item_id, c.passage_id AS p FROM (SELECT item_id, unnest(g.citations) AS c FROM (SELECT item_id, unnest(gold_answers) AS g FROM qac_items)) WHERE c.passage_id IS NOT NULL),
      g AS (SELECT DISTINCT item_id, p FROM (SELECT item_id, unnest(relevant_passages) AS p FROM qac_items) WHERE p IS NOT NULL),
      s AS (SELECT item_id, count(c.p) AS n_cited, count(g.p) AS n_gold, count(*) FILTER (c.p IS NOT NULL AND g.p IS NOT NULL) AS tp FROM c FULL JOIN g USING (item_id, p) GROUP BY 1)
      SELECT item_id, n_cited, n_gold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1
      FROM (SELECT *, CASE WHEN n_cited = 0 THEN 0.0 ELSE tp / n_cited END AS pr, CASE WHEN n_gold = 0 THEN 0.0 ELSE tp / n_gold END AS rc FROM s)""",
    "best_passage": """SELECT article_id, arg_min(passage_id, {'a': CASE WHEN passage_id = article_id THEN 0 WHEN passage_id = article_id || '_CHUNK_0' THEN 1 WHEN passage_id = article_id || '_SUBSEC_1_CHUNK_0' THEN 2 WHEN passage_id = article_id || '_SUBSEC_1' THEN 3 ELSE 4 END, 'b': passage_id}) AS passage_id
      FROM (SELECT DISTINCT passage_id, regexp_replace(passage_id, '_(CHUNK|SUBSEC)_.*$', '') AS article_id FROM passages WHERE passage_id IS NOT NULL) GROUP BY 1""",
    "chapter_asof": """SELECT a.edition, a.article_id, a.start_pos, c.chapter FROM (SELECT DISTINCT edition, article_id, start_pos FROM constitution_articles) a
      ASOF LEFT JOIN (SELECT edition, chapter, min(start_pos) AS start_pos FROM constitution_articles WHERE chapter IS NOT NULL GROUP BY 1, 2) c ON a.edition = c.edition AND a.start_pos >= c.start_pos""",
}
