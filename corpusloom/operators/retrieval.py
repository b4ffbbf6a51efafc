"""Index tables, exact top-k search in query blocks, exact-reference boosting, fusion, reranking and expansions.

Scoring a query set against all rows is done block by block: every task scores a block of queries (bounded by ``block``) against
slices of its rows, by a matrix product for vectors and by lists of passages per term for texts, keeping the best k per query;
the best of those few rows are the exact top-k. Rows are read once per block and never shuffled. More than one block is materialised
block by block, so the driver holds one block at a time. Ties go to the smaller row id; scores count to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import act_filter, act_passes, article_references, has_any, tokens
from corpusloom.session import materialize

BLOCK = 4096
SLICE = 512
#: Hits that a task of the lexical search holds for a block of queries, and numbers that it holds for a slice of passages.
ROOM = 1 << 22
CELLS = 1 << 23
#: Passages scored at once, and the share of them from which a term gets a row of numbers instead of a list of passages.
CHUNK = 1 << 14
COMMON = 1 / 16


def postings(passages: DataFrame, pos: str = "corpus_pos", text: str = "text") -> DataFrame:
    """(term, pos, tf) of every passage; null and empty texts have no postings."""
    return passages.select(pos, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", pos).agg(F.count(F.lit(1)).cast("int").alias("tf"))


def term_stats(passages: DataFrame, pos: str = "corpus_pos", text: str = "text", epsilon: float = 0.25, n: int | None = None) -> DataFrame:
    """(term, df, idf): idf = ln((n - df + 0.5) / (df + 0.5)); negative ones become ``epsilon`` times the mean of all."""
    n = passages.count() if n is None else n
    df = passages.select(pos, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best columns of each row, ties to the smaller id."""
    s = np.round(score, 6)
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        q, j = np.nonzero(s >= least[:, None])
    else:
        q, j = np.nonzero(np.ones_like(s, bool))
    at = ids[j] if ids.ndim == 1 else ids[q, j]
    order = np.lexsort((at, -s[q, j], q))
    q, at, v = q[order], at[order], s[q, j][order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = (rank < k) & np.isfinite(v)
    return q[keep], at[keep], v[keep]


def _search(rows: DataFrame, matrix: Callable[[pd.DataFrame], np.ndarray], queries: list, weights: np.ndarray, k: int, id_type: str, query_type: str) -> DataFrame:
    """rows: id and what ``matrix`` turns into one row of numbers each; weights: one row per query."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((queries, weights))
    if rows.rdd.getNumPartitions() < sc.defaultParallelism:
        rows = rows.repartition(sc.defaultParallelism)  # a small file would be one task; a large table is not shuffled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, w = shared.value
        ids, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for b in batches:
            for lo in range(0, len(b), SLICE):
                part = b.iloc[lo : lo + SLICE]
                score = np.concatenate([best, w @ matrix(part).T], 1)
                at = np.concatenate([ids, np.broadcast_to(part.id.to_numpy(np.int64), (len(names), len(part)))], 1)
                q, i, v = _best(score, at, k)
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                ids, best = np.full((len(names), k), -1, np.int64), np.full((len(names), k), -np.inf)
                ids[q, rank], best[q, rank] = i, v
        q, j = np.nonzero(np.isfinite(best))
        if len(q):
            yield pd.DataFrame({"query_id": [names[x] for x in q], "id": ids[q, j], "score": best[q, j]})

    return rows.mapInPandas(run, f"query_id {query_type}, id {id_type}, score double")


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    if len(parts) > 1:
        parts = [materialize(p) for p in parts]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_topk(passages: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, block: int | None = None) -> DataFrame:
    """(query_id, corpus_pos, score, rank): the k best passages of each query; zero scores fill up, so every query gets k.

    passages: corpus_pos bigint, text; queries: query_id, query. A term that a query repeats counts repeatedly. A
    query without known terms gets the first passages with score 0. Null texts are empty passages. Without passages
    or queries the result is empty. Queries with the same terms are scored once.
    """
    docs = passages.select(F.col("corpus_pos").alias("id"), tokens(F.col("text")).alias("t"))
    total, avgdl = docs.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    avgdl = avgdl or 1.0
    named = queries.select("query_id", F.array_join(F.array_sort(tokens(F.col("query"))), " ").alias("bag"))
    bags = named.select("bag").distinct()
    asked = bags.select("bag", F.explode_outer(F.filter(F.split("bag", " "), lambda w: w != "")).alias("term")).groupBy("bag", "term").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(term_stats(passages, n=total).select("term", "df", "idf"), "term", "left")
    blocks = max(1, -(-bags.count() // (block or max(1, ROOM // max(1, k)))))
    if blocks > 1:
        asked = materialize(asked)
    parts = []
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("bag"), F.lit(blocks)) == i).toPandas().sort_values(["bag", "term"], ignore_index=True)
        # as many queries as their terms have room for
        part = (np.arange(len(rows)) // ROOM)[np.searchsorted(rows.bag.to_numpy(), rows.bag.to_numpy())] if len(rows) else np.zeros(0, int)
        for j in np.unique(part) if len(rows) else [0]:
            parts.append(_bm25_block(docs, rows[part == j], total, k, k1, b, avgdl))
    if len(parts) > 1:
        parts = [materialize(p) for p in parts]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    hits = named.join(found, "bag").select("query_id", F.posexplode("hits").alias("rank", "h"))
    return hits.select("query_id", F.col("h.id").alias("corpus_pos"), (-F.col("h.less")).alias("score"), (F.col("rank") + 1).alias("rank"))


def _bm25_block(docs: DataFrame, rows: pd.DataFrame, total: int, k: int, k1: float, b: float, avgdl: float) -> DataFrame:
    """(bag, hits): the k best passages of each query as structs of the negative score and the id, best first.

    Common terms have a score for every passage of a slice, added up once for all queries that share them; the others add to
    the passages that hold them. A passage is ranked only if it reaches the k best so far.
    """
    sc = docs.sparkSession.sparkContext
    known = rows.dropna(subset=["term", "idf"])
    known = known[known.idf != 0]
    common = known.df > COMMON * total
    terms = sorted(known.term[common].unique()) + sorted(known.term[~common].unique())
    n_common, number = int(known.term[common].nunique()), {t: j for j, t in enumerate(terms)}
    groups: dict[tuple, list] = {}
    own = {bag: ([], []) for bag in rows.bag}
    for bag, t, w, c in zip(known.bag, known.term, known.n * known.idf, common):
        own[bag][0 if c else 1].append((number[t], w))
    for bag, (often, rare) in own.items():
        groups.setdefault(tuple(often), []).append((bag, rare))
    shared = sc.broadcast((number, n_common, list(groups.items())))
    if docs.rdd.getNumPartitions() < sc.defaultParallelism:
        docs = docs.repartition(sc.defaultParallelism)  # a small file would be one task; a large table is not shuffled
    size = max(1, min(CHUNK, CELLS // max(1, n_common)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids in ascending order, lengths, and place and term of every known token, of up to ``size`` passages."""
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                piece = batch.slice(lo, size)
                if n and n + piece.num_rows > size:
                    yield joined(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        number = shared.value[0]
        t = pa.Table.from_batches(held).combine_chunks()
        words = t.column("t").chunk(0)
        ids, length = t.column("id").to_numpy(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        d = words.flatten().dictionary_encode()
        term = np.array([number.get(w, -1) for w in d.dictionary.to_pylist()] or [-1], np.int64)[d.indices.to_numpy()] if len(d) else np.zeros(0, np.int64)
        at = np.repeat(place, length)
        return ids[order], length[order], at[term >= 0], term[term >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n_common, groups = shared.value
        n_queries = sum(len(g) for _, g in groups)
        best_id, best = np.zeros((n_queries, k), np.int64), np.full((n_queries, k), -np.inf)
        filled = np.zeros(n_queries, np.int64)
        for ids, length, at, term in chunks(batches):
            n = len(ids)
            pair, tf = np.unique(term * n + at, return_counts=True)
            term, at = pair // n, pair % n
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / avgdl))
            bound = np.searchsorted(term, np.arange(len(number) + 1))
            full = np.zeros((n_common, n))
            m = bound[n_common]
            full[term[:m], at[:m]] = value[:m]
            q = -1
            for often, members in groups:
                base = np.zeros(n)
                for t, w in often:
                    base += w * full[t]
                for _, rare in members:
                    q += 1
                    score = base.copy()
                    for t, w in rare:
                        lo, hi = bound[t], bound[t + 1]
                        if lo < hi:
                            score[at[lo:hi]] += w * value[lo:hi]
                    f = filled[q]
                    if f < k:
                        c = np.arange(n)
                    else:
                        c = np.flatnonzero(score >= best[q, k - 1] - 1e-6)
                        if not len(c):
                            continue
                    s = np.round(score[c], 6)
                    if f == k:
                        # a later id does not replace an equal score
                        c_in = (s > best[q, k - 1]) | ((s == best[q, k - 1]) & (ids[c] < best_id[q, k - 1]))
                        c, s = c[c_in], s[c_in]
                    if len(c) > 2 * k:
                        least = -np.partition(-s, k - 1)[k - 1]
                        keep = s > least
                        keep[np.flatnonzero(s == least)[: k - np.count_nonzero(keep)]] = True
                        c, s = c[keep], s[keep]
                    if len(c):
                        s, i = np.concatenate([best[q, :f], s]), np.concatenate([best_id[q, :f], ids[c]])
                        order = np.lexsort((i, -s))[:k]
                        f = filled[q] = len(order)
                        best[q, :f], best_id[q, :f] = s[order], i[order]
        names = [bag for _, g in groups for bag, _ in g]
        for lo in range(0, n_queries if filled.any() else 0, 4096):
            f = filled[lo : lo + 4096]
            inside = np.arange(k) < f[:, None]
            flat = pa.StructArray.from_arrays([pa.array(-best[lo : lo + 4096][inside]), pa.array(best_id[lo : lo + 4096][inside])], ["less", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 4096], pa.string()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(f)]), pa.int32()), flat)], ["bag", "hits"])

    found = docs.mapInArrow(run, "bag string, hits array<struct<less:double,id:bigint>>")
    return found.groupBy("bag").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def unit(v: Column) -> Column:
    """A vector divided by its length; the zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine top-k. vectors: vec_id bigint, embedding; queries: query_id, embedding.

    Null embeddings match nothing; all others must have one length. A zero vector has score 0 with everything.
    """
    rows = vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v"))
    asked = queries.filter("embedding IS NOT NULL").select("query_id", unit(F.col("embedding")).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for i in range(blocks):
        q = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas().sort_values("query_id")
        weights = np.stack(q.v.tolist()) if len(q) else np.zeros((0, 1))
        parts.append(_search(rows, lambda part: np.stack(part.v.tolist()), q.query_id.tolist(), weights, k, "bigint", dict(queries.dtypes)["query_id"]))
    return _ranked(parts, k).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def min_max(score: Column, by: W, tie: float = 1.0) -> Column:
    """Scores scaled to [0, 1] within the window; ``tie`` where they differ by less than 1e-6."""
    lo, hi = F.min(score).over(by), F.max(score).over(by)
    return F.when(hi - lo < 1e-6, F.lit(tie)).otherwise((score - lo) / (hi - lo))


def exact_matches(queries: DataFrame, passages: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, corpus_pos, passage_id, score, place): passages that a query names by article (1000; 900 by their first
    words where no number matches) or, without an article, by its first section (950). One row per query and passage_id.

    Passages are looked up once for all queries that name the same number and mean the same act. With ``most`` only the first
    ``most`` of each query are returned; of each of its numbers no more are needed for that.
    """
    p = passages.select("corpus_pos", "passage_id", "act_name", F.trim(F.coalesce("metadata.section_number", F.lit(""))).alias("sec"), F.trim(F.coalesce(F.when(F.trim("metadata.article_number") != "", F.col("metadata.article_number")), "metadata.section_number", F.lit(""))).alias("art"), F.substring("text", 1, 200).alias("head"))
    q = queries.withColumn("wanted", act_filter(F.col("query"))).withColumn("arts", article_references(F.col("query")))
    named = q.select("query_id", "wanted", F.lit("art").alias("kind"), F.posexplode("arts").alias("no", "num"))
    sections = q.filter(F.size("arts") == 0).select("query_id", "wanted", F.lit("sec").alias("kind"), F.lit(0).alias("no"), F.regexp_extract("query", "(?i)section\\s+(\\d+[A-Z]?)", 1).alias("num")).filter("num <> ''")
    asked = named.unionByName(sections)
    key = ["wanted", "kind", "num"]
    keys = asked.select(*key).distinct()

    def first(found: DataFrame, score: float) -> DataFrame:
        """Each passage_id once per key, at its first place; of each key the first ``most``."""
        f = found.filter(act_passes(F.col("wanted"), F.col("act_name"))).groupBy(*key, "passage_id").agg(F.min("corpus_pos").alias("corpus_pos")).withColumn("score", F.lit(score))
        return f if most is None else f.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("corpus_pos"))).filter(F.col("n") <= most).drop("n")

    by_number = first(keys.filter("kind = 'art'").join(p, F.col("num") == F.col("art")), 1000.0)
    opened = p.select("corpus_pos", "passage_id", "act_name", F.explode(F.array_distinct(F.regexp_extract_all("head", F.lit("(?im)(?:^|chapter[^0-9]+)\\s*(\\d+[A-Z]?)\\.\\s"), F.lit(1)))).alias("opening"))
    got = by_number.select(F.col("wanted").alias("w"), F.col("num").alias("m")).distinct()
    unmatched = keys.filter("kind = 'art'").join(got, F.col("wanted").eqNullSafe(F.col("w")) & (F.col("num") == F.col("m")), "left_anti")
    by_text = first(unmatched.join(opened, F.lower("num") == F.lower("opening")), 900.0)
    by_section = first(keys.filter("kind = 'sec'").join(p, F.col("num") == F.col("sec")), 950.0)
    found = by_number.unionByName(by_text).unionByName(by_section).select(F.col("wanted").alias("w"), F.col("kind").alias("k"), F.col("num").alias("m"), "passage_id", "corpus_pos", "score")
    every = asked.join(found, F.col("wanted").eqNullSafe(F.col("w")) & (F.col("kind") == F.col("k")) & (F.col("num") == F.col("m")))
    one = every.withColumn("n", F.row_number().over(W.partitionBy("query_id", "passage_id").orderBy("no", "corpus_pos"))).filter("n = 1")
    out = one.select("query_id", "corpus_pos", "passage_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy("no", "corpus_pos")).alias("place"))
    return out if most is None else out.filter(F.col("place") <= most)


def boosted(queries: DataFrame, passages: DataFrame, hits: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, corpus_pos, passage_id, score, exact_match, rank): exact matches first, then lexical hits that are no exact match.

    ``hits`` holds the lexical top 5 k; 3 k of them are the pool of queries that name an article or section. Hits are
    filtered by act unless the query names a section without an article.
    """
    q = queries.select("query_id", act_filter(F.col("query")).alias("wanted"), (F.size(article_references(F.col("query"))) > 0).alias("has_art"), F.col("query").rlike("(?i)section\\s+\\d").alias("has_sec"))
    # with k exact matches no hit is left, with fewer all of them are here
    exact = exact_matches(queries, passages, k)
    pool = hits.join(q, "query_id").filter(F.col("rank") <= F.when(F.col("has_art") | F.col("has_sec"), 3 * k).otherwise(5 * k)).join(passages.select("corpus_pos", "passage_id", "act_name"), "corpus_pos")
    pool = pool.filter((~F.col("has_art") & F.col("has_sec")) | act_passes(F.col("wanted"), F.col("act_name"))).join(exact.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    both = exact.select("query_id", "corpus_pos", "passage_id", "score", F.lit(True).alias("exact_match"), F.col("place").alias("o")).unionByName(pool.select("query_id", "corpus_pos", "passage_id", "score", F.lit(False).alias("exact_match"), F.col("rank").alias("o")))
    w = W.partitionBy("query_id").orderBy(F.desc("exact_match"), "o")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("o")


def fuse(lexical: DataFrame, dense: DataFrame, alpha: float = 0.5, k: int = 20) -> DataFrame:
    """(query_id, passage_id, corpus_pos, exact_match, bm25_score, dense_score, score, rank): both scaled per query, merged by passage_id."""
    w = W.partitionBy("query_id")
    a = lexical.withColumn("s", min_max(F.col("score"), w)).groupBy("query_id", "passage_id").agg(F.max("s").alias("bm25_score"), F.bool_or("exact_match").alias("exact_match"), F.min("corpus_pos").alias("pa"))
    b = dense.withColumn("s", min_max(F.col("score"), w)).groupBy("query_id", "passage_id").agg(F.max("s").alias("dense_score"), F.min("corpus_pos").alias("pb"))
    j = a.join(b, ["query_id", "passage_id"], "full")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("bm25_score", "dense_score")}
    j = j.select("query_id", "passage_id", F.coalesce("pa", "pb").alias("corpus_pos"), F.coalesce("exact_match", F.lit(False)).alias("exact_match"), *[c.alias(n) for n, c in zero.items()])
    j = j.withColumn("score", F.round((1 - alpha) * F.col("bm25_score") + alpha * F.col("dense_score"), 9))
    return j.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "corpus_pos"))).filter(F.col("rank") <= k)


# What marks a question for a definition, a passage of restrictions and a passage of substance.
DEFINITION_SIGNS = ["what is", "what are", "what does", "define", "meaning of", "explain"]
RESTRICTION_SIGNS = ["shall be subject to", "restrictions", "prescribed by law", "subject to such", "may be restricted", "limitations", "shall not apply", "except", "provided that", "notwithstanding", "nothing in this section", "shall not be construed", "does not apply"]
CONTENT_SIGNS = ["means", "defined as", "includes", "shall mean", "entitled to", "guarantees", "recognizes", "every person", "any person", "person who", '"', "'"]


def intent_adjusted(logit: Column, query: Column, text: Column) -> Column:
    """Definition questions: 0.7 of the logit for passages of restrictions, 1.15 of it for passages of substance. The sign
    is kept, so a negative logit moves the other way."""
    return adjusted(logit, query, *signs(text))


def signs(text: Column) -> tuple[Column, Column]:
    """How many signs of restrictions and of substance a text holds."""
    t = F.lower(F.coalesce(text, F.lit("")))
    r, c = (sum([F.when(t.contains(s), 1).otherwise(0) for s in words], F.lit(0)) for words in (RESTRICTION_SIGNS, CONTENT_SIGNS))
    return r, c


def adjusted(logit: Column, query: Column, r: Column, c: Column) -> Column:
    """``intent_adjusted`` for counted signs."""
    q = F.lower(query)
    return F.when(~has_any(q, DEFINITION_SIGNS), logit).when((r > c) & (r >= 2), logit * 0.7).when((c >= 2) & (c > r), logit * 1.15).otherwise(logit)


def rerank_blend(fused: DataFrame, logit: str = "rerank_score", k: int = 20) -> DataFrame:
    """0.7 of the scaled logit and 0.3 of the scaled fused score; exact matches stay first in their order.

    Pools without spread scale to 0 here. Adds final_score (the fused score for exact matches) and final_rank.
    """
    w = W.partitionBy("query_id", "exact_match")

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)

    out = fused.withColumn("final_score", F.when(F.col("exact_match"), F.col("score")).otherwise(F.round(0.7 * scaled(logit) + 0.3 * scaled("score"), 9)))
    by = W.partitionBy("query_id").orderBy(F.desc("exact_match"), F.when(F.col("exact_match"), F.col("rank")), F.desc("final_score"), "corpus_pos")
    return out.withColumn("final_rank", F.row_number().over(by)).filter(F.col("final_rank") <= k)


def temporal_filter(passages: DataFrame, year: int | None, exclude_repealed: bool = True) -> DataFrame:
    """Without passages of repealed acts and of acts enacted after ``year``; unusable dates are kept."""
    enacted = F.expr("try_cast(substring(metadata.enactment_date, 1, 4) AS int)")
    keep = F.lit(True) if not exclude_repealed else ~F.coalesce("metadata.is_repealed", F.lit(False))
    return passages.filter(keep & (F.lit(True) if not year else enacted.isNull() | (enacted <= year)))


def with_parent_title(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """``hits`` with parent_context_added and their text behind '[title of the parent]' unless it starts with that title (50 characters).
    Of several passages with the parent's id the last counts."""
    parents = passages.groupBy(F.col("passage_id").alias("parent_id")).agg(F.max_by("title", "corpus_pos").alias("parent_title"))
    add = (F.coalesce("parent_title", F.lit("")) != "") & ~F.coalesce(F.substring("text", 1, 50), F.lit("")).contains(F.coalesce("parent_title", F.lit("")))
    j = hits.join(parents, "parent_id", "left").withColumn("parent_context_added", add)
    return j.withColumn("text", F.when(F.col("parent_context_added"), F.concat(F.lit("["), F.col("parent_title"), F.lit("]\n"), F.col("text"))).otherwise(F.col("text"))).drop("parent_title")


def cross_references(hits: DataFrame, passages: DataFrame, top: int = 3, refs: int = 3, most: int = 2) -> DataFrame:
    """(query_id, corpus_pos, passage_id, score): up to ``most`` passages of the same act that the first ``top`` hits refer to by
    section, not among the hits, at 0.6 of the referring score. A repeated reference takes the next passage of that section."""
    found = hits.filter(F.col("rank") <= top).select("query_id", "rank", "score", F.coalesce("act_name", F.lit("")).alias("act"), F.posexplode(F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[Ss]ection\\s+(\\d+[A-Z]?)"), F.lit(1)), 1, refs)).alias("no", "ref"))
    nth = W.partitionBy("query_id", "act", "ref").orderBy("rank", "no")
    found = found.withColumn("nth", F.row_number().over(nth))
    last = passages.groupBy("passage_id").agg(F.min("corpus_pos").alias("first_pos"), F.max_by(F.struct("corpus_pos", "act_name", "metadata"), "corpus_pos").alias("p"))
    target = last.select("passage_id", "first_pos", F.col("p.corpus_pos").alias("corpus_pos"), F.coalesce("p.act_name", F.lit("")).alias("act"), F.coalesce(F.nullif(F.col("p.metadata.section_number"), F.lit("")), "p.metadata.article_number").alias("ref"))
    cand = found.select("query_id", "act", "ref").distinct().join(target, ["act", "ref"]).join(hits.select("query_id", "passage_id").distinct(), ["query_id", "passage_id"], "left_anti")
    cand = cand.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "act", "ref").orderBy("first_pos")))
    got = found.join(cand, ["query_id", "act", "ref", "nth"])
    got = got.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "no"))).filter(F.col("k") <= most)
    return got.select("query_id", "corpus_pos", "passage_id", F.round(F.col("score") * 0.6, 9).alias("score"))


def article_dedup(hits: DataFrame) -> DataFrame:
    """The best hit of each article per query, ranked anew."""
    h = hits.withColumn("article_id", F.regexp_replace("passage_id", "_(CHUNK|SUBSEC)_.*$", ""))
    first = h.withColumn("n", F.row_number().over(W.partitionBy("query_id", "article_id").orderBy("rank"))).filter("n = 1").drop("n")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
