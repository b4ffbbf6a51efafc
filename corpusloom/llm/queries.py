"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.bpe import encode_corpus
from corpusloom.llm.cutoff import cut_texts
from corpusloom.llm.packing import CAPACITY, fill_containers, token_counts
from corpusloom.llm.pairs import broken_pairs
from corpusloom.llm.reading import reading_levels
from corpusloom.llm.scans import repair_scans
from corpusloom.llm.splitting import law_texts, split_oversized, split_spans
from corpusloom.sources.tables import table


def _law(spark: SparkSession, d: str, article_text: str = "text") -> DataFrame:
    return law_texts(table(spark, d, "legal_sections"), table(spark, d, "constitution_articles"), article_text)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    sheet = table(spark, d, "annotation_sheet")
    one = [sheet.select("run_id", "item_id", F.lit(f).alias("answer_field"), "question", F.col(f).alias("answer")) for f in ("rag_answer", "no_rag_answer")]
    both = one[0].unionByName(one[1])
    return both.select(F.to_json(F.struct("run_id", "item_id", "answer_field", F.xxhash64("question", "answer").alias("h"))).alias("key"), F.col("answer_field").alias("source"), "question", "answer")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    bad = broken_pairs(_pairs(spark, d)).withColumn("k", F.from_json("key", "run_id string, item_id string, answer_field string"))
    return bad.select("k.run_id", "k.item_id", "k.answer_field", "defect").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per run, field and defect."""
    return p2_found(spark, d).groupBy("run_id", "answer_field", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_law(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_spans(_law(spark, d)).filter("piece_no = 0").select("record_type", "record_id", "boundary").distinct()


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized text: the hash of what its pieces make when put together again, its longest piece within the limit, and pieces
    that do not follow each other with an overlap of at most half as much again as asked."""
    p = p3_pieces(spark, d)
    w = W.partitionBy("record_type", "record_id", "n_pieces").orderBy("piece_no")
    over = F.lag("stop").over(w) - F.col("start")
    p = p.withColumn("over", over)
    p = p.withColumn("rest", F.when(F.col("over").isNull(), F.col("piece")).otherwise(F.expr("substring(piece, over + 1)")))
    g = p.groupBy("record_type", "record_id", "n_pieces").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "rest"))), lambda x: x["rest"]), "")).alias("text_hash"), F.max(F.length("piece")).alias("longest"), F.count_if((F.col("over") < 1) | (F.col("over") > 226)).alias("n_apart"))
    return g.select("record_type", "record_id", "text_hash", (F.col("longest") <= 1500).alias("within"), "n_apart")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("record_type") == "section", 0).when(F.col("text").rlike("^Article \\S+[ \\t\\r]*\\n"), 2).otherwise(1)
    return repair_scans(_law(spark, d, "full_text").withColumn("heading", own))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("record_type", "record_id", F.explode("noise").alias("noise")).distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    counts = token_counts(docs.filter("text <> ''"), "doc_id", "text")
    return fill_containers(counts, docs.count()).select("container", "doc_id", "piece_no", "tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: number, tokens, unused tokens and their share."""
    boxes = p7_containers(spark, d).groupBy("container").agg(F.sum("tokens").alias("used"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum(CAPACITY - F.col("used")).alias("unused")).withColumn("unused_share", F.round(F.col("unused") / (F.col("containers") * CAPACITY), 6))


#: Limits of a container of instruction data: segments, and tokens that bear loss (those of the answers).
ITEMS, ANSWER_TOKENS = 16, 1024


def p7_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and answer pairs of the sheet in containers with three limits that bind: tokens, pairs, and answer tokens."""
    pairs = _pairs(spark, d).filter("answer <> ''")
    n = token_counts(pairs, "key", "question", "answer")
    items = n.select("key", (F.col("n_question") + F.col("n_answer")).alias("n_tokens"), F.col("n_answer").alias("n_loss"))
    out = fill_containers(items, pairs.count(), "key", loss="n_loss", segments=ITEMS, loss_capacity=ANSWER_TOKENS)
    k = F.from_json("key", "run_id string, item_id string, answer_field string")
    return out.withColumn("k", k).select("container", "k.run_id", "k.item_id", "k.answer_field", "piece_no", "tokens", "loss_tokens")


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """Containers beyond a limit, and documents whose pieces are not numbered through or are split though they fit: none."""
    docs, pairs = p7_containers(spark, d), p7_instructions(spark, d)
    boxes = docs.groupBy("container").agg(F.sum("tokens").alias("n")).filter(F.col("n") > CAPACITY).select(F.lit("documents").alias("kind"), F.col("container").cast("string").alias("what"))
    split = docs.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.count_distinct("piece_no").alias("m"), F.max("piece_no").alias("last")).filter("k <> m OR last <> k - 1 OR k <> ceil(n / %d)" % CAPACITY).select(F.lit("pieces").alias("kind"), F.col("doc_id").cast("string").alias("what"))
    full = pairs.groupBy("container").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("loss_tokens").alias("q")).filter((F.col("n") > CAPACITY) | (F.col("k") > ITEMS) | ((F.col("q") > ANSWER_TOKENS) & (F.col("k") > 1))).select(F.lit("instructions").alias("kind"), F.col("container").cast("string").alias("what"))
    return boxes.unionByName(split).unionByName(full)


def _answers_and_citations(spark: SparkSession, d: str) -> DataFrame:
    """(key, source, text): key is record_type, record_id, both numbers and a hash of the text, joined by a control character."""
    audit = table(spark, d, "audit_log").select(F.lit("audit").alias("t"), F.col("entry_id").alias("id"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("metadata")["source"].alias("source"), F.col("answer").alias("text"))
    items = table(spark, d, "qac_items").select("item_id", F.col("metadata")["source"].alias("source"), F.posexplode("gold_answers").alias("i", "g"))
    cited = items.select("item_id", "source", "i", F.posexplode("g.citations").alias("j", "c")).select(F.lit("citation").alias("t"), F.col("item_id").alias("id"), "i", "j", "source", F.col("c.passage_text").alias("text"))
    both = audit.unionByName(cited).filter("text <> '' AND id IS NOT NULL")
    return both.select(F.concat_ws("\x01", "t", "id", "i", "j", F.xxhash64("text")).alias("key"), "source", "text")


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(_answers_and_citations(spark, d)).filter("cut")


def _record(c: Column) -> list[Column]:
    p = F.split(c, "\x01")
    return [p[0].alias("record_type"), F.array_join(F.slice(p, 2, F.size(p) - 4), "\x01").alias("record_id"), p[F.size(p) - 3].cast("int").alias("answer_no"), p[F.size(p) - 2].cast("int").alias("citation_no")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select(*_record(F.col("key"))).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts, cut texts and their share per kind of record and ``metadata['source']``, and how many cuts each rule saw."""
    kind = F.substring_index("key", "\x01", 1).alias("record_type")
    every = _answers_and_citations(spark, d).select("key", "source").distinct().groupBy(kind, "source").agg(F.count(F.lit(1)).alias("n_texts"))
    rules = ("word", "context", "bracket", "length")
    cut = _cut(spark, d).select("key", "source", "rule").distinct().groupBy(kind.alias("rt"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rule") == r).alias(f"by_{r}") for r in rules])
    out = every.join(cut, (every.record_type == cut.rt) & every.source.eqNullSafe(cut.s), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("record_type", "source", "n_texts", n.alias("n_cut"), F.round(n / F.col("n_texts"), 6).alias("cut_share"), *[F.coalesce(f"by_{r}", F.lit(0)).alias(f"by_{r}") for r in rules])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "band")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per source and band, with the source's mean expected band."""
    docs = table(spark, d, "documents")
    levels = reading_levels(docs, table(spark, d, "reading_labels")).join(docs.select("doc_id", "source"), "doc_id")
    expected = sum(k * F.col(f"p{k}") for k in range(1, 5))
    return levels.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg(expected), 4).alias("mean_level"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_pieces, p3_checked, p4_found, p4_report, p5_found, p5_repaired, p6_ids, p7_containers, p7_fill, p7_instructions, p7_violations, p8_found, p8_profile)}

_P3 = "SELECT 'section' AS record_type, section_id AS record_id, text FROM legal_sections UNION SELECT 'article', article_id, text FROM constitution_articles"
_FITS = "list_max(list_transform(string_split_regex({t}, '{sep}'), lambda x: length(x))) <= 1500"
SQL = {
    "p3_found": f"""SELECT DISTINCT record_type, record_id, CASE
      WHEN {_FITS.format(t='text', sep='\\n([ \\t\\r]*\\n)+')} THEN 'paragraph'
      WHEN {_FITS.format(t='text', sep='\\n')} THEN 'line'
      WHEN {_FITS.format(t="regexp_replace(text, '([.!?;:])[ \\t\\n\\r]+', '\\1' || chr(10), 'g')", sep='\\n')} THEN 'sentence'
      WHEN {_FITS.format(t='text', sep='[ \\t\\n\\r]+')} THEN 'word' ELSE 'none' END AS boundary
      FROM ({_P3}) WHERE length(text) > 1500""",
    "p3_checked": f"SELECT record_type, record_id, md5(text) AS text_hash, true AS within, 0::BIGINT AS n_apart FROM ({_P3}) WHERE length(text) > 1500",
    "p7_violations": "SELECT '' AS kind, '' AS what WHERE false",
}
