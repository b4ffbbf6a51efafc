"""Files: manifests, corpora, question sets, rating sheets and audit logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PASSAGE = "struct<passage_id:string,text:string,title:string,level:string,parent_id:string,metadata:map<string,string>>"
DOCUMENT = f"act_info struct<act_name:string,act_number:string,act_year:int>, quality_score double, num_sections int, num_passages int, passages array<{PASSAGE}>"
QAC_ITEM = "struct<item_id:string,question:string,query_type:string,legal_domain:string,difficulty:string,gold_answers:array<struct<answer_text:string,citations:array<struct<act_name:string,act_number:string,act_year:int,section_number:string,passage_id:string,passage_text:string,start_char:int,end_char:int>>,annotator_id:string,annotation_date:string>>,relevant_passages:array<string>,metadata:map<string,string>>"
AUDIT = "entry_id string, timestamp string, type string, user_id string, query string, query_type string, answer string, abstained boolean, abstention_reason string, citations array<string>, verification_passed boolean, faithfulness_score double, retrieval_method string, num_passages int, confidence_score double, flagged_for_review boolean, review_reason string, metadata map<string,string>, error string, error_type string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pdf_path, act_name, act_number, act_year, legal_domain); both spellings of each key are known, missing keys are null."""
    raw = spark.read.json(path, multiLine=True, schema="acts array<map<string,string>>").select(F.explode("acts").alias("m"))
    pick = lambda *ks: F.coalesce(*[F.col("m")[k] for k in ks])
    return raw.select(pick("pdf_path", "file_path").alias("pdf_path"), pick("name", "act_name", "short_name").alias("act_name"), pick("number", "act_number").alias("act_number"), F.expr("try_cast(coalesce(m['year'], m['act_year']) AS int)").alias("act_year"), pick("domain", "legal_domain").alias("legal_domain"))


def write_corpus(passages: DataFrame, path: str) -> None:
    """One JSON line per act with its passages. An act's passages make one line and are collected as such."""
    keys = [F.col(c) for c in ("act_name", "act_number", "act_year")]
    p = F.struct("passage_id", "text", "title", "level", "parent_id", "metadata")
    passages.groupBy(F.struct(*keys).alias("act_info")).agg(F.count(F.lit(1)).cast("int").alias("num_passages"), F.array_sort(F.collect_list(F.struct("corpus_pos", p.alias("p"))), lambda a, b: (a["corpus_pos"] - b["corpus_pos"]).cast("int")).alias("s")).select("act_info", "num_passages", F.transform("s", lambda x: x["p"]).alias("passages")).write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """Passages of a corpus file with their act's columns, without those of fewer than ``least`` visible characters."""
    d = spark.read.schema(DOCUMENT).json(path)
    p = d.select("act_info.*", F.explode("passages").alias("p")).select("p.*", "act_name", "act_number", "act_year")
    return p.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least)


def corpus_statistics(passages: DataFrame) -> DataFrame:
    """One row: acts, passages, characters and the mean length of a passage."""
    return passages.agg(F.count_distinct("act_name").alias("n_acts"), F.count(F.lit(1)).alias("n_passages"), F.sum(F.length("text")).alias("n_chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


def write_questions(items: DataFrame, path: str, version: str = "1.0") -> None:
    """Items as JSON lines beside a row with version and number: one file per partition, so that a large set needs no single task."""
    items.write.mode("overwrite").json(f"{path}/items")
    items.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("num_items")).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_written_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(StructType.fromDDL(f"i {QAC_ITEM}")["i"].dataType).json(f"{path}/items")


def write_panel(ratings: DataFrame, path: str, raters: int = 5) -> None:
    """A sheet as :func:`read_panel` reads it, without its rows of headings: one row per item, per rater three ratings and two empty cells."""
    names = [f"rater_{r + 1}" for r in range(raters)]
    wide = ratings.groupBy("item_id").agg(*[F.max(F.when((F.col("rater") == r) & (F.col("dimension") == dim), F.col("rating"))).alias(f"{r}_{dim}") for r in names for dim in ("correctness", "completeness", "clarity")])
    none = lambda n: F.lit("").alias(n)
    cells = [c for r in names for c in (*[F.col(f"{r}_{dim}") for dim in ("correctness", "completeness", "clarity")], none(f"{r}_comments"), none(f"{r}_date"))]
    wide.select("item_id", *[none(f"c{i}") for i in range(1, 11)], *cells).write.mode("overwrite").option("emptyValue", "").csv(path)


def append_audit(entries: DataFrame, path: str) -> None:
    """Audit entries added to a log as JSON lines."""
    known = [c.split()[0] for c in AUDIT.split(", ")]
    entries.select([c for c in known if c in entries.columns]).write.mode("append").json(path)


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """Vectors in parquet with the model that made them."""
    vectors.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of an index; one made by another model is an error."""
    v = spark.read.parquet(path)
    other = v.filter(~F.col("model").eqNullSafe(F.lit(model))).select("model").first()
    if other is not None:
        raise ValueError(f"the index was made with {other[0]!r}, not with {model!r}")
    return v.drop("model")


def write_search_index(postings: DataFrame, path: str, vectors: DataFrame | None = None, model: str = "") -> None:
    write_index(postings, f"{path}/lexical")
    if vectors is not None:
        write_vectors(vectors, f"{path}/vectors", model)


def read_search_index(spark: SparkSession, path: str, model: str = "") -> tuple[DataFrame, DataFrame | None]:
    """Postings, and vectors if the index has any: without them every method is lexical (:func:`corpusloom.operators.records.dispatch`)."""
    try:
        vectors = read_vectors(spark, f"{path}/vectors", model)
    except AnalysisException:
        vectors = None
    return read_index(spark, f"{path}/lexical"), vectors


def list_files(spark: SparkSession, path: str, active: str | None = None) -> DataFrame:
    """(file, megabytes, is_active) of a folder; contents are not read."""
    f = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.round(F.col("length") / 1e6, 3).alias("megabytes"))
    return f.withColumn("is_active", F.col("file") == F.lit(active) if active else F.lit(False))


def read_documents(spark: SparkSession, path: str, extract: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> DataFrame:
    """(path, text) of the files of a folder; ``extract`` turns batches of contents into texts and runs on the executors."""
    text = F.pandas_udf(extract, "string")
    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema=f"version string, created string, num_items int, items array<{QAC_ITEM}>").select(F.explode("items").alias("i")).select("i.*")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, dimension, rating) of a sheet with a header; anything but 1 to 5 is null."""
    raw = spark.read.csv(path, header=True)
    cell = lambda c: F.expr(f"try_cast(trim(`{c}`) AS int)")
    dims = [c for c in raw.columns if c.lower() in ("correctness", "completeness", "clarity")]
    long = raw.select(F.trim(raw.columns[0]).alias("item_id"), F.explode(F.array(*[F.struct(F.lit(c.lower()).alias("dimension"), cell(c).alias("rating")) for c in dims])).alias("x")).select("item_id", "x.*")
    return long.withColumn("rating", F.when(F.col("rating").between(1, 5), F.col("rating")))


def read_panel(spark: SparkSession, path: str, raters: int = 5, first: int = 11, header_rows: int = 2) -> DataFrame:
    """(item_id, rater, dimension, rating) of a panel sheet: ``header_rows`` rows of headings, then per rater correctness,
    completeness, clarity, comments and date. A byte-order mark and leading dots of ids are removed, the first of repeated ids counts."""
    width = first + 5 * raters
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.csv(path, schema=schema, multiLine=True)
    rows = raw.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    item = F.regexp_replace(F.trim(F.regexp_replace("c0", "﻿", "")), "^\\.+", "")
    # the rows of one sheet keep their order in this id
    body = rows.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("row"))).filter(F.col("n") > header_rows).withColumn("item_id", item).filter("item_id <> ''")
    body = body.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("file", "n"))).filter("k = 1")
    cells = F.array(*[F.struct(F.lit(f"rater_{r + 1}").alias("rater"), F.lit(dim).alias("dimension"), F.expr(f"try_cast(trim(c{first + 5 * r + j}) AS double)").alias("rating")) for r in range(raters) for j, dim in enumerate(("correctness", "completeness", "clarity"))])
    return body.select("item_id", F.explode(cells).alias("x")).select("item_id", "x.*")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries of JSON lines, with ``ts`` as a timestamp; malformed lines, which have no entry_id, are left out."""
    return spark.read.schema(AUDIT).json(path).filter("entry_id IS NOT NULL").withColumn("ts", F.try_to_timestamp("timestamp"))


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in parquet, one folder per hash bucket of the term, so that a lookup reads the buckets of its terms only."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    p = spark.read.parquet(path)
    if terms is None:
        return p.drop("bucket")
    # one small row per term; the bucket values prune the folders
    wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets))).collect()})
    return p.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")
