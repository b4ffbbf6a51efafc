"""Command line: index a corpus file, search an index for the questions of a file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import bm25_topk, postings
from corpusloom.settings import Settings
from corpusloom.sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    s = Settings.load()
    p = argparse.ArgumentParser(prog="corpusloom")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("build-index", help="postings of a corpus file")
    index.add_argument("corpus")
    index.add_argument("index")
    answer = sub.add_parser("search", help="best passages for each question of a file of JSON lines (query_id, query)")
    answer.add_argument("corpus")
    answer.add_argument("questions")
    answer.add_argument("out")
    answer.add_argument("--top-k", type=int, default=s.top_k)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    corpus = files.read_corpus(spark, a.corpus).withColumn("corpus_pos", F.xxhash64("act_name", "passage_id", "text"))
    if a.command == "build-index":
        files.write_index(postings(corpus), a.index)
    else:
        questions = spark.read.schema("query_id string, query string").json(a.questions)
        bm25_topk(corpus, questions, a.top_k, s.k1, s.b).write.mode("overwrite").json(a.out)


if __name__ == "__main__":
    main()
