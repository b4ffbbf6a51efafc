"""From whole act texts to parts, sections, subsections, articles and passages.

Finding sections needs match offsets, so a text is segmented in one pass over its row in Arrow batches; everything after
that (packing into passages, chapters, filters) is columns and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text, strip
from corpusloom.operators.spans import clause_chunks, greedy_chunks

# What opens a part, a section ('12A. Text'), a subsection ('(1) text') and a chapter.
_PART = re.compile(r"PART\s+([IVXLCDM]+|\d+)\s*[:-]?\s*([^\n]*)", re.I)
_OPEN = re.compile(r"(?<!\d)(\d{1,3}[A-Z]?)\s?\.\s{0,6}(?=[A-Z(\"'])")
_SUB = re.compile(r"^\((\d+[a-z]?)\)\s+", re.M)
_SUB_END = re.compile(r"\n\(|\n\n")
_CHAPTER = re.compile(r"CHAPTER\s+([IVXLCDM]+[A-Z]?)\s+([A-Z][A-Z\s,\-']+?)(?=\s+\d+\.)", re.I)
_ARTICLE = re.compile(r"(?:^|[A-Z\s]|\n)(\d+[A-Z]?)\.\s+(?=[A-Z])", re.M)
LEAST_SECTION = 16
SECTIONS = "section_id string, level string, title string, text string, parent_id string, number string, place int"


def sections_of(act_id: str, title: str, text: str) -> list[tuple]:
    """The act, its parts, its sections and their subsections, in this order of kinds; sections in the order of the text."""
    out: list[tuple] = [(act_id, "act", title, "", None, None)]
    parts = list(_PART.finditer(text))
    for m, stop in zip(parts, [*[p.start() for p in parts[1:]], len(text)]):
        out.append((f"{act_id}_PART_{m[1]}", "part", f"Part {m[1]}: {m[2].strip()}", text[m.end() : stop].strip(), act_id, m[1]))
    at, opens = 0, list(_OPEN.finditer(text))
    while at < len(opens):
        m = opens[at]
        # a section runs to the first opening that leaves it a body; shorter ones are swallowed
        nxt = next((k for k in range(at + 1, len(opens)) if opens[k].start() - m.end() >= LEAST_SECTION - 1), len(opens))
        body = text[m.end() : opens[nxt].start() if nxt < len(opens) else len(text)].strip()
        if len(body) >= LEAST_SECTION - 1:
            sid, (head, _, rest) = f"{act_id}_SEC_{m[1]}", body.partition("\n")
            out.append((sid, "section", head.strip()[:120], body, act_id, m[1]))
            inner = rest.strip() or body
            for s in _SUB.finditer(inner):
                end = _SUB_END.search(inner, s.end() + 1)
                out.append((f"{sid}_SUBSEC_{s[1]}", "subsection", f"Subsection {s[1]}", inner[s.end() : end.start() if end else len(inner)].strip(), sid, s[1]))
        at = nxt
    return out


def segment_acts(acts: DataFrame) -> DataFrame:
    """(section_id, level, title, text, parent_id, number, place) of every act; acts: act_id, title, text.

    Null texts give the act row only, an empty table an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, i) for a, t, x in zip(b.act_id, b.title, b.text) for i, r in enumerate(sections_of(a, t, x or ""))]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])

    return acts.select("act_id", "title", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SECTIONS)


def passages_of(sections: DataFrame, limit: int = 1500, least: int = 50) -> DataFrame:
    """(passage_id, text, title, level, parent_id, number): sections packed into passages of about ``limit`` characters; acts and
    passages of fewer than ``least`` visible characters are left out."""
    s = sections.filter("level <> 'act'")
    chunks = F.when(F.length("text") > limit, greedy_chunks(F.col("text"), limit)).otherwise(F.array("text"))
    p = s.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))
    pid = F.when(F.length("text") > limit, F.concat("section_id", F.lit("_CHUNK_"), F.col("chunk_index").cast("string"))).otherwise(F.col("section_id"))
    return p.select(pid.alias("passage_id"), F.col("chunk").alias("text"), "title", "level", "parent_id", "number").filter(F.length(strip(F.col("text"))) >= least)


def segment_articles(texts: DataFrame) -> DataFrame:
    """(edition, place, article_number, title, full_text, start, chapter) of constitution-like texts; texts: edition, text.

    The chapter is the last one that starts before the article.
    """
    schema = "edition string, kind int, start int, number string, title string, full_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, t in zip(b.edition, b.text):
                rows += [(e, 0, m.start(), m[1], m[2].strip(), None) for m in _CHAPTER.finditer(t)]
                found = list(_ARTICLE.finditer(t))
                for m, stop in zip(found, [*[f.start() for f in found[1:]], len(t)]):
                    first, _, rest = t[m.end() : stop].strip().partition("\n")
                    head = f"{first.strip()} {rest.partition(chr(10))[0]}".strip() if len(first.strip()) < 20 and rest else first.strip()
                    rows.append((e, 1, m.start(), m[1], f"Article {m[1]}: {head[:200] + '...' if len(head) > 200 else head}", t[m.start() : stop].strip()))
            if rows:
                yield pd.DataFrame(rows, columns=["edition", "kind", "start", "number", "title", "full_text"])

    r = texts.filter("text <> ''").select("edition", "text").mapInPandas(run, schema)
    w = W.partitionBy("edition").orderBy("start", "kind")
    name = F.when(F.col("kind") == 0, F.concat(F.lit("Chapter "), F.col("number"), F.lit(": "), F.col("title")))
    r = r.withColumn("chapter", F.last(name, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("kind = 1")
    return r.select("edition", (F.row_number().over(w) - 1).alias("place"), F.col("number").alias("article_number"), "title", "full_text", "start", "chapter")


def article_passages(articles: DataFrame, limit: int = 1000) -> DataFrame:
    """Articles as passages, longer ones in parts cut before their numbered clauses; ids count through an edition."""
    chunks = F.when(F.length("full_text") > limit, clause_chunks(F.col("full_text"), limit)).otherwise(F.array("full_text"))
    p = articles.withColumn("chunks", chunks).select("edition", "place", "article_number", "chapter", "title", F.size("chunks").alias("n"), F.posexplode("chunks").alias("no", "text"))
    w = W.partitionBy("edition").orderBy("place", "no")
    title = F.when(F.col("n") > 1, F.format_string("%s (Part %d/%d)", "title", F.col("no") + 1, "n")).otherwise(F.col("title"))
    return p.select("edition", F.format_string("PASSAGE_%04d", F.row_number().over(w) - 1).alias("passage_id"), "article_number", "chapter", title.alias("title"), "text")


def reassemble(parts: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """(key, text): the parts of each key in order, joined by blank lines. A key's parts make one document and are collected as such."""
    g = parts.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias("p"))
    return g.select(key, F.array_join(F.transform("p", lambda x: x["__text"]), "\n\n").alias("text"))


def cleaned(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn(text, clean_text(F.col(text)))
