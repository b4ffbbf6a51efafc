"""Chunking, claims and citations: arrays of pieces of a text, built by folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

_CITE = "\\[([^,\\]]+),\\s*(?:Article|Section|Chapter)?\\s*([0-9]+[A-Z]?(?:\\([0-9]+\\))?(?:\\([a-z]\\))?)\\]"
# Fragments of disclaimers, which are no claims.
DISCLAIMERS = ["general reference only", "does not constitute legal advice", "qualified sri lankan legal practitioner", "consult a qualified", "not legal advice", "educational purposes only"]


def sentences(c: Column) -> Column:
    return F.split(c, "(?<=[.!?])\\s+")


def greedy_chunks(c: Column, limit: int, count_separator: bool = False) -> Column:
    """Sentences packed until the next would exceed ``limit``; the joining blanks count only if ``count_separator``.

    A sentence longer than the limit stays whole. Null gives null, the empty text one empty chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))
    sep = 1 if count_separator else 0

    def step(a: Column, s: Column) -> Column:
        flush = a["cur"].isNotNull() & (a["n"] + F.length(s) > limit)
        return F.when(flush, F.struct(F.array_append(a["done"], a["cur"]).alias("done"), s.alias("cur"), F.length(s).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat_ws(" ", a["cur"], s).alias("cur"), (a["n"] + F.length(s) + F.when(F.lit(sep) == 1, 1).otherwise(0)).alias("n"))
        )

    return F.aggregate(sentences(c), start, step, lambda a: F.array_append(a["done"], a["cur"]))


def overlapping_chunks(c: Column, limit: int = 500, overlap: int = 50) -> Column:
    """As greedy_chunks, but a new chunk begins with the last whole sentences of the previous one that fit into ``overlap`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def carried(cur: Column) -> Column:
        zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        return F.aggregate(
            F.reverse(cur),
            zero,
            lambda a, s: F.when(
                ~a["full"] & (a["n"] + F.length(s) <= overlap), F.struct(F.array_prepend(a["kept"], s).alias("kept"), (a["n"] + F.length(s)).alias("n"), F.lit(False).alias("full"))
            ).otherwise(F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(True).alias("full"))),
        )

    def step(a: Column, s: Column) -> Column:
        flush = (F.size(a["cur"]) > 0) & (a["n"] + F.length(s) > limit)
        k = carried(a["cur"])
        return F.when(flush, F.struct(F.array_append(a["done"], F.array_join(a["cur"], " ")).alias("done"), F.array_append(k["kept"], s).alias("cur"), (k["n"] + F.length(s)).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.array_append(a["cur"], s).alias("cur"), (a["n"] + F.length(s)).alias("n"))
        )

    return F.aggregate(sentences(c), start, step, lambda a: F.array_append(a["done"], F.array_join(a["cur"], " ")))


def clause_chunks(c: Column, limit: int = 1000) -> Column:
    """Text cut before every line that starts with a numbered clause, clauses packed up to ``limit``; sentences where there is no clause."""
    parts = F.split(c, "(?=\\n\\(\\d+[a-z]?\\))")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))
    packed = F.aggregate(
        parts,
        start,
        lambda a, s: F.when((F.coalesce(a["cur"], F.lit("")) != "") & (F.length(a["cur"]) + F.length(s) > limit), F.struct(F.array_append(a["done"], strip(a["cur"])).alias("done"), s.alias("cur"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(F.coalesce(a["cur"], F.lit("")), s).alias("cur"))
        ),
        lambda a: F.array_append(a["done"], strip(a["cur"])),
    )
    return F.when(c.rlike("\\n\\(\\d+[a-z]?\\)"), packed).otherwise(greedy_chunks(c, limit))


def claims(c: Column) -> Column:
    """Sentences of more than 10 characters without bracketed references and without disclaimers."""
    parts = F.transform(F.split(F.regexp_replace(c, "\\[.*?\\]", ""), "[.!?]+"), strip)
    return F.filter(parts, lambda s: (F.length(s) > 10) & ~F.exists(F.array(*[F.lit(d) for d in DISCLAIMERS]), lambda d: F.lower(s).contains(d)))


def citations(c: Column) -> Column:
    """array<struct(act_name, section, full)> of '[Act, Section n]' in their order."""
    every = [F.regexp_extract_all(c, F.lit("(?i)" + _CITE), F.lit(g)) for g in (1, 2, 0)]
    return F.transform(F.arrays_zip(*[e.alias(n) for e, n in zip(every, ("a", "s", "f"))]), lambda x: F.struct(strip(x["a"]).alias("act_name"), strip(x["s"]).alias("section"), x["f"].alias("full")))


def citation_format(c: Column) -> Column:
    """struct(total, well_formed) over all bracketed spans."""
    spans = F.regexp_extract_all(c, F.lit("(\\[[^\\]]+\\])"), F.lit(1))
    return F.struct(F.size(spans).alias("total"), F.size(F.filter(spans, lambda s: s.rlike("^(?i)" + _CITE))).alias("well_formed"))


def citation_density(c: Column) -> Column:
    """Sentences with a citation per sentence of more than 10 characters; disclaimers removed first. 0 without sentences."""
    text = strip(F.regexp_replace(c, "(?i)\\*?This information is for general reference[^*]*\\*?", ""))
    parts = F.split(text, "[.!?]+")
    n = F.size(F.filter(parts, lambda s: F.length(strip(s)) > 10))
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(parts, lambda s: s.rlike("(?i)" + _CITE))) / n)
