"""Splitting oversized texts at natural boundaries (P3).

Method: balanced targets. The least number of pieces that limit and overlap allow is computed, equal-length targets
are placed, each target is snapped to the strongest boundary near it, and a piece is added whenever a limit fails.
The work is a pass over single rows: texts within the limit are filtered away in the JVM, the others go through
Arrow batches; there is no shuffle but the removal of repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import slices

LIMIT, OVERLAP = 1500, 150
#: Separators from the strongest boundary to the weakest.
_SEPARATORS = (
    ("paragraph", re.compile(r"\n(?:[ \t\r]*\n)+")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"\n|(?<=[.!?;:])[ \t\n\r]+")),
    ("word", re.compile(r"[ \t\n\r]+")),
)
#: How far from its target a cut may be moved, as a share of the limit, by kind of boundary.
REACH = (0.5, 0.4, 0.35, 0.2)
PIECES = "record_type string, record_id string, boundary string, piece_no int, n_pieces int, start int, stop int, piece string"


def boundary_of(text: str, limit: int = LIMIT) -> str:
    """The first kind of boundary by which all stretches between separators are within the limit; else 'none'."""
    for name, sep in _SEPARATORS:
        at = 0
        for m in sep.finditer(text):
            if m.start() - at > limit:
                break
            at = m.end()
        else:
            if len(text) - at <= limit:
                return name
    return "none"


def _cuts(text: str) -> list[list[int]]:
    """For each kind of boundary the sorted offsets just behind its separators."""
    return [[m.end() for m in sep.finditer(text)] for _, sep in _SEPARATORS]


def _near(cuts: list[list[int]], low: int, high: int, target: int, reach: tuple[int, ...] | None = None) -> int | None:
    """Of the strongest kind with an offset in (low, high], the offset nearest to target; the earlier of two as near.

    ``reach`` bounds the distance from the target, by kind.
    """
    for kind, offsets in enumerate(cuts):
        far = reach[kind] if reach else high
        a, b = bisect_right(offsets, max(low, target - far - 1)), bisect_right(offsets, min(high, target + far))
        if a < b:
            i = bisect_left(offsets, target, a, b)
            return min((offsets[j] for j in (i - 1, i) if a <= j < b), key=lambda x: (abs(x - target), x))
    return None


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, stop) of the pieces: each within the limit, together the whole text, consecutive ones overlapping.

    An overlap starts at the boundary nearest to ``overlap`` characters before the previous stop, at most half as
    much again; without a boundary there it is cut at exactly ``overlap`` characters. Requires 2 * overlap < limit.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    cuts, step = _cuts(text), limit - overlap
    least = max(2, -(-(n - overlap) // step))
    for count in range(least, 3 * least + 3):
        pieces, start = [], 0
        width = (n + (count - 1) * overlap) / count
        reach = tuple(max(1, round(limit * share)) for share in REACH)
        for k in range(count - 1):
            # the rest is spread evenly over the pieces that are left
            width = (n - start + (count - 1 - k) * overlap) / (count - k)
            target = start + round(width)
            high = min(start + limit, n - 1)
            low = start + overlap + overlap // 2
            stop = _near(cuts, low, high, min(target, high), reach) if low < high else None
            if stop is None:
                stop = min(target, start + limit, n - 1)
            pieces.append((start, stop))
            back = _near(cuts, max(start, stop - overlap - overlap // 2 - 1), stop - overlap // 2, stop - overlap)
            start = back if back is not None else max(start + 1, stop - overlap)
        if n - start <= limit:
            return [*pieces, (start, n)]
    raise AssertionError("unreachable: three times the least number of pieces always suffices")


SPANS = "record_type string, record_id string, boundary string, piece_no int, n_pieces int, start int, stop int"


def split_spans(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text longer than ``limit`` as spans, without their text; texts: record_type, record_id, text.

    One pass over single rows, nothing is shuffled, so repeated rows come out repeatedly.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = []
                for kind, key, text in zip(*(b.column(c).to_pylist() for c in ("record_type", "record_id", "text"))):
                    found, boundary = split_text(text, limit, overlap), boundary_of(text, limit)
                    out += [(kind, key, boundary, k, len(found), i, j) for k, (i, j) in enumerate(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (*[pa.string()] * 3, *[pa.int32()] * 4))], [x.split()[0] for x in SPANS.split(", ")])

    return texts.select("record_type", "record_id", "text").filter(F.length("text") > limit).mapInArrow(spans, SPANS)


def split_oversized(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text longer than ``limit`` characters; texts: record_type, record_id, text.

    Null and empty texts and texts within the limit give no rows, repeated rows count once, other columns are not
    read. Two different texts under one record_id both come out. An empty table gives an empty result.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = []
                for kind, key, text in zip(*(b.column(c).to_pylist() for c in ("record_type", "record_id", "text"))):
                    found, boundary = split_text(text, limit, overlap), boundary_of(text, limit)
                    out += [(kind, key, boundary, k, len(found), i, j, text[i:j]) for k, (i, j) in enumerate(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (*[pa.string()] * 3, *[pa.int32()] * 4, pa.string()))], [x.split()[0] for x in PIECES.split(", ")])

    # the texts are shuffled here, once, to tell repeated rows
    long = texts.select("record_type", "record_id", "text").filter(F.length("text") > limit).distinct()
    return long.mapInArrow(pieces, PIECES)


def law_texts(sections: DataFrame, articles: DataFrame, article_text: str = "text") -> DataFrame:
    """Both tables of legal texts as (record_type, record_id, text)."""
    s = sections.select(F.lit("section").alias("record_type"), F.col("section_id").alias("record_id"), "text")
    return s.unionByName(articles.select(F.lit("article").alias("record_type"), F.col("article_id").alias("record_id"), F.col(article_text).alias("text")))
