"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the problem statements use the word: space, tab, line feed, carriage return.
BLANK = " \t\n\r"

#: Folder of the public tokenizers; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: Slots of a bit map.
SLOTS = 1 << 22


def slot_of(h: Column) -> Column:
    """The slot of a 64-bit hash."""
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(SLOTS - 1))


def slot_map(hashes: DataFrame) -> DataFrame:
    """(word, bits) of a bit map with the slots of the column ``h`` set: at most SLOTS / 64 rows, whatever the table's size."""
    slot = slot_of(F.col("h"))
    return hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 40) & 63 AS INT))")).alias("bits"))


def marked(rows: DataFrame, h: Column, slots: DataFrame) -> DataFrame:
    """The rows whose hash falls on a set slot; the bit map is broadcast, with its at most 65,536 rows."""
    slot = slot_of(h)
    r = rows.withColumns({"__word": F.shiftright(slot, 6).cast("int"), "__bit": slot.bitwiseAND(F.lit(63)).cast("int")})
    j = r.join(F.broadcast(slots.withColumnRenamed("word", "__word")), "__word")
    return j.filter(F.expr("shiftrightunsigned(bits, __bit) & 1 = 1")).drop("__word", "__bit", "bits")


#: A value with so many rows is hot: its rows are dealt to several tasks.
HOT, PARTS = 10_000, 16


def hot_slots(tables: dict[str, tuple[DataFrame, list[str]]], hot: int = HOT) -> DataFrame | None:
    """The bit map of the values with ``hot`` or more rows, of several tables and columns at once, as a local table of at most 65,536 rows; None if there are none."""
    every = None
    for tag, (df, on) in tables.items():
        one = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot).select(F.xxhash64(F.lit(tag), *on).alias("h"))
        every = one if every is None else every.unionByName(one)
    rows = slot_map(every).collect()
    return every.sparkSession.createDataFrame([(r.word, r.bits) for r in rows], "__word int, bits bigint") if rows else None


def split_join(left: DataFrame, right: DataFrame, on: list[str], key: str, tag: str, slots: DataFrame | None, parts: int = PARTS) -> DataFrame:
    """``left`` joined on the left with ``right``, which has one row per value of ``on``; nulls match.

    A value that is hot under ``tag`` in ``slots`` (see :func:`hot_slots`) is dealt to ``parts`` tasks by a hash of ``key``. A value
    that shares a slot with a hot one is dealt too, with the same result.
    """
    named = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    if slots is None:
        return left.join(named, same, "left").drop(*[f"__{c}" for c in on])

    def dealt(df: DataFrame, cols: list[str], to: Column, name: str) -> DataFrame:
        slot = slot_of(F.xxhash64(F.lit(tag), *cols))
        j = df.withColumns({"__word": F.shiftright(slot, 6).cast("int"), "__bit": slot.bitwiseAND(F.lit(63)).cast("int")}).join(F.broadcast(slots), "__word", "left")
        return j.withColumn(name, F.explode(F.when(F.expr("shiftrightunsigned(bits, __bit) & 1 = 1"), to).otherwise(F.array(F.lit(0))))).drop("__word", "__bit", "bits")

    a = dealt(left, on, F.array(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "__part")
    b = dealt(named, [f"__{c}" for c in on], F.sequence(F.lit(0), F.lit(parts - 1)), "__other")
    return a.join(b, same & (F.col("__part") == F.col("__other")), "left").drop("__part", "__other", *[f"__{c}" for c in on])
