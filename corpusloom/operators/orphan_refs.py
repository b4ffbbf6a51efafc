"""References to records that do not exist (P1).

Keys are strings with a running number at their end, so a key is taken apart into a stem and an integer.
Two as-of matches against runs decide each reference:

* existence: the parents' integers are compressed into contiguous runs; a reference whose integer lies beyond the
  end of the run that starts before it (or that no run precedes) is *missing*;
* lifetime: on the time axis a parent's rows form runs from ``ingested_at`` to the latest ``deleted_at`` so far; a
  reference made before the first run start is *late*, one made beyond the preceding run's end is *deleted*.

Both axes are cut into fixed buckets, so the windows below are partitioned by (stem, bucket) or (key, bucket): the
rows of a window are bounded by the bucket, however many rows a hot stem or a hot key has. Nothing is broadcast
and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Integers per bucket of the key axis, and seconds per bucket of the time axis.
KEY_BUCKET = 4096
TIME_BUCKET_S = 3600
_BLANK = "[ \\t\\n\\r]"
#: Later than any deletion: the end of a run that is still open.
_OPEN = (1 << 62)


def canonical_id(c: Column) -> Column:
    """Letter case, outer white space and the kind of separator do not tell ids apart; null and blank ids give null."""
    s = F.regexp_replace(F.upper(c), f"^{_BLANK}+|{_BLANK}+$", "")
    return F.when(s != "", F.regexp_replace(s, "[_\\-\\s]+", "_"))


def key_parts(c: Column) -> tuple[Column, Column]:
    """(stem, integer) with ``stem || integer = id``: the last digits (18 at most) without leading zeros; -1 if there are none."""
    digits = F.regexp_extract(c, "((?:[1-9][0-9]{0,17}|0))$", 1)
    # the first match from the left may start inside a longer run of digits: only the run's last 18 digits can reach the end
    return F.substring(c, F.lit(1), F.length(c) - F.length(digits)), F.when(digits == "", F.lit(-1)).otherwise(digits.cast("bigint"))


def key_runs(keys: DataFrame, bucket: int = KEY_BUCKET) -> DataFrame:
    """Contiguous runs of distinct (stem, n): (stem, bucket, run_start, run_end), cut at bucket borders."""
    w = W.partitionBy("stem", "bucket").orderBy("n")
    d = keys.select("stem", "n").distinct().withColumn("bucket", F.floor(F.col("n") / bucket))
    return d.withColumn("island", F.col("n") - F.row_number().over(w)).groupBy("stem", "bucket", "island").agg(F.min("n").alias("run_start"), F.max("n").alias("run_end")).drop("island")


def missing_keys(refs: DataFrame, parents: DataFrame, bucket: int = KEY_BUCKET) -> DataFrame:
    """Distinct (stem, n) of ``refs`` with ``present``: whether the run that starts at or before n reaches n."""
    w = W.partitionBy("stem", "bucket").orderBy("n", "is_ref").rowsBetween(W.unboundedPreceding, 0)
    runs = key_runs(parents, bucket).select("stem", "bucket", F.col("run_start").alias("n"), F.lit(0).alias("is_ref"), "run_end")
    asked = refs.select("stem", "n").distinct().select("stem", F.floor(F.col("n") / bucket).alias("bucket"), "n", F.lit(1).alias("is_ref"), F.lit(None).cast("bigint").alias("run_end"))
    both = runs.unionByName(asked).withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
    return both.filter("is_ref = 1").select("stem", "n", F.coalesce(F.col("n") <= F.col("reach"), F.lit(False)).alias("present"))


def lifetime_states(refs: DataFrame, parents: DataFrame, bucket_s: int = TIME_BUCKET_S) -> DataFrame:
    """Distinct (key, t) of ``refs`` with ``reach``: the end of the run of lifetimes that starts at or before t, null if none does.

    parents: key, born, dead (microseconds; dead ``_OPEN`` while the row is kept).
    """
    size = bucket_s * 1_000_000
    cell = F.floor(F.col("t") / size)
    lives = parents.filter("born IS NOT NULL").groupBy("key", F.col("born").alias("t")).agg(F.max("dead").alias("dead")).select("key", cell.alias("cell"), "t", F.lit(0).alias("is_ref"), "dead")
    asked = refs.filter("t IS NOT NULL").select("key", "t").distinct().select("key", cell.alias("cell"), "t", F.lit(1).alias("is_ref"), F.lit(None).cast("bigint").alias("dead"))
    both = lives.unionByName(asked)
    # one row per key and hour that occurs: carries the reach of all earlier cells into a cell
    cells = both.groupBy("key", "cell").agg(F.max("dead").alias("most"))
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select("key", "cell", F.max("most").over(before).alias("carried"))
    w = W.partitionBy("key", "cell").orderBy("t", "is_ref").rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("own", F.max("dead").over(w)).filter("is_ref = 1")
    return within.join(carried, ["key", "cell"]).select("key", "t", F.greatest("own", "carried").alias("reach"))


def orphan_references(refs: DataFrame, parents: DataFrame, ref_id: str, made_at: str, parent_id: str, born_at: str, dead_at: str) -> DataFrame:
    """The rows of ``refs`` whose reference resolves to no parent alive at ``made_at``, with ``reason``.

    A reference matches the parents of its id and those whose id is its id followed by ``_CHUNK_`` and a number.
    Rows of ``refs`` that are equal count once. Null and blank references are no cases; parents with a null or blank
    id match nothing; a parent without ``born_at`` counts as never ingested; a reference without ``made_at``
    precedes everything, so it is 'late' if its parent exists. Empty tables give an empty result or only 'missing'.
    Other columns of ``refs`` are carried along; other columns of ``parents`` are not read.
    """
    own = F.col("__id")
    p = parents.select(canonical_id(F.col(parent_id)).alias("__id"), F.unix_micros(F.col(born_at).cast("timestamp")).alias("born"), F.coalesce(F.unix_micros(F.col(dead_at).cast("timestamp")), F.lit(_OPEN)).alias("dead")).filter("__id IS NOT NULL")
    base = F.regexp_replace(own, "_CHUNK_[0-9]+$", "")
    p = p.select(F.explode(F.array_distinct(F.array(own, base))).alias("key"), "born", "dead").filter("key <> ''")
    p = materialize(p)  # both are read several times below
    stem, n = key_parts(F.col("key"))
    r = refs.distinct().withColumn("__id", canonical_id(F.col(ref_id))).filter("__id IS NOT NULL").withColumn("__t", F.unix_micros(F.col(made_at).cast("timestamp")))
    rs, rn = key_parts(own)
    r = materialize(r.withColumn("__stem", rs).withColumn("__n", rn))
    asked = r.select(F.col("__stem").alias("stem"), F.col("__n").alias("n"), own.alias("key"), F.col("__t").alias("t"))
    known = missing_keys(asked, p.select(stem.alias("stem"), n.alias("n"))).filter("present").select(F.col("stem").alias("__stem"), F.col("n").alias("__n"), F.lit(True).alias("__known"))
    lives = lifetime_states(asked, p).select(F.col("key").alias("__id"), F.col("t").alias("__t"), F.col("reach").alias("__reach"), F.lit(True).alias("__timed"))
    out = r.join(known, ["__stem", "__n"], "left").join(lives, ["__id", "__t"], "left")
    reason = F.when(F.col("__known").isNull(), "missing").when(F.col("__reach").isNull(), "late").when(F.col("__reach") <= F.col("__t"), "deleted")
    return out.withColumn("reason", reason).filter("reason IS NOT NULL").select(*refs.columns, "reason")


def qac_references(items: DataFrame) -> DataFrame:
    """(field, item_id, passage_id, created_at) of both fields that name passages; null lists and null elements give no rows."""
    key = ["item_id", "created_at"]
    listed = items.select(F.lit("relevant_passages").alias("field"), *key, F.explode("relevant_passages").alias("passage_id"))
    cited = items.select(*key, F.explode("gold_answers").alias("g")).select(*key, F.explode("g.citations").alias("c")).select(F.lit("citation").alias("field"), *key, F.col("c.passage_id").alias("passage_id"))
    return listed.unionByName(cited).select("field", "item_id", "passage_id", "created_at")
