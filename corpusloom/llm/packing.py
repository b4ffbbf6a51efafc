"""Filling fixed-capacity containers with items (P7).

Method: vector bin packing by the dot-product heuristic. A container is filled until nothing fits: of the item types
(equal demands count as one type) that fit under all limits, the one with the greatest dot product of its demand and
the container's remaining room is placed; ties go to more tokens, then more loss-bearing tokens.

Items are dealt to shards by a hash of their key, so shards are even whatever the sources look like, and each shard
is packed on its own by one task: at most a few part-filled containers per shard remain. The number of shards follows the number of
rows, so a task's work is bounded at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import encoder_of, share_vocabulary, slices
from corpusloom.llm.common import TOKENIZERS

CAPACITY = 2048
#: Documents in one container, a bound of the attention mask; far above what texts of this kind reach.
SEGMENTS = 512
#: Items dealt to one shard.
SHARD = 20_000


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> np.ndarray:
    """The container of each item, from 0; items that exceed a limit alone get containers of their own.

    The result depends on the multiset of demands and the order of the items only.
    """
    order = np.lexsort((np.arange(len(tokens)), -loss, -tokens))
    pairs, first, count = np.unique(np.stack([-tokens[order], -loss[order]], 1), axis=0, return_index=True, return_counts=True)
    t, q = -pairs[:, 0], -pairs[:, 1]  # types by tokens, then loss, descending
    next_of, left = first.copy(), count.copy()
    out = np.full(len(tokens), -1, np.int64)
    room = np.array([capacity, segments, loss_capacity], float)
    scale = np.maximum(room, 1)
    d = np.stack([t, np.ones_like(t), q], 1) / scale
    live = np.arange(len(t))
    box = 0
    while len(live):
        rest_t, rest_s, rest_q, empty = capacity, segments, loss_capacity, True
        a = live
        while len(a):
            if not empty:
                lo = int(np.searchsorted(-t[a], -rest_t, "left"))  # types are sorted: those before do not fit
                a = a[lo:]
                a = a[(q[a] <= rest_q) & (left[a] > 0)] if rest_s > 0 else a[:0]
                if not len(a):
                    break
            r = np.array([rest_t, rest_s, rest_q]) / scale
            k = a[int(np.argmax(d[a] @ r))]
            out[order[next_of[k]]] = box
            next_of[k] += 1
            left[k] -= 1
            rest_t, rest_s, rest_q, empty = rest_t - t[k], rest_s - 1, rest_q - q[k], False
        box += 1
        live = live[left[live] > 0]
    return out


def token_counts(docs: DataFrame, key: str, *texts: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of each row, for several text columns (key, n_<column>, ...); the texts do not leave the Python worker. Null texts have no tokens."""
    shared = share_vocabulary(docs.sparkSession, name, folder)
    names = ["n_tokens"] if len(texts) == 1 else [f"n_{t}" for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(enc.count_ids(b.column(c).to_pylist()), pa.int64()) for c in cols]], ["key", *names])

    cols = ["text", *[f"text{i}" for i in range(1, len(texts))]]
    schema = ", ".join([f"key {dict(docs.dtypes)[key]}", *[f"{n} bigint" for n in names]])
    return docs.select(F.col(key).alias("key"), *[F.coalesce(F.col(t), F.lit("")).alias(c) for t, c in zip(texts, cols)]).mapInArrow(run, schema).withColumnRenamed("key", key)


def fill_containers(items: DataFrame, n_rows: int, key: str = "doc_id", tokens: str = "n_tokens", loss: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None, shard: int = SHARD) -> DataFrame:
    """(container, key, piece_no, tokens, loss_tokens): every item with at least one token, whole unless it exceeds ``capacity``.

    ``loss`` names the column of loss-bearing tokens, by default all tokens bear loss; a split item's loss is spread
    in proportion. ``n_rows`` (about the number of items) sets the number of shards. Rows with equal key and tokens
    count once; null and zero token counts give no rows; null loss counts as 0 and more loss than tokens as tokens.
    An empty table gives an empty result.
    """
    loss_capacity = capacity if loss_capacity is None else loss_capacity
    n_shards = max(1, -(-n_rows // shard))
    n, q = F.col(tokens).cast("bigint"), F.col(loss or tokens).cast("bigint")
    rows = items.select(F.col(key).alias("key"), n.alias("n"), F.least(F.greatest(F.coalesce(q, F.lit(0)), F.lit(0)), n).alias("q")).filter("n > 0")
    kind = dict(items.dtypes)[key]

    def one(group: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates(["key", "n"]).sort_values(["key", "n"], kind="stable")  # equal keys share a shard
        n, q = b.n.to_numpy(), b.q.to_numpy()
        pieces = -(-n // capacity)
        at = np.repeat(np.arange(len(n)), pieces)
        no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[at] - no * capacity)
        bear = q[at] * (no * capacity + size) // n[at] - q[at] * (no * capacity) // n[at]
        box = pack(size, bear, capacity, segments, loss_capacity)
        return pd.DataFrame({"container": box * n_shards + int(group[0]), "key": b.key.to_numpy()[at], "piece_no": no, "tokens": size, "loss_tokens": bear})

    # one task per shard: the rows are few, the work is not
    out = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards))).repartition(n_shards, "shard").groupBy("shard").applyInPandas(one, f"container bigint, key {kind}, piece_no int, tokens int, loss_tokens int")
    return out.withColumnRenamed("key", key)
