"""Shards by a consistent-hash ring with bounded loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order, and the shard that each belongs to."""
    points = np.array([xxhash.xxh64_intdigest(f"shard {s} point {v}", 42) for s in range(shards) for v in range(virtual)], np.uint64).view(np.int64)
    order = np.argsort(points, kind="stable")
    return points[order], np.repeat(np.arange(shards), virtual)[order]


def deal(counts: list[int], owner: list[int], capacity: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc, in the order of its rows: (rows up to here, shard, first slot).

    Every arc first fills the shard at its end. What overflows goes on clockwise, all arcs a step at a time, and
    each shard on the way takes what it still has room for.
    """
    free, filled, out, left = list(capacity), [0] * len(capacity), [[] for _ in counts], {}
    placed = [0] * len(counts)
    waiting = [a for a, n in enumerate(counts) if n]
    for step in range(len(counts)):
        for a in waiting:
            s = owner[(a + step) % len(owner)]
            if take := min(free[s], counts[a] - placed[a]):
                placed[a] += take
                out[a].append((placed[a], s, filled[s]))
                free[s] -= take
                filled[s] += take
        if not (waiting := [a for a in waiting if placed[a] < counts[a]]):
            break
    return out


def shard(docs: DataFrame, shards: int = 40, virtual: int = 64, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    Ids are hashed to a ring; a row belongs to the next of `virtual` points of each shard, clockwise. A shard takes
    at most ceil((1 + slack) * rows / shards) rows; with slack 0 exactly its even share, so that counts differ by one
    at most. Rows that overflow a full shard go on clockwise. One more shard moves its share and what
    overflows differently; more slack means fewer such moves. slot counts a shard's rows from 0 without gaps.
    Only the count of each of shards * virtual arcs reaches the driver; the rows are ranked within arcs, which are
    even since ids are hashed. A null text has no bytes; null ids are hashed by text; equal rows are interchangeable. An
    empty table gives no rows.
    """
    points, owner = ring(shards, virtual)

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy(), side="left") % len(points)).astype("int32")

    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")))
    rows = cut(rows.withColumn("arc", arc("h")))
    counts = dict(rows.groupBy("arc").count().collect())
    n = sum(counts.values())
    most = [int(np.ceil((1 + slack) * n / shards))] * shards if slack else [n // shards + (s < n % shards) for s in range(shards)]
    parts = deal([counts.get(a, 0) for a in range(len(points))], owner.tolist(), most)
    plan = docs.sparkSession.createDataFrame([(a, list(x)) for a, x in enumerate(parts) if x] or [(0, [])], "arc int, parts array<struct<upto:long,shard:int,slot:long>>")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("arc").orderBy("h", "doc_id", "text_crc32", "size")) - 1)
    dealt = ranked.join(F.broadcast(plan), "arc")  # shards * virtual rows
    at = F.filter("parts", lambda p: p["upto"] > F.col("n"))[0]
    before = F.coalesce(F.array_max(F.transform(F.filter("parts", lambda p: p["upto"] <= F.col("n")), lambda p: p["upto"])), F.lit(0))
    return dealt.select("doc_id", "size", "text_crc32", at["shard"].alias("shard"), (at["slot"] + F.col("n") - before).alias("slot"))
