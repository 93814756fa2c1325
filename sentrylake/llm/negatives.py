"""Hard negatives: scores of anchors against all rows in blocks, ordered by a secondary sort, read by a streaming iterator."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settings

#: Bytes of vectors that a task holds as doubles; anchors stream past them.
CHUNK_BYTES = 32 << 20
ROW_BLOCK, ANCHOR_BLOCK = 1024, 256
#: anchor's id, its variant, score (descending), 1 for another label, row's id; as bytes the keys sort as wanted.
KEY = np.dtype([("anchor", ">u8"), ("variant", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = 1 << 63
_PACKED = "kind int, dim int, small boolean, ids binary, variants binary, labels binary, data binary, held binary"


def packer(rows: int, kind: int):
    """A mapInArrow function: (vec_id, variant, label, v, held) in blocks of at most `rows` rows of one length; rows with a null or non-finite component are left out."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, variants, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            v, held = batch.column(3), batch.column(4)
            offsets, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)  # a null is not a number here
            dims, bad = np.diff(offsets), np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            for dim in np.unique(dims[good]).tolist():
                of_dim = np.flatnonzero(good & (dims == dim))
                step = max(1, min(rows, (4 << 20) // (8 * max(1, dim))))
                for k in range(0, len(of_dim), step):
                    at = of_dim[k : k + step]
                    x = values[offsets[at][:, None] + np.arange(dim)[None]]
                    with np.errstate(over="ignore"):
                        y = np.floor(256 * x)
                    small = bool((np.abs(y) <= 32767).all())
                    own = [held[i].as_py() or [] for i in at.tolist()] if kind else []
                    yield pa.RecordBatch.from_pylist([{
                        "kind": kind, "dim": dim, "small": small, "ids": ids[at].tobytes(), "variants": variants[at].tobytes(), "labels": labels[at].tobytes(),
                        "data": (y.astype(np.int16) if small else x).tobytes(), "held": b"".join(struct.pack("<i", len(h)) + np.array(h, "<i8").tobytes() for h in own),
                    }], _schema)

    return pack


_schema = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("small", pa.bool_()), *((n, pa.binary()) for n in ("ids", "variants", "labels", "data", "held"))])


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python's integers of any size."""
    return np.array([[int(v) * 256 if abs(v) > 1e15 else math.floor(256 * v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def products(a: np.ndarray, a_small: bool, b: np.ndarray, b_small: bool) -> np.ndarray:
    """Inner products of the rows of a and b, exact; beyond 64 bits the nearest end of their range."""
    if a_small and b_small and a.shape[1] < 1 << 22:  # 2**15 * 2**15 * 2**22 < 2**53
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    a, b = a.astype(np.int64).astype(object) if a_small else _whole(a), b.astype(np.int64).astype(object) if b_small else _whole(b)
    return np.array([[max(-_SIGN, min(_SIGN - 1, s)) for s in row] for row in (a @ b.T).tolist()], np.int64).reshape(len(a), len(b))


def _block(row: dict) -> tuple:
    dim, n = row["dim"], len(row["ids"]) // 8
    data = np.frombuffer(row["data"], np.int16 if row["small"] else np.float64).reshape(n, dim)
    return dim, row["small"], *(np.frombuffer(row[k], np.int64) for k in ("ids", "variants", "labels")), data


def _held(raw: bytes) -> list[list[int]]:
    out, at = [], 0
    while at < len(raw):
        n = struct.unpack_from("<i", raw, at)[0]
        out.append(np.frombuffer(raw, "<i8", n, at + 4).tolist())
        at += 4 + 8 * n
    return out


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score that a negative of this positive may have: low and high hundredths of the positive's, empty where that is negative."""
    return -((-low * positive) // 100), high * positive // 100


def first(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the rows `at`, in the order of their ids, the n of highest score; those before of equal ones."""
    return at[np.argsort(~scores[at], kind="stable")[:n]]  # ~s falls as s grows, without overflow


def hardest(scores: np.ndarray, other: np.ndarray, positives: list[int], n: int, low: int, high: int) -> np.ndarray:
    """Rows, in the order of their ids, that are among the first n of a positive's window."""
    windows = [w for w in {window(p, low, high) for p in positives} if w[0] <= w[1]]
    if not windows:
        return np.zeros(0, int)
    at = np.flatnonzero(other & (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows)))
    at = at[np.argsort(~scores[at], kind="stable")]
    down = ~scores[at]
    return np.unique(np.concatenate([at[(k := int(np.searchsorted(down, ~hi))) : min(k + n, int(np.searchsorted(down, ~lo, "right")))] for lo, hi in windows]))


def scorer(k: int, n: int, low: int, high: int):
    """A mapInArrow function over blocks sorted by chunk and kind: it holds a chunk's rows and meets them with every block of anchors.

    Anchors without held scores (`kind` 1) give their first k rows of the same label; those with scores (`kind` 2), the positives' own,
    give the first n rows of another label in each positive's window. What a chunk gives is all that can be among the first of all chunks.
    """

    def ready(blocks: list[tuple]) -> list[tuple]:
        out = []
        for dim, small in sorted({b[:2] for b in blocks}):
            ids, _, labels, data = (np.concatenate([b[j] for b in blocks if b[:2] == (dim, small)]) for j in (2, 3, 4, 5))
            order = np.argsort(ids, kind="stable")
            data = data[order]
            out.append((dim, small, ids[order], labels[order], data.astype(np.float64) if small else data))
        return out

    def keys(anchor: int, variant: int, scores: np.ndarray, ids: np.ndarray, kind: int) -> np.ndarray:
        out = np.empty(len(ids), KEY)
        out["anchor"], out["variant"], out["kind"] = anchor + _SIGN, variant + _SIGN, kind
        out["score"], out["id"] = (~scores).view(np.uint64) ^ np.uint64(_SIGN), ids.view(np.uint64) ^ np.uint64(_SIGN)
        return out

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, blocks, rows = None, [], []
        for batch in it:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["chunk"] != chunk:
                    chunk, blocks, rows = row["chunk"], [], []
                if row["kind"] == 0:
                    blocks.append(_block(row))
                    continue
                if blocks:
                    rows, blocks = ready(blocks), []
                dim, small, a_ids, variants, labels, data = _block(row)
                held, out = _held(row["held"]), []
                for _, r_small, ids, r_labels, r_data in (r for r in rows if r[0] == dim):
                    step = max(1, (16 << 20) // (8 * len(ids)))
                    for at in range(0, len(a_ids), step):
                        s = products(data[at : at + step], small, r_data, r_small)
                        for j, scores in enumerate(s, at):
                            same = r_labels == labels[j]
                            if row["kind"] == 1:
                                found = first(scores, np.flatnonzero(same & (ids != a_ids[j])), k)
                            else:
                                found = hardest(scores, ~same, held[j], n, low, high)
                            out.append(keys(int(a_ids[j]), int(variants[j]), scores[found], ids[found], row["kind"] - 1))
                if out and len(packed := np.concatenate(out).astype(KEY)):  # concatenating takes the machine's byte order
                    yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())], names=["key"])

    return score


def ordered(keys: DataFrame) -> DataFrame:
    """Secondary sort: the keys of an anchor in one partition, in their order. Spark's sort spills; no anchor's keys are gathered."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def positives_of(k: int):
    """A mapInArrow function over ordered keys: the first k of each anchor, as a row an anchor with its key's head and its scores."""

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, heads, lists = None, [], []
        for batch in it:
            for key in batch.column(0).to_pylist():
                if key[:16] != head:
                    if len(heads) >= 4096:
                        yield pa.RecordBatch.from_pydict({"head": pa.array(heads, pa.binary()), "keys": pa.array(lists, pa.list_(pa.binary()))})
                        heads, lists = [], []
                    head = key[:16]
                    heads.append(head)
                    lists.append([])
                if len(lists[-1]) < k:
                    lists[-1].append(key)
        yield pa.RecordBatch.from_pydict({"head": pa.array(heads, pa.binary()), "keys": pa.array(lists, pa.list_(pa.binary()))})

    return take


def negatives_of(n: int, low: int, high: int):
    """A mapInArrow function over ordered keys, positives and candidates: a positive opens its window, which takes the first n negatives with scores in it. It holds an anchor's open windows only."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, windows = None, []
        for batch in it:
            out: list[tuple] = []
            for key in batch.column(0).to_pylist():
                anchor, _, score, kind, row = struct.unpack(">QQQBQ", key)
                anchor, score, row = anchor - _SIGN, _SIGN - 1 - score, row - _SIGN
                if key[:16] != head:
                    head, windows = key[:16], []
                if kind == 0:
                    lo, hi = window(score, low, high)
                    if lo <= hi:
                        windows.append([lo, hi, row, score, 0])
                    continue
                for w in windows:
                    if w[0] <= score <= w[1] and w[4] < n:
                        w[4] += 1
                        out.append((anchor, w[2], w[4], row, w[3], score))
                windows = [w for w in windows if w[4] < n and w[0] <= score]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return emit


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `is_anchor` holds, and each of its first `positives` other rows of the same label, the first
    `negatives` rows of another label whose score is between `low` and `high` hundredths of the positive's. A component x counts as floor(256 x); a score is the inner product, exact; higher scores
    come first, of equal ones the smaller id.

    Scores are packed into keys of (anchor, descending score, id), shuffled by anchor and sorted within partitions (`ordered`); an iterator over the sorted keys opens a window at each positive and
    emits the negatives in it. A score of 0 is a window of itself; there positives come first. Rows are dealt in packed blocks to chunks of some 32 MB, and blocks of anchors visit each chunk, so
    neither passes through the driver and no task holds more than a chunk. A chunk returns only keys that can count: of the same label its first `positives`, which settle the windows, then of
    other labels its first `negatives` in each window. What is shuffled grows with anchors times chunks, not with pairs.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of different lengths have no score. Scores beyond 64 bits count as the nearest end of that range.
    Rows that are repeated are candidates each; an anchor that is repeated whole is one anchor, and rows of one id that differ are anchors each. A row with the anchor's id is not one of its positives.
    A third of all rows may be equal: they are dealt in blocks like all others. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("variant"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("array<long>").alias("held"), is_anchor.alias("is_anchor"))
    anchors = cut(rows.where("is_anchor").drop("is_anchor").withColumn("variant", F.xxhash64("label", "v")).dropDuplicates(["vec_id", "label", "v"]))
    with settings(spark, arrow=str(8 << 20)):
        blocks = cut(rows.drop("is_anchor").mapInArrow(packer(ROW_BLOCK, 0), _PACKED))
        size, n = blocks.agg(F.coalesce(F.sum(F.length("data") * F.when(F.col("small"), 4).otherwise(1)), F.lit(0)), F.count("*")).first()
        chunks = max(1, -(-size // CHUNK_BYTES), min(n, spark.sparkContext.defaultParallelism))
        blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("ids", "data"), F.lit(chunks)).cast("int"))

        def candidates(who: DataFrame, kind: int) -> DataFrame:
            visits = who.mapInArrow(packer(ANCHOR_BLOCK, kind), _PACKED).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            met = blocks.unionByName(visits).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
            return met.mapInArrow(scorer(positives, negatives, low, high), "key binary")

        best = cut(ordered(candidates(anchors, 1)).mapInArrow(positives_of(positives), "head binary, keys array<binary>"))
        # a key's third part is the score, counted down from the greatest
        head = F.concat(*(F.unhex(F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")) for c in ("vec_id", "variant")))
        score = F.transform("keys", lambda x: F.conv(F.hex(F.substring(x, 17, 8)), 16, -10).cast("long").bitwiseXOR(F.lit((1 << 63) - 1).cast("long")))
        settled = anchors.withColumn("head", head).join(best.select("head", score.alias("found")), "head").select("vec_id", "variant", "label", "v", F.col("found").alias("held"))
        found = cut(candidates(settled, 2))
    both = best.select(F.explode("keys").alias("key")).unionByName(found)
    return ordered(both).mapInArrow(negatives_of(negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
