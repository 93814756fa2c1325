"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, slices, utf8
from .components import components

SEED = 42
_CHUNK = 1 << 16


def hashes(raw: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of a UTF-8 text's word shingles in their order, repeats included; of a shorter text one for all its words, without words none."""
    found = raw.lower().split()  # on bytes: A-Z only, and the six white-space bytes of common.WORD
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(joined, SEED)] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(starts))


def majority(found: np.ndarray) -> int:
    """The 64-bit number of the bits set in over half of the hashes; one hash is itself, none give 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _CHUNK):
        ones += np.unpackbits(found[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little")


def fingerprint(raw: bytes, width: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, as an unsigned number; 0 without words."""
    return majority(hashes(raw, width))


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row's whole text; a null text counts as empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            fps = np.array([fingerprint(x, width) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    out, shell = [0], [0]
    for _ in range(radius):
        shell = sorted({m | 1 << b for m in shell for b in range(bits) if not m >> b & 1} - set(out))
        out += shell
    return [m - (1 << 64) if m >> 63 else m for m in out]  # as a signed long


def _forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every pair of `fps` within `most` bits, directly or through others of them; each edge is such a pair."""
    todo, ends = np.unique(fps), ([], [])
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            hit = np.full(len(todo), -1)
            for at in range(0, len(front), 512):
                rest = np.flatnonzero(hit < 0)
                near = np.bitwise_count(todo[rest][None, :] ^ front[at : at + 512, None]) <= most
                hit[rest] = np.where(near.any(axis=0), at + near.argmax(axis=0), -1)
            ends[0].append(front[hit[hit >= 0]])
            ends[1].append(todo[hit >= 0])
            front, todo = todo[hit >= 0], todo[hit < 0]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in ends)


def _runs(most: int):
    """Links inside each run of equal (key, part) of a sorted partition, read batch by batch; holds one run at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        size, a, b, fp = np.diff(np.append(start, len(key))), [], [], fp.view(np.uint64)  # bitwise_count takes absolute values
        two = start[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            x, y = _forest(fp[s : s + n], most)
            a.append(x)
            b.append(y)
        pairs = np.column_stack((np.concatenate(a), np.concatenate(b)))
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in it:
            key = np.concatenate((key, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])))
            fp = np.concatenate((fp, batch.column(2).to_numpy(zero_copy_only=False)))
            if len(key) and (key[0] != key[-1]).any():
                last = len(key) - int(np.argmin((key[::-1] == key[-1]).all(axis=1)))
                yield links(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield links(key, fp)

    return run


def links(fps: DataFrame, most: int = 4, segments: int = 2, cap: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fps` (fp long) whose closure is that of all pairs within `most` bits.

    Of two fingerprints within `most` bits, some segment differs in at most r = most // segments bits. Each fingerprint
    is entered in the table, and looked up, under every key of the balls of radius r/2 (rounded up and down) round
    its segments: the two balls then meet. Fingerprints under one key are verified over all 64 bits. A key that
    holds more than about `cap` fingerprints is dealt out in blocks, every pair of blocks to a task of its own.
    """
    bits, r = 64 // segments, most // segments
    half = (r + 1) // 2
    mask = (1 << bits) - 1
    segment = lambda fp, s: F.shiftrightunsigned(fp, bits * s).bitwiseAND(F.lit(mask)) if segments > 1 else fp
    deltas = [F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m")) for s in range(segments) for m in _ball(bits, half)]
    key = F.col("m") if segments == 1 else F.col("m").bitwiseOR(F.shiftleft(F.col("s").cast("long"), bits))
    of = F.coalesce(*[F.when(F.col("d.s") == s, segment(F.col("fp"), s)) for s in range(segments)])
    keys = fps.select("fp", F.explode(F.array(deltas)).alias("d")).select("fp", F.col("d.s").alias("s"), of.bitwiseXOR(F.col("d.m")).alias("m")).select("fp", key.alias("key"))
    # A key over the cap has, in its ball, a segment value that more than cap / |ball| fingerprints share.
    ball = _ball(bits, half)
    values = fps.select(F.explode(F.array([F.struct(F.lit(s).alias("s"), segment(F.col("fp"), s).alias("v")) for s in range(segments)])).alias("x")).groupBy("x.s", "x.v").count()
    heavy = values.where(F.col("count") > max(1, cap // len(ball))).select("s", F.explode(F.array([F.col("v").bitwiseXOR(F.lit(m)) for m in ball])).alias("m"), "count")
    heavy = heavy.groupBy(key.alias("key")).agg((F.floor(F.sum("count") / cap) + 2).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    dealt = keys.join(bounded(cut(heavy)), "key", "left").select("key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part"), "fp")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_runs(most), "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4, width: int = 4, segments: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id long) for every row of `docs`.

    Fingerprints within `most` bits are linked; component_id is the smallest doc_id reachable. Rows of one
    fingerprint are one class, so copies are neither compared nor joined pairwise. Null texts and texts without
    words have fingerprint 0 and are linked like any other. Rows with a null doc_id take part; a component
    of such rows alone has a null component_id. Rows that repeat are returned as often; columns other than the two
    named are not read. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, width, doc_id, text))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(links(classes.select("fp"), most, segments).distinct())
    linked = components(edges).withColumnRenamed("node", "fp")
    first = linked.join(classes, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    of = linked.join(first, "component").select("fp", "component_id")
    of = classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, similarity: tuple[int, int] | None = None, **options) -> DataFrame:
    """The columns of `docs`, for one row of each group: that of the smallest doc_id, and of rows that share it the first by text. Rows with a null doc_id go if their group has an id, else one stays.

    With `similarity`, say (4, 5), groups are not those of near fingerprints but of word shingles with a Jaccard similarity of 4/5 or more: near fingerprints are
    candidates, verified by their shingles, and pairs that 64 bits don't bring together are found by their shingles (`shingles.near_duplicates`).
    """
    if similarity is None:
        return keep_first(docs, cut(near_duplicates(docs, **options)))
    from .shingles import near_duplicates as by_shingles

    return keep_first(docs, cut(by_shingles(docs, least=similarity, **options)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """What `deduplicate` keeps of `docs`, given the (doc_id, component_id) of its rows. Columns of any name and kind stay as they are; of rows that share an id the one whose values are first as JSON stays."""
    own = docs.columns
    docs = docs.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)])
    at = f"own_{own.index('doc_id')}"
    back = lambda df: df.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(own)])
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    kept = docs.join(keep, F.col(at).eqNullSafe(F.col("id")), "left_semi")
    repeated = found.groupBy(F.col("doc_id").alias("id")).count().where("count > 1 or id is null").select("id")
    if repeated.isEmpty():
        return back(kept)
    once = kept.join(repeated, F.col(at).eqNullSafe(F.col("id")), "left_semi")
    once = once.groupBy(F.col(at).alias("id")).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row")).select("row.*")
    return back(kept.join(repeated, F.col(at).eqNullSafe(F.col("id")), "left_anti").unionByName(once))
