"""Passages that repeat: windows of words, found level by level at twice the length."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import shared_folder
from .common import cut, settings, utf8

#: Bytes of text in a block, and of text for which a bucket takes the windows.
BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 24 << 20
#: Bytes of text that are cut into words at once; a word beyond LONG_WORD is hashed by itself.
PART, LONG_WORD = 1 << 20, 1 << 16
#: Shortest window at which the levels begin.
LEAST = 8
_SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in their order."""
    x = (a * _ODD) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(length: int) -> list[int]:
    """Window lengths, the last one `length`: each is half of the next, rounded up, and none is below LEAST unless `length` is."""
    out = [length]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _parts(raw: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text, cut between words."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + PART)
        end = found.start() if found else len(raw)
        if end > at + PART + LONG_WORD:  # a very long word lies across the cut
            begin = max(raw.rfind(bytes([c]), at, at + PART) for c in _SPACES) + 1
            if begin > at:
                yield at, begin
            yield max(begin, at), end
        else:
            yield at, end
        at = end


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64)


def tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, in bytes; a hash depends on the word alone."""
    out = []
    data = np.frombuffer(raw, np.uint8)
    powers = inverse = np.ones(1, np.uint64)
    for at, stop in _parts(raw):
        part = data[at:stop]
        word = ~_IS_SPACE[part]
        edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start) == 1 and end[0] - start[0] > LONG_WORD:
            h = np.zeros(1, np.uint64)
        else:
            if len(powers) <= len(part):
                powers, inverse = (_powers(x, len(part) + 1) for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * powers[: len(part)], dtype=np.uint64)))
            h = mixed((sums[end] - sums[start]) * inverse[start], (end - start).astype(np.uint64))
        for k in np.flatnonzero(end - start > LONG_WORD).tolist():
            h[k] = xxhash.xxh64_intdigest(raw[at + int(start[k]) : at + int(end[k])], 12)
        out.append((start + at, end + at, h))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of the window that begins at each word, from windows of half its length; two windows that overlap cover one whose length is no power of two."""
    n = 1
    while n < length:
        step = min(n, length - n)
        h, n = mixed(h[: max(0, len(h) - step)], h[step:]), n + step
    return h


def packer(seq_bits: int = 33):
    """A mapInArrow function: (id, text) in blocks of some BLOCK_BYTES of text, each document closed by a line end, compressed."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size, kind = (TaskContext.get().partitionId()) << seq_bits, [], [], 0, None  # type: ignore[union-attr]

        def row() -> pa.RecordBatch:
            raw = b"".join(texts)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "sizes": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                "n_bytes": pa.array([len(raw)], pa.int64()), "text": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()),
            })

        for batch in it:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text + b"\n")
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    yield row()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield row()

    return pack


def _raw(row: dict) -> tuple[bytes, np.ndarray]:
    return pa.decompress(row["text"], row["n_bytes"], "zstd", asbytes=True), np.frombuffer(row["sizes"], np.int64)


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def followed(words: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, replies: list[dict] | None, lengths: list[int], upto: int, buckets: int):
    """The levels of a block before `upto`, by the replies to them: whether the window of the last of these lengths at each word repeats, and (values, times, order, bounds) of the candidates of
    `upto`, if that is a level: their distinct hashes, how often each occurs here, and these in the order of the buckets that they are sent to."""
    start, _, h = words
    n = len(h)
    upto_word = np.searchsorted(start, np.cumsum(sizes))
    room = np.repeat(upto_word, np.diff(np.concatenate(([0], upto_word)))) - np.arange(n)
    alive = np.zeros(n, bool)
    for k, length in enumerate(lengths[: upto + 1]):
        if k == 0:
            at = np.flatnonzero(room >= length)
            found = window_hashes(h, length)[at]
        else:
            step = length - lengths[k - 1]
            at = np.flatnonzero(alive[: n - step] & alive[step:] & (room[: n - step] >= length)) if n > step else np.zeros(0, int)
            found = mixed(h[at], h[at + step])
        values, inverse, times = np.unique(found, return_inverse=True, return_counts=True)
        bucket = (values & np.uint64(0xFFFFFF)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        if k == upto:
            return alive, (values, times, order, bounds)
        hit = np.zeros(len(values), bool)
        for r in replies or ():
            if r["level"] == k:
                a, b = bounds[r["bucket"]], bounds[r["bucket"] + 1]
                hit[order[a:b]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        alive = np.zeros(n, bool)
        alive[at] = hit[inverse]
        h = np.zeros(n, np.uint64)
        h[at] = found
    return alive, None


def sender(lengths: list[int], level: int, buckets: int, width: int):
    """A mapInArrow function over blocks with their replies: the distinct hashes of a block's candidates, by bucket, the upper `width` bytes of each."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(it):
            if level and not any(r["level"] == level - 1 for r in row["replies"] or ()):
                continue
            raw, sizes = _raw(row)
            _, (values, times, order, bounds) = followed(tokens(raw), sizes, row["replies"], lengths, level, buckets)
            used = np.flatnonzero(np.diff(bounds))
            if not len(used):
                continue
            upper = values[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
            cuts = np.concatenate((bounds[used], bounds[-1:])).astype(np.int32)

            def column(data: np.ndarray, of: int, cuts: np.ndarray = cuts, n: int = len(used)) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * np.int32(of)).tobytes()), pa.py_buffer(data.tobytes())])

            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), row["block"]), pa.int64()), column(upper, width), column((times[order] > 1).astype(np.uint8), 1)], names=["bucket", "block", "hashes", "again"])

    return send


def judge(level: int, width: int):
    """For the hashes of a bucket: which of each block's occur more than once in all, as bits in their order; blocks without any get no reply."""

    def reply(sent: pa.Table) -> pa.Table:
        blobs = sent.column("hashes").to_pylist()
        sizes = np.array([len(b) // width for b in blobs])
        values = np.zeros((int(sizes.sum()), 8), np.uint8)
        values[:, 8 - width :] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        v = values.view("<u8").ravel()
        again = np.frombuffer(b"".join(sent.column("again").to_pylist()), np.uint8).astype(bool)
        order = np.argsort(v, kind="stable")  # each block's are in order already
        same = v[order[1:]] == v[order[:-1]]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        parts = np.split(again, np.cumsum(sizes)[:-1])
        hit = [k for k, p in enumerate(parts) if p.any()]
        blocks, bucket = sent.column("block").to_pylist(), sent.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.array([blocks[k] for k in hit], pa.int64()), "level": pa.array([level] * len(hit), pa.int32()), "bucket": pa.array([bucket] * len(hit), pa.int32()),
            "bits": pa.array([np.packbits(parts[k]).tobytes() for k in hit], pa.binary()),
        })

    return reply


def remover(lengths: list[int], buckets: int):
    """A mapInArrow function over blocks with all their replies: a row a document, without the words that a repeated window covers."""

    def remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_at = None
        for batch in it:
            ids_at = batch.schema.get_field_index("ids")
            for i, row in enumerate(_rows(iter([batch]))):
                raw, sizes = _raw(row)
                start, end, h = tokens(raw)
                last = any(r["level"] == len(lengths) - 1 for r in row["replies"] or ())
                begins = followed((start, end, h), sizes, row["replies"], lengths, len(lengths), buckets)[0] if last else np.zeros(len(h), bool)
                step = np.zeros(len(h) + lengths[-1], np.int32)
                step[:-lengths[-1]][begins] += 1
                step[lengths[-1] :][begins] -= 1
                keep = np.cumsum(step)[: len(h)] == 0
                inside = np.zeros(len(raw) + 1, np.int8)
                inside[start[keep]], inside[end[keep]] = 1, -1
                taken, data = np.cumsum(inside[:-1], dtype=np.int8).astype(bool), np.frombuffer(raw, np.uint8).copy()
                taken[end[keep]], data[end[keep]] = True, 32
                ends = np.cumsum(sizes)
                cuts = np.concatenate(([0], np.cumsum(taken)))[np.concatenate(([0], ends))]
                words = np.searchsorted(start, np.concatenate(([0], ends)))
                kept_words = np.concatenate(([0], np.cumsum(keep)))[words]
                text = data[taken].tobytes()
                texts = [text[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n_words = np.diff(words)
                yield pa.RecordBatch.from_arrays([batch.column(ids_at)[i].values, pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(kept_words), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: the text without each word that is covered by a window of `length` words whose word sequence also starts elsewhere, in any document; the words
    that stay are joined by one space. Windows are judged on the input.

    Level-wise doubling: windows of a short length that occur once are given up; where two windows that repeat stand at the right distance, the window of twice the length that they cover is a
    candidate of the next level (`levels`; the last step stops at `length`), until that is reached or no candidate survives. A window is known by a hash that is mixed from those of its halves; levels
    before the last compare 40 bits besides the bucket's (more candidates than needed, none lost), the last one 64.

    Texts are written once, in compressed blocks, as a table bucketed by block. At each level a block sends its distinct hashes, some bytes each, to buckets; a bucket replies with a bit for each, and
    blocks meet their replies without another shuffle of texts. So a passage that occurs a million times is one hash a block, no group holds its occurrences, and positions never travel. A text of any
    length is cut into words part by part, but stands whole in its block.

    A null text has no words and an empty `kept`; ids may be null or repeated, each row is a document. Equal documents of `length` words or more lose all their words; shorter ones are left. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    spark, lengths = docs.sparkSession, levels(length)
    kind = docs.schema[doc_id].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions") or 200)
    name = f"blocks_{uuid.uuid4().hex}"
    joined = "block long, ids array<{}>, sizes binary, n_bytes long, text binary".format(kind)
    with settings(spark, arrow=str(8 << 20)):
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
        packed = rows.mapInArrow(packer(), joined).repartition(n, "block")
        packed.write.bucketBy(n, "block").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        blocks = spark.table(name)
        size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        buckets = max(n, -(-size // BUCKET_BYTES))
        replies = None

        def met() -> DataFrame:
            none = F.lit(None).cast("array<struct<level:int,bucket:int,bits:binary>>")
            if replies is None:
                return blocks.withColumn("replies", none)
            return blocks.join(replies.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("replies")).hint("shuffle_hash"), "block", "left")

        for level in range(len(lengths)):
            width = 8 if level == len(lengths) - 1 else 5
            sent = met().drop("ids").mapInArrow(sender(lengths, level, buckets, width), "bucket int, block long, hashes binary, again binary")
            new = cut(sent.groupBy("bucket").applyInArrow(judge(level, width), "block long, level int, bucket int, bits binary"))
            if new.isEmpty():
                break
            replies = new if replies is None else replies.unionByName(new)
    out = met().mapInArrow(remover(lengths, buckets), f"doc_id {kind}, n_words long, n_removed long, kept binary")
    spark.sql(f"drop table {name}")
    return out.withColumn("kept", F.col("kept").cast("string"))
