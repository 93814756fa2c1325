"""Near-duplicates by the exact similarity of word shingles: candidates by SimHash and by a prefix join, then verification of whole sets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, slices, utf8, written
from .components import components
from .simhash import SEED, hashes, links, majority

#: Two sets are alike from a Jaccard similarity of LEAST[0] / LEAST[1]; whole numbers, so that no bound is rounded.
LEAST = (4, 5)
#: The share of the texts whose shingles are counted (of fewer texts than FEW all, about), and so many of the most frequent, to be tried last: a bound on what travels, not on what is found.
SHARE, FEW, COMMON = 1 / 4, 16_384, 1_000_000
#: Turns in which the sets of a run are compared with a head, before all pairs that are left; and from the third turn on, so many heads for the runs of a group.
ROUNDS, HEADS = 4, 8
#: Digests a task remembers, so that copies are handed on about once a task.
_SEEN = 200_000


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a UTF-8 text's word shingles (words as in simhash); a shorter text is one shingle, one without words has none."""
    return np.unique(hashes(raw, width))


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def prefix(found: np.ndarray, common: np.ndarray, least: tuple[int, int] = LEAST, times: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(n * least) + 1 shingles, those in `common` (sorted) last, by their `times` if given: of two sets that are alike, some shingle is in both prefixes, whatever `common` and `times` are."""
    n = len(found)
    if not n:
        return found
    size = n - -(-n * least[0] // least[1]) + 1
    if not len(common):
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    last = common[at] == found
    often = found[last] if times is None else found[last][np.argsort(times[at[last]], kind="stable")]
    return np.concatenate((found[~last], often))[:size]


def bitmap(found: np.ndarray) -> bytes:
    """Four to eight bits a shingle, set by the low bits of its hash."""
    m = 1 << max(6, (4 * len(found) - 1).bit_length())
    out = np.zeros(m, bool)
    out[(found & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """A bound on the number of common shingles of two sets, from their bitmaps: the common bits, and what may hide behind shared ones."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    if len(a) < len(b):
        a, b, nx, ny = b, a, ny, nx
    while len(a) > len(b):  # the longer one folds onto half its length
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    ones = lambda v: int(np.bitwise_count(v).sum())
    return ones(a & b) + min(nx - ones(a), ny - ones(b))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(t, found array<long>) of every row of (t long, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(x, width) for x in utf8(batch.column(1))])], names=["t", "found"])

    return docs.select("t", "text").mapInArrow(run, "t long, found array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _shared(least: tuple[int, int]):
    """Rows of (key, part) runs of a sorted partition whose set has another of fitting size in the run, each set once, by size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(it, 4):
            rows = np.unique(rows, axis=0)  # by key, part, n, digest
            same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1) & (least[1] * rows[:-1, 2] >= least[0] * rows[1:, 2])
            rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(4)], names=["key", "part", "n", "digest"])

    return run


def _whole_runs(it: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of a sorted partition, cut between (key, part) runs only; holds a batch and one run."""
    left = np.zeros((0, width), np.int64)
    for batch in it:
        left = np.concatenate((left, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        if len(left) and (left[0, :2] != left[-1, :2]).any():
            last = len(left) - int(np.argmin((left[::-1, :2] == left[-1, :2]).all(axis=1)))
            yield left[:last]
            left = left[last:]
    if len(left):
        yield left


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], names=["a", "b"])


def _stars(least: tuple[int, int], turns: range):
    """Pairs of fitting size and different components of each set of a (key, part) run with the run's heads, one for each turn: the set of least hash. From the third turn on the hash differs by the run's key, so that the sets of a group that shares many runs meet HEADS heads in a turn."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(it, 5):
            start = _starts(rows)
            size, out = np.diff(np.append(start, len(rows))), []
            for turn in turns:
                salt = (rows[:, 0].astype(np.uint64) % np.uint64(HEADS if turn > 1 else 1) + np.uint64(HEADS * turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
                h = (rows[:, 3].astype(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                head = np.repeat(np.lexsort((h, np.repeat(np.arange(len(start)), size)))[start], size)
                n, m = rows[:, 2], rows[head, 2]
                ok = (rows[:, 4] != rows[head, 4]) & (least[1] * np.minimum(n, m) >= least[0] * np.maximum(n, m))
                out.append((rows[head[ok], 3], rows[ok, 3]))
            yield _pairs(*(np.concatenate(x) for x in zip(*out)))

    return run


def _open(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of runs: its rows, and how many pairs in a run are in different components."""
    for rows in _whole_runs(it, 5):
        start = _starts(rows)
        size = np.diff(np.append(start, len(rows)))
        run = np.repeat(np.arange(len(start)), size)
        _, same = np.unique(np.column_stack((run, rows[:, 4])), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([int((size**2).sum() - (same**2).sum()) // 2], pa.int64())], names=["rows", "pairs"])


def _undecided(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the runs whose sets are in more than one component."""
    for rows in _whole_runs(it, 5):
        start = _starts(rows)
        several = np.minimum.reduceat(rows[:, 4], start) != np.maximum.reduceat(rows[:, 4], start)
        rows = rows[np.repeat(several, np.diff(np.append(start, len(rows))))]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(5)], names=["key", "part", "n", "digest", "c"])


def _folded(bits: np.ndarray) -> np.ndarray:
    return bits[..., : bits.shape[-1] // 2] | bits[..., bits.shape[-1] // 2 :]


def _crossing(least: tuple[int, int]):
    """The pairs (a, b) of fitting size and different components inside each (key, part) run of a sorted partition, whose bitmaps leave room for enough common shingles (as in `most_common`, a set against many at once), so that a large run of sets that are not alike makes few rows. Holds one run and its bitmaps."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, more = np.zeros((0, 5), np.int64), []
        for batch in itertools.chain(it, [None]):
            if batch is not None:
                left = np.concatenate((left, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]])))
                more += batch.column(5).to_pylist()
            if not len(left):
                continue
            ends = [*_starts(left).tolist(), len(left)]
            out = []
            for s, e in itertools.pairwise(ends if batch is None else ends[:-1]):
                for a, b in _room(left[s:e], more[s:e], least):
                    out.append((left[s:e][a, 3], left[s:e][b, 3]))
                if sum(len(a) for a, _ in out) > 1 << 18:
                    yield _pairs(*(np.concatenate(x) for x in zip(*out)))
                    out = []
            if out:
                yield _pairs(*(np.concatenate(x) for x in zip(*out)))
            done = ends[-1 if batch is None else -2]
            left, more = left[done:], more[done:]

    return run


def _room(rows: np.ndarray, bits: list[bytes], least: tuple[int, int], words: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs in a run (key, part, n, digest, c), by size, that may be alike. Sets of fitting sizes have bitmaps of one length or of twice that."""
    n, c = rows[:, 2], rows[:, 4]
    size = np.array([len(x) // 8 for x in bits])
    starts = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1])))
    for at, s in enumerate(starts.tolist()):
        e = int(starts[at + 1]) if at + 1 < len(starts) else len(rows)
        own = np.frombuffer(b"".join(bits[s:e]), np.uint64).reshape(e - s, -1)
        sides = [(s, own, own)]
        if at and 2 * size[s - 1] == size[s]:
            sides.append((int(starts[at - 1]), np.frombuffer(b"".join(bits[int(starts[at - 1]) : s]), np.uint64).reshape(-1, int(size[s - 1])), _folded(own)))
        for first, those, mine in sides:
            ones, ones_mine = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (those, mine))
            for k in range(s, e):
                x = np.arange(max(first, int(np.searchsorted(n, -(-least[0] * n[k] // least[1])))), min(k, first + len(those)))
                x = x[c[x] != c[k]]
                step = max(1, words // those.shape[1])
                for j in range(0, len(x), step):
                    y = x[j : j + step]
                    both = np.bitwise_count(those[y - first] & mine[k - s]).sum(axis=1, dtype=np.int64) + np.minimum(n[y] - ones[y - first], n[k] - ones_mine[k - s])
                    y = y[(least[0] + least[1]) * both >= least[0] * (n[y] + n[k])]
                    if len(y):
                        yield y, np.full(len(y), k)


def _may_be_alike(least: tuple[int, int]):
    """Of pairs (a, b, t_a, t_b, n_a, n_b, bits_a, bits_b) those whose bitmaps leave room for enough common shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n_a, n_b, x, y = (c.to_pylist() for c in batch.columns[4:])
            ok = [(least[0] + least[1]) * most_common(p, q, n, m) >= least[0] * (n + m) for n, m, p, q in zip(n_a, n_b, x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(ok, pa.bool_()))

    return run


def _overlaps(least: tuple[int, int]):
    """Of a partition sorted by (head, part, side), a head's set before those it is compared with: the pairs that are alike. Holds one head's set at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.int64)
        for batch in slices(it, 512):
            head, part, side, other = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            a, b = [], []
            for k in range(batch.num_rows):
                found = flat[ends[k] : ends[k + 1]]
                if side[k] == 0:
                    now, own = (head[k], part[k]), found
                elif now == (head[k], part[k]):
                    # both in ascending order as unsigned numbers, each value once
                    both = np.sort(np.concatenate((own, found)), kind="stable")
                    if (least[0] + least[1]) * int((both[1:] == both[:-1]).sum()) >= least[0] * len(both):
                        a.append(head[k])
                        b.append(other[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, least: tuple[int, int] = LEAST, most: int = 4, segments: int = 2, block: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest long, component_id long) for every row of `docs`: texts whose sets of `width`-word shingles have a Jaccard similarity of `least` or more are linked, all of them.

    First candidates are texts whose SimHash fingerprints of these shingles are within `most` bits (`simhash.links`). Fingerprints of 64 bits miss most pairs near the threshold, so
    sets are joined besides: ordered by hash, the shingles most frequent in a share of the texts last, two alike share a shingle of their prefixes, a fifth
    of a set. Prefixes meet by shingle; a frequent one is dealt out in blocks of about `block` sets, every pair of blocks to a task of its own. In rounds each set is compared with one or two
    heads of its run, as long as that links more, then all pairs that are still in different components, so that a large group of near copies is not compared pairwise. Candidates whose
    bitmaps leave no room for enough common shingles are dropped (no true pair is); the others are verified by their whole sets. Equal sets are one class.
    component_id is the smallest doc_id reachable, rows are returned as often as they occur, and null ids and texts are as in simhash. An empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    total = docs.count()
    share = min(1.0, max(SHARE, FEW / max(1, total)))
    some = docs.where(F.pmod(F.shiftright("t", 8), F.lit(1 << 40)) < share * float(1 << 40)).groupBy("t").agg(F.first("text").alias("text"))
    often = _sets(some, width).select(F.explode("found").alias("key")).groupBy("key").agg(F.count("*").alias("times")).where("times >= 3")
    often = cut(often.orderBy(F.desc("times"), "key").limit(COMMON))
    counted = often.select("key", F.col("times").cast("int").alias("times")).toArrow()
    keys, times = counted["key"].to_numpy().view(np.uint64), counted["times"].to_numpy()
    given = docs.sparkSession.sparkContext.broadcast((keys[order := np.argsort(keys)], times[order]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, times), seen = given.value, set()
        for batch in slices(it):
            digest, fp, n, keys, bits = [], [], [], [], []
            for raw in utf8(batch.column(1)):
                h = hashes(raw, width)
                found = np.unique(h)
                d = _digest(found)
                digest.append(d)
                fp.append(majority(h))
                n.append(len(found))
                keys.append(found[:0] if d in seen else prefix(found, common, least, times))
                bits.append(None if d in seen else bitmap(found))
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(d)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (digest, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *signed, pa.array(n, pa.int64()), _lists(keys), pa.array(bits, pa.binary())], names=["doc_id", "t", "digest", "fp", "n", "keys", "bits"])

    rows = written(docs.select("doc_id", "text", "t").mapInArrow(run, "doc_id long, t long, digest long, fp long, n long, keys array<long>, bits binary"))
    #: of every set a text, its size, prefix and bitmap, which one row at least has
    sets = rows.where("bits is not null")
    classes = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")))

    near = cut(classes.groupBy("fp").agg(F.min("digest").alias("d")))
    by_fp = near.select(F.col("fp").alias("a"), F.col("d").alias("da")).join(links(near.select("fp"), most, segments).distinct(), "a").join(near.select(F.col("fp").alias("b"), F.col("d").alias("db")), "b")
    same_fp = classes.join(near, "fp").where("digest <> d").select(F.col("d").alias("da"), F.col("digest").alias("db"))
    by_fp = cut(by_fp.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).unionByName(same_fp.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))).distinct())

    blocks = F.broadcast(often.select("key", (F.floor(F.col("times") / share / block) + 1).cast("int").alias("blocks")).where("blocks > 1"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    dealt = sets.select(F.explode("keys").alias("key"), "n", "digest").join(blocks, "key", "left")
    dealt = dealt.select("key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(parts)).alias("part"), "n", "digest")
    shared = cut(dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_shared(least), "key long, part long, n long, digest long"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are alike."""
        ends = lambda df: bounded(df.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), 1_000_000)
        some = sets.join(ends(pairs), "digest", "left_semi").groupBy("digest").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        some = cut(some)
        a, b = (some.select(F.col("digest").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("t", "n", "bits"))) for c in ("a", "b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "t_a", "t_b", "n_a", "n_b", "bits_a", "bits_b")
        left = cut(both.mapInArrow(_may_be_alike(least), "a long, b long, t_a long, t_b long"))
        texts = bounded(left.select(F.explode(F.array("t_a", "t_b")).alias("t")).distinct(), 1_000_000)
        full = _sets(docs.join(texts, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text")), width)
        # a head with very many others is dealt out in parts; each part gets the head's set
        size = left.groupBy("a").agg(F.first("t_a").alias("t"), F.floor(F.count("*") / block).alias("last"))
        of = left.join(size.select("a", "last"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("part"), F.lit(1).alias("side"), "b", F.col("t_b").alias("t"))
        heads = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "t")
        sent = heads.unionByName(of).join(full, "t").select("a", "part", "side", F.coalesce("b", "a").alias("b"), "found")
        return cut(sent.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(_overlaps(least), "a long, b long"))

    both_ways = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def runs(linked: DataFrame | None) -> DataFrame:
        """The runs with each set's component. The partitions of `shared` hold whole runs, and a broadcast join leaves them as they are; else they are dealt and sorted again."""
        if linked is None:
            return shared.withColumn("c", F.col("digest"))
        small = linked.limit(1_000_001).count() <= 1_000_000
        linked = linked.withColumnRenamed("node", "digest")
        out = shared.join(F.broadcast(linked) if small else linked, "digest", "left").select("key", "part", "n", "digest", F.coalesce("component", "digest").alias("c"))
        return out if small else out.repartition("key", "part").sortWithinPartitions("key", "part", "n")

    tried = cut(runs(None).mapInArrow(_stars(least, range(2)), "a long, b long").unionByName(by_fp).distinct())
    edges = alike(tried)
    linked = cut(components(edges))
    for turn in range(2, ROUNDS):
        n, pairs = runs(linked).mapInArrow(_open, "rows long, pairs long").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if pairs <= n:
            break
        new = runs(linked).mapInArrow(_stars(least, range(turn, turn + 1)), "a long, b long").distinct()
        new = cut(new.join(both_ways(tried), ["a", "b"], "left_anti"))
        found = alike(new)
        tried = tried.unionByName(new)
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        linked = cut(components(edges))
    open_ = cut(runs(linked).mapInArrow(_undecided, "key long, part long, n long, digest long, c long"))
    bits = sets.join(bounded(open_.select("digest").distinct(), 1_000_000), "digest", "left_semi").groupBy("digest").agg(F.first("bits").alias("bits"))
    left = open_.join(bits, "digest").select("key", "part", "n", "digest", "c", "bits").repartition("key", "part").sortWithinPartitions("key", "part", "n")
    left = left.mapInArrow(_crossing(least), "a long, b long").distinct()
    linked = cut(components(edges.unionByName(alike(cut(left.join(both_ways(tried), ["a", "b"], "left_anti"))))))
    of = classes.join(linked.withColumnRenamed("node", "digest"), "digest", "left").withColumn("c", F.coalesce("component", "digest"))
    first = of.groupBy("c").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "digest").join(of.join(first, "c").select("digest", "component_id"), "digest").select("doc_id", "digest", "component_id")
