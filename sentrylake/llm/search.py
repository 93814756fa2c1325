"""Exact top-k search: BM25 over an inverted index, with block-max pruning."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settings, slices, utf8, written
from .embed import spherical_kmeans

K1, B = 1.2, 0.75
#: A shard takes documents, 64 at a time, until it has so many, or more bytes of text.
SHARD_DOCS, SHARD_BYTES = 4096, 6 << 20
#: Documents of a block, and queries that are scored together.
BLOCK, QUERIES = 32, 512
#: Terms of such a group of queries, about: what a task holds of them at a time.
QUERY_TERMS = 200_000
#: Blocks that are multiplied at a time, postings that are summed at a time, about, and documents that are scored in double precision at a time.
TOGETHER, POSTINGS, CANDIDATES = 8, 200_000, 1024
#: A term in at least this share of a shard's documents is a column of the shard's matrix; the others are posting lists.
DENSE = 1 / 20
#: Groups of documents alike in their frequent words; blocks hold documents of one group, so that their maxima tell them apart.
GROUPS = 8
#: Query terms and queries that travel with the tasks at a time, about, and shards, or the root of their number if that is more, that are searched first for a query's least score.
BLOCK_TERMS, BLOCK_QUERIES, FIRST_SHARDS = 1_000_000, 16_384, 4
_NO_ID = np.iinfo(np.int64).max

_INDEX = "tokens binary, token_ends binary, keys binary, starts binary, docs binary, tfs binary, ids binary, lengths binary, n long, total long, mark long"
_COUNTED = ("tokens", "token_ends", "starts")
_SEARCHED = ("keys", "starts", "docs", "tfs", "ids", "lengths", "n")


class _Shard:
    """A shard while it grows: the words of its documents as Arrow arrays."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.words: list[pa.Array] = []
        self.size = 0

    def add(self, ids: list[int], raws: list[bytes]) -> None:
        found, ends = _split(raws)
        self.ids += ids
        self.lengths += np.diff(ends).tolist()
        self.words.append(found)
        self.size += sum(map(len, raws))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size > SHARD_BYTES

    def row(self) -> tuple:
        """One row of the index: documents by group, then by falling length; terms in the order of their keys, each with its documents and counts."""
        n, length = len(self.ids), np.array(self.lengths, np.int64)
        coded = pa.concat_arrays([pa.array([], pa.binary()), *self.words]).dictionary_encode()
        names = coded.dictionary
        keys, order = _keys(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        key = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), length)
        key, counts = np.unique(key, return_counts=True)
        term, doc = np.divmod(key, n)
        df = np.bincount(term, minlength=len(names))
        order_of_docs = np.lexsort((-length, _groups(n, term, doc, df)))
        place = np.empty(n, np.int64)
        place[order_of_docs] = np.arange(n)
        by = np.argsort(term * n + place[doc])
        as_bytes = lambda x, kind: np.asarray(x, kind).tobytes()
        ids = as_bytes(np.array(self.ids, np.int64)[order_of_docs], np.int64)
        tokens, token_ends = _buffers(names.take(pa.array(order)))
        starts = np.concatenate(([0], np.cumsum(df)))
        narrow = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
        return (tokens, as_bytes(token_ends, np.int32), keys.tobytes(), as_bytes(starts, np.int32), as_bytes(place[doc][by], np.uint16), as_bytes(counts[by], narrow), ids, as_bytes(length[order_of_docs], np.int64), n, int(length.sum()), zlib.crc32(ids))


def _buffers(tokens: pa.Array) -> tuple[bytes, np.ndarray]:
    """The tokens one after another, and where each ends."""
    if not len(tokens):
        return b"", np.zeros(0, np.int32)
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return tokens.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes(), ends[1:] - ends[0]


def _split(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z) words of all texts, as `bytes.split` gives them, and 0 and where each text's words end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(raws, pa.binary()).view(pa.string())))
    words, ends = parts.values, parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    if not (whole := full.to_numpy(zero_copy_only=False)).all():
        words, ends = words.filter(full), np.concatenate(([0], np.cumsum(whole)))[ends]
    return words.view(pa.binary()), ends


def _keys(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the tokens' 128-bit hashes (XXH3), by rising first half, and the tokens' places in that order."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, _tokens(*_buffers(tokens)))), np.uint64).reshape(-1, 2)
    order = np.argsort(halves[:, 0], kind="stable")
    return np.ascontiguousarray(halves[order].T), order


def _groups(n: int, term: np.ndarray, doc: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The group of each of n documents, by which of their most frequent words it has; fitted to the first 1,024."""
    columns = np.argsort(-df, kind="stable")[:512]
    place = np.full(len(df) + 1, -1)
    place[columns] = np.arange(len(columns))
    here = place[term] >= 0
    doc, column, weight = doc[here], place[term[here]], np.log(1 + n / df[term[here]])

    def units(at: int) -> np.ndarray:
        x = np.zeros((min(SHARD_DOCS, n - at), len(columns) + 1))
        go = (doc >= at) & (doc < at + len(x))
        x[doc[go] - at, column[go]] = weight[go]
        x[:, -1] = 1e-3
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    centroids = spherical_kmeans(units(0)[:1024], min(GROUPS, n), rounds=4)
    return np.concatenate([(units(at) @ centroids.T).argmax(axis=1) for at in range(0, n, SHARD_DOCS)])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index of the whole texts, written to the shared folder: one row a shard of neighbouring documents (`_INDEX`). Words are lower-cased (A-Z); texts are not shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _INDEX.split(", ")]
        shard = _Shard()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in shard.row()], names=names)

        for batch in it:
            for part in slices(iter([batch]), 64):
                shard.add([_NO_ID if i is None else i for i in part.column(0).to_pylist()], utf8(part.column(1)))
                if shard.full():
                    yield out()
                    shard = _Shard()
                    pa.default_memory_pool().release_unused()
        if shard.ids:
            yield out()

    with settings(docs.sparkSession, arrow="4m"):
        return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _INDEX))


def _tokens(raw: bytes, ends: np.ndarray) -> list[bytes]:
    at = [0, *ends.tolist()]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def document_counts(index: DataFrame) -> DataFrame:
    """(token, df) over all shards."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw, ends, starts in zip(*(c.to_pylist() for c in batch.columns)):
                df = np.diff(np.frombuffer(starts, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(_tokens(raw, np.frombuffer(ends, np.int32)), pa.binary()), pa.array(df, pa.int64())], names=["token", "df"])

    return index.select(*_COUNTED).mapInArrow(run, "token binary, df long").groupBy("token").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, query_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(q, h, token, qtf): the distinct words of every query's whole text; h tells apart texts that share an id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            q, h, t, n = [], [], [], []
            for i, raw, x in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                c = Counter(raw.lower().split())
                q += [i] * len(c)
                h += [x] * len(c)
                t += c.keys()
                n += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(h, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], names=["q", "h", "token", "qtf"])

    rows = queries.select(F.col(query_id).cast("long").alias("q"), F.col(text).alias("text")).where("q is not null and text is not null")
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "q long, h long, token binary, qtf long").dropDuplicates(["q", "h", "token"])


@dataclass(frozen=True)
class Queries:
    """A block of queries, grouped by their frequent words: their terms and weights, query by query, and the least score that a document of theirs must have. Terms are numbered by falling frequency; `words` has the keys of all and, in that order, their numbers."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    least: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Queries:
        rows = rows.sort_by([("q", "ascending"), ("h", "ascending"), ("token", "ascending")])
        q, h, w = (rows[c].to_numpy() for c in ("q", "h", "w"))
        coded = rows["token"].combine_chunks()
        coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        starts = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (h[1:] != h[:-1])))) if len(q) else np.zeros(0, np.int64)
        size, coded_terms = np.diff(np.append(starts, len(q))), coded.indices.to_numpy()
        number = np.empty(len(coded.dictionary), np.int32)
        number[np.argsort(-np.bincount(coded_terms, minlength=len(number)), kind="stable")] = np.arange(len(number))
        terms = number[coded_terms]
        if len(size) > QUERIES:  # those alike in their frequent words are neighbours
            by = np.lexsort((size, _groups(len(size), terms, np.repeat(np.arange(len(size)), size), np.bincount(terms))))
            entry, starts, size = _spread(starts[by], size[by]), starts[by], size[by]
            terms, w = terms[entry], w[entry]
        keys, order = _keys(coded.dictionary)
        return Queries(q[starts], np.concatenate(([0], np.cumsum(size))), terms, w, (keys, number[order]), np.zeros(len(starts)))

    def groups(self) -> list[tuple[int, int]]:
        """Queries that are scored together: at most QUERIES, of about QUERY_TERMS terms."""
        out, at = [], 0
        while at < len(self.ids):
            last = int(np.searchsorted(self.starts, self.starts[at] + QUERY_TERMS, side="right")) - 1
            last = min(max(at + 1, last), at + QUERIES, len(self.ids))
            out.append((at, last))
            at = last
        return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """A row of the index, made ready for a block of queries."""

    def __init__(self, row: dict, words: tuple[np.ndarray, np.ndarray], mean: float):
        self.n = n = row["n"]
        doc, starts = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["starts"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], f"u{len(row['tfs']) // max(len(doc), 1) or 1}").astype(np.float64)
        self.ids, length = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths"))
        impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(mean, 1e-9)))[doc])
        (keys, checks), (own, own_checks), number = words[0], np.frombuffer(row["keys"], np.uint64).reshape(2, -1), words[1]
        #: of each word of the queries, its number in the shard, or the last
        here = np.full(len(keys), len(own))
        at = np.searchsorted(keys, own)
        while (go := np.flatnonzero(at < len(keys))).size and (go := go[keys[at[go]] == own[go]]).size:  # again for words whose keys are alike in their first half
            same = go[checks[at[go]] == own_checks[go]]
            here[number[at[same]]] = same
            at[go] += 1
        df = np.diff(starts)
        dense = np.flatnonzero(df >= max(2, DENSE * n))
        post = _spread(starts[dense], df[dense])
        self.matrix = np.zeros((n, len(dense)))
        self.matrix[doc[post], np.repeat(np.arange(len(dense)), df[dense])] = impact[post]
        self.blocks = -(-n // BLOCK)
        self.near = np.zeros((len(dense), self.blocks * BLOCK), np.float32)
        self.near[:, :n] = self.matrix.T
        self.tops = self.near.reshape(-1, self.blocks, BLOCK).max(axis=2)
        #: Sums in single precision are short of the true ones by this share at most.
        self.slack = (2 * len(dense) + 64) * 2.0**-24
        #: Posting lists of a like length are rows of a table, filled up with impacts of zero. `kind`: 0 for a word that the shard lacks, 1 for a column of the matrix, else 2 and the number of the word's table; `at`: its column or row.
        asked = np.zeros(len(df) + 1, bool)
        asked[here] = True
        asked[-1] = False
        asked[dense] = False
        lists = np.flatnonzero(asked)
        sizes = _list_sizes(int(df[lists].max()) if len(lists) else 0)
        table = np.searchsorted(sizes, df[lists]).astype(np.uint8)
        by = np.argsort(table, kind="stable")
        lists, table = lists[by], table[by]
        number = np.bincount(table, minlength=len(sizes))
        kind, place = np.zeros(len(df) + 1, np.uint8), np.zeros(len(df) + 1, np.int32)
        kind[dense], place[dense] = 1, np.arange(len(dense))
        kind[lists], place[lists] = table + 2, _spread(np.zeros(len(sizes), np.int64), number)
        self.kind, self.at = kind[here], place[here]
        wide = sizes[table]
        post, to = _spread(starts[lists], df[lists]), _spread(np.cumsum(wide) - wide, df[lists])
        docs, impacts = np.zeros(int(wide.sum()), np.int64), np.zeros(int(wide.sum()))
        docs[to], impacts[to] = doc[post], impact[post]
        ends = np.cumsum(number * sizes)
        self.lists = [(s, docs[e - m * s : e].reshape(m, s), impacts[e - m * s : e].reshape(m, s)) for s, m, e in zip(sizes.tolist(), number.tolist(), ends.tolist())]


def _list_sizes(most: int) -> np.ndarray:
    """1, 2, 3, 4, 6, 8, 12, ... up to one that is no less than `most`."""
    out = [1, 2, 3]
    while out[-1] < most:
        out.append(2 * out[-2])
    return np.array(out)


def _rare(shard: Shard, q: np.ndarray, table: np.ndarray, at: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """Of each of `rows` queries and each document, the sum over posting lists; entries (q, table, row in the table, weight) come by q."""
    out = np.zeros((rows, shard.blocks * BLOCK))
    size = np.array([s for s, *_ in shard.lists])[table]
    upto = np.concatenate(([0], np.cumsum(np.bincount(q, size, minlength=rows)))).astype(np.int64)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + POSTINGS, side="right")) - 1)
        a, b = np.searchsorted(q, (first, last))
        by = a + np.argsort(table[a:b], kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(table[a:b], minlength=len(shard.lists)))))
        place, row, weight = (q[by] - first) * shard.n, at[by].astype(np.intp), w[by]
        cell, value = np.empty(upto[last] - upto[first], np.int64), np.empty(upto[last] - upto[first])
        done = 0
        for (s, docs, impacts), x, y in zip(shard.lists, bounds.tolist(), bounds[1:].tolist()):
            if x < y:
                to = slice(done, done := done + (y - x) * s)
                c, v = (z[to].reshape(y - x, s) for z in (cell, value))
                np.take(docs, row[x:y], axis=0, out=c, mode="clip")
                np.take(impacts, row[x:y], axis=0, out=v, mode="clip")
                c += place[x:y, None]
                v *= weight[x:y, None]
        out[first:last, : shard.n] = np.bincount(cell, value, minlength=(last - first) * shard.n).reshape(last - first, shard.n)
        first = last
    return out


def search_shard(shard: Shard, queries: Queries, k: int, skipped: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the queries, QUERIES at a time: places in the block of queries, ids and scores of the shard's documents that may be among a query's k best, at most k a query, best first.

    The posting lists are summed up for all documents. With that, a query's bound in a block of documents is the largest of these sums there and the sum of its frequent terms' largest impacts there.
    The k-th best score that is known for a query is its threshold: that of the shards searched before or, without one, of this shard. Blocks whose bound is below it are skipped; in the others
    the frequent terms are multiplied in single precision, and what is not below the threshold by more than its error is scored in double precision. `skipped` is told how many pairs of query and document were passed over and scored.
    """
    n, least_of = shard.n, queries.least
    for part, (first, last) in enumerate(queries.groups()):
        rows = last - first
        entry = slice(queries.starts[first], queries.starts[last])
        q = np.repeat(np.arange(rows), np.diff(queries.starts[first : last + 1]))
        terms, w = queries.terms[entry], queries.weights[entry]
        kind, at = shard.kind[terms], shard.at[terms]
        common = np.zeros((rows, shard.matrix.shape[1]))
        go = kind == 1
        common[q[go], at[go]] = w[go]
        go = kind > 1
        rare = _rare(shard, q[go], kind[go] - 2, at[go], w[go], rows)
        least, near = least_of[first:last], common.astype(np.float32)
        need = np.maximum(np.where(least > 0, least * (1 - shard.slack) - 2e-8, 0), 1e-30).astype(np.float32)
        columns = np.flatnonzero(common.any(axis=0))
        near, docs = near[:, columns], shard.near[columns]
        bound = near @ shard.tops[columns] + rare.reshape(rows, -1, BLOCK).max(axis=2)
        live = bound >= need[:, None]
        score, pairs = rare.astype(np.float32), 0
        for b in range(0, shard.blocks, TOGETHER):
            of, of_docs = np.flatnonzero(live[:, b : b + TOGETHER].any(axis=1)), slice(b * BLOCK, (b + TOGETHER) * BLOCK)
            if len(of):
                pairs += len(of) * BLOCK * min(TOGETHER, shard.blocks - b)
                of = of if len(of) < rows else slice(0, rows)
                score[of, of_docs] += near[of] @ docs[:, of_docs]
        if skipped is not None:
            skipped[0] += score.size - pairs
            skipped[1] += pairs
        new = np.flatnonzero(least == 0)
        if len(new) and n >= k:
            need[new] = np.maximum(np.partition(score[new, :n], n - k, axis=1)[:, n - k] * (1 - 2 * shard.slack) - 2e-8, 1e-30)
        of, d = np.divmod(np.flatnonzero(score >= need[:, None]), score.shape[1])
        found = rare[of, d]
        for a in range(0, len(of), CANDIDATES):
            s = slice(a, a + CANDIDATES)
            found[s] += np.einsum("ij,ij->i", common[of[s]], shard.matrix[d[s]])
        found, ids = np.round(found, 8), shard.ids[d]
        by = np.lexsort((ids, -found, of))
        of, ids, found = of[by], ids[by], found[by]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = (place < k) & (found > 0)
        yield first + of[keep], ids[keep], found[keep], np.array([part])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of `docs` for every row of `queries` (same columns), by BM25, exactly.

    A query is the whole text: each word counts as often as it occurs. Document frequencies, the number of documents and their mean length are those of all
    `docs`; every shard is searched with them, so that merging the shards' k best is exact. Scores are rounded to 8 decimals; equal
    ones go by id. Documents without a common word are no results. A null or empty text matches nothing; a query without an id is left out;
    repeated rows are documents each; repeated queries are one, and different texts under one id are queries of their own, whose results stand under that id. Query terms travel
    to the tasks in blocks of at most about BLOCK_TERMS: a block's queries are searched in FIRST_SHARDS shards (or the root of their number), whose k-th best scores bound the search of all; a task's own results raise them from shard to shard. The results of each block
    are written to the shared folder before the next block travels.
    """
    index = build_index(docs, doc_id, text)
    with settings(docs.sparkSession, arrow="4m", parquet="4"):  # a row of the index is some megabytes: few are held at a time
        return _searched(index, query_terms(queries, doc_id, text), k)


def _searched(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    n, total, shards = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("n")).first()
    first = max(FIRST_SHARDS, isqrt(shards))
    marks = [r.mark for r in index.select("mark").orderBy("mark").limit(first).collect()]
    some = written(index.select("mark", *_SEARCHED).where(F.col("mark") <= marks[-1])) if FIRST_SHARDS <= len(marks) < shards else None
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = cut(terms.join(document_counts(index), "token").select("q", "h", "token", (F.col("qtf") * idf).alias("w")))
    terms_of_all, asked = weighted.agg(F.count("q"), F.approx_count_distinct(F.xxhash64("q", "h"))).first()
    blocks = max(1, -(-terms_of_all // BLOCK_TERMS), -(-asked // BLOCK_QUERIES))
    mean, parts = total / max(n, 1), []
    for block in range(blocks):
        given = Queries.of(weighted.where(F.pmod(F.xxhash64("q", "h"), F.lit(blocks)) == block).toArrow())
        if some is not None and len(given.ids):
            shared = spark.sparkContext.broadcast(given)
            for place, score in _merged(some, shared, mean, k).where(F.col("rank") == k).select("place", "score").collect():
                given.least[place] = score
            shared.destroy()
        shared = spark.sparkContext.broadcast(given)
        parts.append(written(_merged(index, shared, mean, k).select("query_id", "rank", "doc_id", "score")))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _merged(index: DataFrame, given, mean: float, k: int) -> DataFrame:
    found = index.select(*_SEARCHED).mapInArrow(_searcher(given, mean, k), "part int, place binary, doc binary, score binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(_merger(given, k), "place long, query_id long, rank int, doc_id long, score double")


def _first(place: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each place, best first."""
    by = np.lexsort((doc, -score, place))
    place, doc, score = place[by], doc[by], score[by]
    keep = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[keep], doc[keep], score[keep]


def _searcher(given, mean: float, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, shard, best = given.value, None, {}
        queries = replace(queries, least=queries.least.copy())
        for batch, j in ((batch, j) for batch in it for j in range(batch.num_rows)):
            if not len(queries.ids):
                continue
            shard = None  # one at a time
            shard = Shard(batch.slice(j, 1).to_pylist()[0], queries.words, mean)
            for *got, (part,) in search_shard(shard, queries, k):
                best[part] = _first(*(np.concatenate(x) for x in zip(best[part], got)), k) if part in best else tuple(got)
                # a task's k-th best so far is the least score in its next shards
                place, _, score = best[part]
                full = np.flatnonzero(np.arange(len(place)) - np.searchsorted(place, place) == k - 1)
                queries.least[place[full]] = np.maximum(queries.least[place[full]], score[full])
        for part, (place, doc, score) in best.items():
            if len(place):
                cols = [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (place.astype(np.int64), doc, score))]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "place", "doc", "score"])

    return run


def _merger(given, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def done() -> pa.RecordBatch:
            place, doc, score = best
            rank = (np.arange(len(place)) - np.searchsorted(place, place) + 1).astype(np.int32)
            cols = [pa.array(place), pa.array(given.value.ids[place]), pa.array(rank), pa.array(np.where(doc == _NO_ID, 0, doc), mask=doc == _NO_ID), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, names=["place", "query_id", "rank", "doc_id", "score"])

        for batch in it:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                got = [np.frombuffer(x, kind) for x, kind in zip(packed, (np.int64, np.int64, np.float64))]
                if part != now and now is not None:
                    yield done()
                best = _first(*got, k) if part != now else _first(*(np.concatenate(x) for x in zip(best, got)), k)
                now = part
        if now is not None:
            yield done()

    return run
