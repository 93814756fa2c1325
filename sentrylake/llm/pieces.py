"""SentencePiece (BPE) encoding and decoding by suffix-array matching."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of new units that are indexed at a time, and units that a worker remembers.
INDEX_CHARS, KNOWN_UNITS = 1 << 18, 120_000
#: Longest piece that can be matched.
WIDTH = 16
#: Stand for U+2581 in the text, and for a cut between units; neither occurs in UTF-8.
_MARK, _CUT = "\ud800", "\ud801"


class Vocabulary:
    """Pieces of a BPE model: which text each one stands for, and which pairs of them BPE leaves apart."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("needs a BPE model with byte fallback, a dummy prefix and the identity normaliser")
        self.text = [p.piece for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.blank = {len(p): i for p, i in normal.items() if not p.strip(SPACE)}
        #: rank: the better a piece's score, the earlier BPE makes it; equal scores by id.
        order = sorted(normal.values(), key=lambda i: (-proto.pieces[i].score, i))
        self.rank = {i: n for n, i in enumerate(order)}
        self.id = {p: i for p, i in normal.items() if len(p) == 1 or p.strip(SPACE)}
        if any(SPACE in p[1:] or len(p) > WIDTH for p in self.id):
            raise ValueError("needs pieces that hold white space at their start only, of at most 16 characters")
        self.chars = {p for p in self.id if len(p) == 1}
        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if (a := self.id.get(p[:k])) is not None and (b := self.id.get(p[k:])) is not None:
                    self.pairs[a, b] = i
        halves = {i: self._halves(p) for p, i in self.id.items()}
        self.id = {p: i for p, i in self.id.items() if halves[i] != (-1, -1)}
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.single = np.full(0x110000, -1, np.int64)
        self.single[[ord(c) for c in self.chars]] = [self.id[c] for c in self.chars]
        #: For `apart`: merges by pair, the rank at which each piece is made (-1: a character), its halves; and the pairs met last, at the place of their hash, times two, plus the answer.
        keys = sorted(((a << 20) | b, self.rank[i]) for (a, b), i in self.pairs.items())
        self._pair_keys, self._pair_ranks = (np.array(x, np.int64) for x in zip(*keys))
        self._made, self._left, self._right = (np.full(len(self.text), -1, np.int64) for _ in range(3))
        for i, both in halves.items():
            if both is not None and both != (-1, -1):
                self._made[i], self._left[i], self._right[i] = self.rank[i], *both
        self._met = np.full(1 << 21, -1, np.int64)
        #: For `edges`: codes of characters, from 1, and the bounds of each longer piece among the suffixes.
        self.code = np.zeros(0x110000, np.uint64)
        self.code[sorted(map(ord, self.chars))] = np.arange(1, len(self.chars) + 1)
        long = [(i, p) for p, i in self.id.items() if len(p) > 1]
        self.long_ids, self.long_size = np.array([i for i, _ in long]), np.array([len(p) for _, p in long])
        low, high = np.zeros((len(long), WIDTH), np.uint64), np.full((len(long), WIDTH), 0xFFFF, np.uint64)
        for r, (_, p) in enumerate(long):
            low[r, : len(p)] = high[r, : len(p)] = self.code[[ord(c) for c in p]]
        self.low, self.high = ([k[:, 0] for k in _pack(x, 1)] for x in (low, high))

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes a piece; None for a character, and (-1, -1) for a piece that BPE never makes."""
        if len(piece) == 1:
            return None
        parts = [self.id.get(c, -1) for c in piece]
        while len(parts) > 2:
            best = min(((self.rank[m], k) for k in range(len(parts) - 1) if (m := self.pairs.get((parts[k], parts[k + 1]))) is not None), default=None)
            if best is None:
                return -1, -1
            k = best[1]
            parts[k : k + 2] = [self.pairs[parts[k], parts[k + 1]]]
        return (parts[0], parts[1]) if len(parts) == 2 and self.pairs.get((parts[0], parts[1])) == self.id[piece] else (-1, -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces whether BPE of their text gives these two: no merge across the border comes before the merges on either side that close it. An a below 0 stands for a unit's start."""
        pair = (a << 20) | b
        at = ((pair * 0x9E3779B1) >> 12) & (len(self._met) - 1)
        met = self._met[at]
        ok = (a < 0) | ((met >> 1 == pair) & (met & 1 == 1))
        new = np.flatnonzero((a >= 0) & (met >> 1 != pair))
        if len(new):
            ok[new] = self._stays(a[new], b[new])
            self._met[at[new]] = pair[new] << 1 | ok[new]
        return ok

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walks back in time: undoes the latest merge of the pieces at the border; while both stood there, no earlier-ranked merge may join them."""
        stays, at = np.ones(len(a), bool), np.arange(len(a))
        until, left = np.full(len(a), 1 << 30), np.zeros(len(a), bool)
        while len(at):
            key = (a << 20) | b
            k = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
            joined = np.where(self._pair_keys[k] == key, self._pair_ranks[k], 1 << 30)
            bad = (joined < until) | ((joined == until) & left)
            stays[at[bad]] = False
            ra, rb = self._made[a], self._made[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, at, ra, rb = (x[go] for x in (a, b, at, ra, rb))
            # of two merges with one rank the left one came first, so the right one is undone first; a character has no merge
            undo_a = ra > rb
            until, left = np.maximum(ra, rb), ~undo_a
            a, b = np.where(undo_a, self._right[a], a), np.where(undo_a, b, self._left[b])
        return stays


def _pack(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of the first n positions (last axis) the 16 codes from there on, four in a number."""
    at = lambda k: codes[..., k : k + n]
    return [(at(k) << np.uint64(48)) | (at(k + 1) << np.uint64(32)) | (at(k + 2) << np.uint64(16)) | at(k + 3) for k in (0, 4, 8, 12)]


def edges(units: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every piece of two characters or more in `units`, whose characters the vocabulary knows.

    Returns positions and pieces, sorted by position and then longest first; where those of each position begin; and where
    each unit starts. The units are concatenated, with a boundary between them, and all suffixes sorted by their first 16
    characters (prefix doubling from packed keys); each piece's range is found by binary search, all pieces a step at a time.
    """
    codes = vocab.code[np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)]
    n = len(codes)
    padded = np.concatenate((codes, np.zeros(2 * WIDTH, np.uint64)))
    keys = _pack(padded, n)
    zeros = np.zeros(WIDTH, np.uint64)
    rank = np.concatenate((np.unique(keys[0], return_inverse=True)[1].astype(np.uint64), zeros))
    # the padding's rank is that of a boundary, the least: a unit's end is before either
    rank = np.concatenate((np.unique((rank[:n] << np.uint64(32)) | rank[4 : n + 4], return_inverse=True)[1].astype(np.uint64), zeros))
    order = np.argsort((rank[:n] << np.uint64(32)) | rank[8 : n + 8])
    keys = [k[order] for k in keys]

    def search(goal: list[np.ndarray]) -> np.ndarray:
        lo, hi = np.zeros(len(goal[0]), np.int64), np.full(len(goal[0]), n, np.int64)
        for _ in range(n.bit_length()):
            mid = np.minimum((lo + hi) >> 1, n - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, want in zip(keys, goal):
                v = k[mid]
                less |= same & (v < want)
                same &= v == want
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        return lo

    first = search(vocab.low)
    count = search(vocab.high) - first
    ids, size = np.repeat(vocab.long_ids, count), np.repeat(vocab.long_size, count)
    first = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    by = np.argsort(first * (WIDTH + 1) + (WIDTH - size))
    first, ids = first[by], ids[by]
    begins = np.searchsorted(first, np.arange(n + 1))
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)))
    return first, ids, begins, starts


def relax(units: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """BPE pieces of all units, one after the other, and the number of each unit's.

    A sequence of pieces is what BPE makes of a text exactly if it leaves each two neighbours apart. So of the edges that end at a
    position just one continues the pieces of the text before it. Edges are relaxed by their end's distance from the unit's start, those of all units together; the pieces are then read from the ends back.
    """
    if not units:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    first, ids, _, starts = edges(units, vocab)
    starts, size = starts[:-1], np.fromiter(map(len, units), np.int64, len(units))
    points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(units)), size + 1)
    chars = np.ones(len(points), bool)
    chars[starts + size] = False
    chars = np.flatnonzero(chars)
    start, piece = np.concatenate((first, chars)), np.concatenate((ids, vocab.single[points[chars]]))
    end = start + vocab.sizes[piece]
    far = end - starts[of[start]]
    by = np.argsort(far, kind="stable")
    start, piece, end = start[by], piece[by], end[by]
    cuts = np.searchsorted(far[by], np.arange(1, int(size.max()) + 2)).tolist()
    best = np.full(len(points), -1)  # of each position, the piece that ends there; none at a unit's start
    for a, b in zip(cuts, cuts[1:]):
        ok = vocab.apart(best[start[a:b]], piece[a:b])
        best[end[a:b][ok]] = piece[a:b][ok]
    found, at = [], np.flatnonzero(size > 0)
    pos = starts[at] + size[at]
    while len(at):
        now = best[pos]
        found.append((at, now))
        pos = pos - vocab.sizes[now]
        more = pos > starts[at]
        at, pos = at[more], pos[more]
    of, piece = (np.concatenate(x) for x in zip(*reversed(found))) if found else (np.zeros(0, np.int64),) * 2
    return piece[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=len(units))


class Encoder:
    """Encodes batches of texts; remembers a bounded number of units."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        line_end = [self.v.id["\n"]] if "\n" in self.v.id else [self.v.byte[10]]
        #: ids of each unit, as little-endian bytes
        self.units: dict[str, bytes] = {"": b"", "\n": np.array(line_end, np.int32).tobytes()}

    def _pieces(self, units: list[str]) -> list[bytes]:
        """Units are cut at characters that the vocabulary lacks, which become bytes."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        lacks = self.v.single[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)] < 0
        odd = set(np.unique(np.repeat(np.arange(len(units)), size)[lacks]).tolist())
        known, parts, plain = self.v.chars, {}, []
        for k, u in enumerate(units):
            if k in odd:
                parts[k] = [p for ok, g in itertools.groupby(u, known.__contains__) for p in (["".join(g)] if ok else [(c,) for c in g])]
                plain += [p for p in parts[k] if isinstance(p, str)]
            else:
                plain.append(u)
        flat, n = relax(plain, self.v)
        raw, at = flat.tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
        got = iter([raw[a:b] for a, b in zip(at, at[1:])])
        as_bytes = lambda c: np.array([self.v.byte[b] for b in c.replace(_MARK, SPACE).encode()], np.int32).tobytes()
        return [b"".join(next(got) if isinstance(p, str) else as_bytes(p[0]) for p in parts[k]) if k in odd else next(got) for k in range(len(units))]

    def learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) < INDEX_CHARS):
                size += len(new[end])
                end += 1
            self.units.update(zip(new[at:end], self._pieces(new[at:end])))
            at = end

    def blanks(self, n: int) -> bytes:
        """A run of n white-space marks that no word has taken: from the left, the longest pieces."""
        most = max(self.v.blank)
        return np.array([self.v.blank[most]] * (n // most) + ([self.v.blank[n % most]] if n % most else []), np.int32).tobytes()

    def _joined(self, units: list[str]) -> bytes:
        """Of units among which some are lone white-space marks: these form runs, with a lone mark at the next unit's start."""
        lone, out, waiting = np.array([self.v.id[SPACE]], np.int32).tobytes(), [], 0
        for u in units:
            if u == SPACE:
                waiting += 1
                continue
            got = self.units[u]
            if waiting and u:
                if u[0] == SPACE and got[:4] == lone:
                    waiting, got = waiting + 1, got[4:]
                out.append(self.blanks(waiting))
                waiting = 0
            out.append(got)
        return b"".join(out) + (self.blanks(waiting) if waiting else b"")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as SentencePiece gives them; U+2581, which it can't tell from a space, is written in bytes, so that every text reads back."""
        docs, out, get = [], [], self.units.get
        new: dict[str, None] = {}
        for t in texts:
            if SPACE in t:
                t = t.replace(SPACE, _MARK)
            units = (SPACE + t.replace(" ", _CUT + SPACE).replace("\n", _CUT + "\n" + _CUT)).split(_CUT) if t else []
            got = list(map(get, units))
            docs.append((units, got))
            if None in got:
                new.update(dict.fromkeys(u for u, g in zip(units, got) if g is None and u != SPACE))
        self.learn(list(new))
        for units, got in docs:
            if None in got:
                raw = self._joined(units) if SPACE in units else b"".join(map(get, units))
            else:
                raw = b"".join(got)
            out.append(np.frombuffer(raw, np.int32))
        if len(self.units) > KNOWN_UNITS:  # what came first, and so the frequent ones, stays
            for u in new:
                del self.units[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self._tables
        return b"".join(map(table.__getitem__, ids.tolist())).decode()[1:]

    @functools.cached_property
    def _tables(self) -> list[bytes]:
        table = [p.replace(SPACE, " ").encode() for p in self.v.text]
        for b, i in self.v.byte.items():
            table[i] = bytes([b])
        return table


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return held(("pieces", path), lambda: Encoder(path))


def _slices(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, round_trip) of every whole text, with the given vocabulary file.

    Texts are cut into units at the borders that no piece crosses (before a white-space mark, round a line end and unknown
    characters); distinct units that a worker hasn't met are indexed together (`edges`) and followed to their BPE pieces
    (`relax`). round_trip: decoding the ids gives the text. ids_sha256 is of the ids as little-endian 32-bit integers. Null and empty texts have no ids.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            for part in slices(iter([batch]), 512):
                at = 0
                for texts in _slices([x or "" for x in part.column(1).to_pylist()]):
                    ids = enc.encode(texts)
                    back = [(enc.decode(i) if len(i) else "") == t for i, t in zip(ids, texts)]
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                    digests = pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids])
                    arrays = [part.column(0).slice(at, len(texts)), lists, pa.array(np.diff(offsets).astype(np.int64)), digests, pa.array(back)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"])
                    at += len(texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give an empty text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in it:
            texts = [enc.decode(np.array(i, np.int64)) if i else "" for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
