"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, utf8, written

#: The token after the last word; no word is white space.
END = b"\n"
#: Most frequent training tokens whose counts every task holds: a fixed bound. The counts of others are joined.
COMMON = 262_144
#: Classes of the softmax, and words of each; word 0 stands for all that the model has no weights for.
CLASSES, PER_CLASS = 16, 32
VOCAB = CLASSES * PER_CLASS
#: Rows of the hashed weights of classes and of words.
CLASS_ROWS, WORD_ROWS = 2048, 512
#: Ids of the history: the vocabulary's, then one before the text, then hashed other tokens.
_BEFORE, _HASHED = VOCAB, 4096
_CHUNK = 1 << 17
#: Positions in a group of the training, about.
GROUP_POSITIONS = 100_000


def tokens(raw: bytes) -> list[bytes]:
    """Words in lower case (A-Z) and one END."""
    out = raw.lower().split()
    out.append(END)
    return out


def token_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(token binary, c long) over the training rows of (text, train boolean). A task adds up its rows and hands on at most `most` tokens at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])
            seen.clear()
            return out

        for batch in it:
            for raw in utf8(batch.column(0)):
                seen.update(tokens(raw))
                if len(seen) > most:
                    yield flush()
        yield flush()

    return docs.where("train").select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Tokens by falling count, at most `most`: all those above the lowest count level that leaves no more. Levels are 64 a power of e, so that neither they nor the result grow with the input."""
    level = F.floor(F.log("c") * 64)
    left, lowest = most, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        lowest = r.level
    if lowest is None:
        return []
    rows = counts.where(level >= lowest).toArrow()
    return sorted(zip(rows["token"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


def _mix(kind: int, *ids: np.ndarray) -> np.ndarray:
    h = np.full(len(ids[0]), kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _row(n: int, h: np.ndarray) -> np.ndarray:
    return 1 + (h % np.uint64(n - 1)).astype(np.int64)


#: Rows of the features of one id alone: three of the class weights, two of the word weights.
_IDS = np.arange(_HASHED)
_OF_ONE = tuple(_row(n, _mix(kind, _IDS)) for kind, n in ((1, CLASS_ROWS), (3, CLASS_ROWS), (4, CLASS_ROWS), (5, WORD_ROWS), (6, WORD_ROWS)))


def features(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class weights (5 x n) and of the word weights (3 x n) that a history sets: a bias, the last token, the last two, and skips to the second and third last."""
    none = np.zeros(len(h1), np.int64)
    classes = (none, _OF_ONE[0].take(h1), _row(CLASS_ROWS, _mix(2, h1, h2)), _OF_ONE[1].take(h2), _OF_ONE[2].take(h3))
    return np.stack(classes), np.stack((none, _OF_ONE[3].take(h1), _OF_ONE[4].take(h2)))


def summed(g: np.ndarray, rows: np.ndarray, few: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in `rows` (features x positions, below 2^15), and of each the sum of the rows of `g` (32 bits, an even number of columns) at its positions. Sums of up to `few` are added turn by turn for all at once."""
    flat = rows.astype(np.int16).ravel()
    order = np.argsort(flat, kind="stable")  # of 16 bits, by radix
    sorted_, at = flat[order], order % len(g)
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    size = np.diff(np.append(first, len(flat)))
    out = g.take(at[first], axis=0)
    light = np.flatnonzero((size > 1) & (size <= few))
    for k in range(1, few):
        light = light[size[light] > k]
        out[light] += g.take(at[first[light] + k], axis=0)
    heavy = size > few
    if heavy.any():
        n = size[heavy]
        # two columns as one complex number: half as many steps
        out[heavy] = np.add.reduceat(g.take(at[np.repeat(heavy, size)], axis=0).view(np.complex64), np.cumsum(n) - n, axis=0).view(np.float32)
    return sorted_[first].astype(np.int64), out


@dataclass
class Weights:
    """Weights of classes, and of the words within each class, per hashed feature."""

    classes: np.ndarray = field(default_factory=lambda: np.zeros((CLASS_ROWS, CLASSES), np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros((WORD_ROWS * CLASSES, PER_CLASS), np.float32))
    sums: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def start(mass: np.ndarray) -> Weights:
        """Biases that give every word the share of its count; mass: counts by word id."""
        out, by = Weights(), np.maximum(mass.reshape(CLASSES, PER_CLASS), 1e-2)
        out.classes[0] = np.log(by.sum(axis=1) / by.sum())
        out.words[:CLASSES] = np.log(by / by.sum(axis=1, keepdims=True))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate((self.classes.ravel(), self.words.ravel()))

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        n = CLASS_ROWS * CLASSES
        return Weights(flat[:n].reshape(CLASS_ROWS, CLASSES).copy(), flat[n:].reshape(-1, PER_CLASS).copy())

    def forward(self, target: np.ndarray, fc: np.ndarray, fw: np.ndarray) -> tuple[np.ndarray, ...]:
        """Log probability (natural) of each target, the two distributions, and the rows of word weights."""
        cls, word, at = target // PER_CLASS, target % PER_CLASS, np.arange(len(target))
        rows = fw * CLASSES + cls
        a, b = self.classes[0] + self.classes.take(fc[1], axis=0), self.words.take(rows[0], axis=0)
        for r in fc[2:]:
            a += self.classes.take(r, axis=0)
        for r in rows[1:]:
            b += self.words.take(r, axis=0)
        logp = np.zeros(len(target))
        dists = []
        for z, pick in ((a, cls), (b, word)):
            z -= z.max(axis=1, keepdims=True)
            picked = z[at, pick]
            total = np.exp(z, out=z).sum(axis=1)
            logp += picked - np.log(total)
            z /= total[:, None]
            dists.append(z)
        return logp, dists[0], dists[1], rows

    def train(self, data: np.ndarray, rate: float, batch: int = 1024) -> None:
        """Stochastic gradient steps (Adagrad, whose sums go on from call to call) over positions: rows of target and the last three ids."""
        if not self.sums:
            self.sums += [np.full(len(self.classes), 0.1, np.float32), np.full(len(self.words), 0.1, np.float32)]
        sums = self.sums
        for at in range(0, len(data), batch):
            x = data[at : at + batch].astype(np.int64)
            fc, fw = features(x[:, 1], x[:, 2], x[:, 3])
            _, pa_, pb, rows = self.forward(x[:, 0], fc, fw)
            pa_[np.arange(len(x)), x[:, 0] // PER_CLASS] -= 1
            pb[np.arange(len(x)), x[:, 0] % PER_CLASS] -= 1
            for w, s, r, g in ((self.classes, sums[0], fc, pa_), (self.words, sums[1], rows, pb)):
                u, g = summed(g, r)
                now = s.take(u) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
                s[u] = now
                g *= (rate / np.sqrt(now))[:, None].astype(np.float32)
                w[u] = w.take(u, axis=0) - g


@dataclass(frozen=True)
class Table:
    """Counts of the common tokens, and what the model calls them."""

    index: dict[bytes, int]
    log_c: np.ndarray  # log10(c + 0.1)
    word: np.ndarray  # id in the vocabulary, 0 for others
    past: np.ndarray  # id as history

    @staticmethod
    def of(common: list[tuple[bytes, int]]) -> Table:
        """common: by falling count. The first VOCAB - 1 are the model's words, classes of like frequency."""
        n = len(common)
        word = np.where(np.arange(n) < VOCAB - 1, np.arange(1, n + 1), 0)
        past = np.array([w or _other(t) for w, (t, _) in zip(word.tolist(), common)], np.int64).reshape(-1)
        return Table({t: k for k, (t, _) in enumerate(common)}, np.log10(np.array([c for _, c in common], np.float64) + 0.1), word, past)

    def ids(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each token (-1: not common), word id and history id."""
        get = self.index.get
        idx = np.array([get(t, -1) for t in found], np.int64)
        rare = np.flatnonzero(idx < 0)
        word, past = (x[idx] if len(x) else np.zeros(len(idx), np.int64) for x in (self.word, self.past))
        word[rare] = 0
        past[rare] = [_other(found[k]) for k in rare.tolist()]
        return idx, word, past


def _other(token: bytes) -> int:
    return VOCAB + 1 + zlib.crc32(token) % (_HASHED - VOCAB - 1)


def _shift(past: np.ndarray, start: np.ndarray, by: int) -> np.ndarray:
    """History ids `by` tokens back; _BEFORE at less than that from a text's start."""
    out = np.concatenate((np.full(by, _BEFORE), past))[: len(past)]
    for k in range(by):
        at = start + k
        out[at[at < len(out)]] = _BEFORE
    # a short text's neighbours must not shine through
    n = np.diff(np.append(start, len(past)))
    pos = np.arange(len(past)) - np.repeat(start, n)
    return np.where(pos < by, _BEFORE, out)


def positions(docs: DataFrame, table: Table) -> DataFrame:
    """(part, data): of every training text the history ids of all its tokens as 16-bit numbers, of which `_histories` makes positions. part is a hash of id and text, which deals copies out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data = [table.ids(tokens(raw))[2].astype(np.int16).tobytes() for raw in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, pa.binary())], names=["part", "data"])

    return docs.where("train").select("text", F.xxhash64("doc_id", "text").alias("part")).mapInArrow(run, "part long, data binary")


def _histories(texts: list[bytes], stride: int = 1) -> np.ndarray:
    """A row for each token of the texts, or for one in `stride`, as `positions` gives them: its word id and the three history ids before it."""
    past = np.frombuffer(b"".join(texts), np.int16)
    size = np.array([len(t) // 2 for t in texts], np.int64)
    start = np.cumsum(size) - size
    return np.stack((np.where(past < VOCAB, past, 0), *(_shift(past, start, k) for k in (1, 2, 3))), axis=1)[::stride].astype(np.int16)


def fit(data: DataFrame, weights: Weights, rounds: int = 3, groups: int = 32, rate: float = 0.15, slices: int = 32, stride: int = 1) -> Weights:
    """Weights trained from the given ones. Iterative parameter mixing (McDonald et al., 2010): each round, every group of positions takes gradient steps from the common weights, and the
    changes are averaged by the groups' sizes. A task trains its groups, eight or so, one after another, and gives the sum of their changes; these are added up in Spark, by slices of the weights; the driver
    gets their sum, of fixed size."""
    tasks = max(min(groups, 32), -(-groups // 8))
    data = data.withColumn("group", F.pmod("part", F.lit(groups)).cast("int"))
    for r in range(rounds):
        now = weights.flat()

        def change(it: Iterator[pa.RecordBatch], now: np.ndarray = now, step: float = rate / (1 + r)) -> Iterator[pa.RecordBatch]:
            total, n, own, group, size = np.zeros(len(now), np.float32), 0, Weights.of(now), None, 0
            for batch in it:
                ids = batch.column(0).to_numpy()
                for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []):
                    if ids[lo] != group:  # the next group begins at the common weights again
                        total += (own.flat() - now) * np.float32(size)
                        own, group, size = Weights.of(now), ids[lo], 0
                    rows = _histories(batch.column(1).slice(lo, hi - lo).to_pylist(), stride)
                    own.train(rows[np.random.default_rng(len(rows)).permutation(len(rows))], step)
                    size += len(rows)
                    n += len(rows)
            if n:
                parts = np.array_split(total + (own.flat() - now) * np.float32(size), slices)
                yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()), pa.array([n] * slices, pa.int64())], names=["slice", "d", "n"])

        def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            count: Counter[int] = Counter()
            for batch in it:
                for k, d, n in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(d, np.float32).astype(np.float64)
                    sums[k] = sums[k] + x if k in sums else x
                    count[k] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array([count[k] for k in sums], pa.int64())], names=["slice", "d", "n"])

        changes = data.repartition(tasks, "group").sortWithinPartitions("group", "part", "data").select("group", "data").mapInArrow(change, "slice int, d binary, n long")
        summed = changes.repartition(min(slices, 8), "slice").mapInArrow(add, "slice int, d binary, n long").collect()
        if not summed:
            return weights
        by = {x.slice: np.frombuffer(x.d, np.float64) / x.n for x in summed}
        weights = Weights.of((now + np.concatenate([by[k] for k in range(slices)])).astype(np.float32))
    return weights


def _scored(table: Table, weights: Weights, raws: list[bytes]) -> Iterator[tuple[int, int, float, float, int, float, list[bytes]]]:
    """Per text: tokens, common tokens, sum of their log10(c + 0.1), that of those which the model has no weights for, how many tokens it has none for, the model's log10 probability, and the rare tokens."""
    at = 0
    while at < len(raws):
        found, size = [], []
        while at < len(raws) and (not size or len(found) < _CHUNK):
            t = tokens(raws[at])
            found += t
            size.append(len(t))
            at += 1
        idx, word, past = table.ids(found)
        start = np.cumsum(size) - size
        back = [_shift(past, start, k) for k in (1, 2, 3)]
        logp = np.empty(len(found))
        for a in range(0, len(found), _CHUNK):
            s = slice(a, a + _CHUNK)
            logp[s] = weights.forward(word[s], *features(*(b[s] for b in back)))[0]
        common = idx >= 0
        log_c = np.where(common, table.log_c[idx] if len(table.log_c) else 0.0, 0.0)
        add = lambda x: np.add.reduceat(x, start)
        rows = zip(size, add(common.astype(np.int64)).tolist(), add(log_c).tolist(), add(np.where(word == 0, log_c, 0.0)).tolist(), add((word == 0).astype(np.int64)).tolist(), (add(logp) / np.log(10)).tolist(), start.tolist())
        for n, known, base, other, n_other, lm, s in rows:
            yield n, known, base, other, n_other, lm, [found[s + k] for k in np.flatnonzero(~common[s : s + n]).tolist()]


def score(docs: DataFrame, folds: int = 10, held_out: int = 0, stride: int = 1, rounds: int = 3, common: int = COMMON, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Rows whose crc32 of the id, modulo `folds`, is `held_out` are not learned from; rows without an id are learned from.
    base_score is that of the unigram model with 0.1 added to every count and one unknown token; counts cover all training texts.
    score is the log10 probability by a maximum-entropy model of hashed n-gram and skip features: the probability of the class, times that of
    the word in it. Words outside the model's vocabulary share its word 0 by their counts. The model is trained on every token of every
    training text (a caller may ask for one in `stride`), by gradient steps in all partitions (`fit`). Counts of the `common` most frequent tokens travel with the tasks, a fixed
    number; those of all others are joined, (text, token) by token. A null text is empty and has the end token alone. Rows of equal id and text
    are scored together and returned as often as they occur. An empty table gives no rows.
    """
    fold = crc_of_id(F.col(doc_id), folds)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold == held_out).alias("held_out"), (fold != held_out).alias("train"))
    counts = written(token_counts(rows))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    table = Table.of(most_frequent(counts, common))
    in_vocab = min(len(table.log_c), VOCAB - 1)
    mass = np.zeros(VOCAB)
    mass[1 : in_vocab + 1] = 10 ** table.log_c[:in_vocab] - 0.1
    held = float(mass.sum())
    mass[0] = n - held
    groups = int(min(1024, max(1, -(-n // (stride * GROUP_POSITIONS)))))
    weights = fit(written(positions(rows, table)), Weights.start(mass), rounds, groups, stride=stride)
    log_all, log_other = (float(np.log10(a + 0.1 * (b + 1))) for a, b in ((n, v), (max(0.0, n - held), v - in_vocab)))
    shared = docs.sparkSession.sparkContext.broadcast((table, weights))
    fields = "doc_id long, h long, held_out boolean, n_tokens long, n_common long, base double, other double, n_other long, lm double, rare array<binary>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = shared.value
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary())]
        names = ["doc_id", "h", "held_out", "n_tokens", "n_common", "base", "other", "n_other", "lm", "rare"]
        for batch in it:
            got = list(zip(*_scored(table, weights, utf8(batch.column(3))))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(got, kinds))], names=names)

    scored = written(rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "held_out", "text").mapInArrow(run, fields))
    asked = scored.select("doc_id", "h", F.explode("rare").alias("token"))
    told = asked.join(counts, "token", "left").select("doc_id", "h", F.log10(F.coalesce("c", F.lit(0)) + 0.1).alias("rare"), F.col("c").isNotNull().cast("long").alias("found"))
    own = ["held_out", "n_tokens", "n_common", "base", "other", "n_other", "lm"]
    both = scored.select("doc_id", "h", *own, F.lit(0.0).alias("rare"), F.lit(0).cast("long").alias("found"), F.lit(1).alias("one"))
    both = both.unionByName(told.withColumn("one", F.lit(0)), allowMissingColumns=True)
    all_ = both.groupBy("doc_id", "h").agg(*[F.max(c).alias(c) for c in own], F.sum("rare").alias("rare"), F.sum("found").alias("found"), F.sum("one").alias("times"))
    rare = F.col("rare") / F.col("times")
    out = all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.col("found") / F.col("times")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("lm") + F.col("other") + rare - F.col("n_other") * F.lit(log_other)).alias("score"),
        "times",
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
