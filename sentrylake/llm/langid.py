"""Language identification by cross-parsing entropy."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import bounded, crc_of_id, cut, held, slices, thinned

#: Symbols: 0 stands for a run of characters that aren't letters, 62 for letters outside the alphabet, 63 pads.
SPACE, OTHER, PAD, WIDTH = 0, 62, 63, 64
#: Texts are parsed in blocks of so many symbols; a phrase that is open at a block's end closes there.
BLOCK = 512
#: Code points that are parsed at a time.
SLICE = 1 << 20


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (of several code points, the first)."""
    is_letter, lower = np.zeros(sys.maxunicode + 1, bool), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c))[0] == "L":
            is_letter[c], lower[c] = True, ord(ch.lower()[0])
    return is_letter, lower


def sample(docs: DataFrame, rows_per_lang: int = 200, chars_per_row: int = 80) -> dict[str, str]:
    """Training text per language from a bounded sample of its distinct texts: those with the smallest hashes, `rows_per_lang` of each language, and of each a passage of `chars_per_row` characters at a hashed place. Copies count once.

    All that is sampled is learned, so the two parameters bound what the model and its tables hold.
    Thinning leaves about 20 times as many distinct texts as are wanted, or all if there are no more, so no language loses its sample.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = bounded(cut(labelled.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count()))
    rows = labelled.select("lang", F.xxhash64("text").alias("h"), F.substr("text", (F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars_per_row + 1, F.lit(1))) + 1).cast("int"), F.lit(chars_per_row)).alias("text"))
    rows = rows.join(sizes, "lang").where(thinned(F.col("h"), 20 * rows_per_lang, F.col("count")))
    rows = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_lang)
    out: dict[str, list[str]] = {}
    for lang, text in rows.orderBy("lang", "n").select("lang", "text").collect():
        out.setdefault(lang, []).append(text)
    return {k: "\n".join(v) for k, v in sorted(out.items())}


class Automaton:
    """Suffix automaton of a symbol sequence: recognises exactly its substrings."""

    def __init__(self, symbols: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p, last = last, new
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] != length[p] + 1:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = twin
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    q = twin
                link[new] = q

    def table(self, base: int) -> np.ndarray:
        """Per state and symbol: (offset of the next state) * 2 + 1 if a phrase ended, for states from `base` on.

        A symbol that doesn't extend the phrase ends it and begins the next one.
        """
        t = np.zeros((len(self.next), WIDTH), np.int64)
        root = np.zeros(WIDTH, np.int64)
        for c, s in self.next[0].items():
            root[c] = s
        t[:] = (base + root) * WIDTH * 2 + 1
        for s, edges in enumerate(self.next):
            for c, to in edges.items():
                t[s, c] = (base + to) * WIDTH * 2
        t[:, PAD] = (base + np.arange(len(t))) * WIDTH * 2
        return t.ravel()


class Model:
    def __init__(self, texts: dict[str, str]):
        """texts: per language; all is learned, and tables grow with it (`sample` bounds it)."""
        is_letter, lower = _letters()
        points = {k: np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) for k, v in texts.items()}
        common = Counter()
        for p in points.values():
            kind, n = np.unique(lower[p[is_letter[p]]], return_counts=True)
            common.update(dict(zip(kind.tolist(), n.tolist())))
        alphabet = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[: OTHER - 1]]
        self.symbol = np.where(is_letter, OTHER, SPACE).astype(np.uint8)
        known = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        known[alphabet] = np.arange(1, len(alphabet) + 1)
        self.symbol[is_letter] = known[lower[is_letter]]
        self.langs, tables, base, self.start, self.cost = list(texts), [], 0, [], []
        for lang in self.langs:
            symbols, _ = self.symbols(points[lang], np.array([0]))
            t = Automaton(bytes(symbols)).table(base)
            self.start.append(base * WIDTH * 2)
            # a phrase is a place in the training text or, where no phrase fits, one of the symbols; without the latter a language of a few letters would cost next to nothing
            self.cost.append(np.log2(len(symbols) + WIDTH))
            tables.append(t)
            base += len(t) // WIDTH
        self.table = np.concatenate(tables).astype(np.int32 if base * WIDTH * 2 < 2**31 else np.int64) if tables else np.zeros(0, np.int32)

    def symbols(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of concatenated texts, runs of SPACE as one, and where each text now starts."""
        s = self.symbol[points]
        keep = s != SPACE
        keep[1:] |= s[:-1] != SPACE
        keep[:1] = True
        keep[starts[starts < len(s)]] = True
        return s[keep], np.concatenate(([0], np.cumsum(keep)))[starts]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text (rows) in each language, and whether it has a letter."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        s, start = self.symbols(points, np.cumsum(size) - size)
        n = np.diff(np.append(start, len(s)))
        of = np.repeat(np.arange(len(texts)), n)
        letter = np.bincount(of[s != SPACE], minlength=len(texts)) > 0
        blocks = -(-n // BLOCK)
        lane = np.repeat(np.cumsum(blocks) - blocks, n) + (np.arange(len(s)) - np.repeat(start, n)) // BLOCK
        grid = np.full((BLOCK, int(blocks.sum())), PAD, np.uint8)
        grid[(np.arange(len(s)) - np.repeat(start, n)) % BLOCK, lane] = s
        state = np.repeat(np.array(self.start, self.table.dtype)[:, None], grid.shape[1], axis=1)
        phrases = np.zeros(state.shape, np.int32)
        for row in grid:
            state = self.table[(state >> 1) + row]
            phrases += state & 1
        total = np.zeros((len(self.langs), len(texts)))
        owner = np.repeat(np.arange(len(texts)), blocks)
        for k in range(len(self.langs)):
            total[k] = np.bincount(owner, phrases[k] + 1, minlength=len(texts))
        return (total * np.array(self.cost)[:, None] / np.maximum(n, 1)).T, letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                size += len(texts[end] or "")
                end += 1
            part = [x or "" for x in texts[at:end]]
            if not self.langs:
                langs += ["und"] * len(part)
                scores.append(np.zeros(len(part)))
            else:
                bits, letter = self.entropies(part)
                order = np.sort(bits, axis=1)
                best = bits.argmin(axis=1)
                margin = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(part))
                langs += [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist())]
                scores.append(np.where(letter, np.clip(margin, 0, 1), 0.0))
            at = end
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    """Built once per Python worker, from the bounded sample that travels with the task."""
    return held(("language", texts), lambda: Model(dict(texts)))


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score; texts: training text per language (`sample`).

    A text is parsed greedily into the longest phrases that occur in a language's training text. Few phrases mean
    that the language explains the text; phrases times log2 of the training length plus the number of symbols (an escape), per symbol, is the cross-parsing
    entropy (Ziv and Merhav, 1993), and the least wins, ties by the language's name. A phrase also ends after BLOCK symbols, in every language alike. score is 1 - least / second least. Whole texts are
    read: case is folded, every run of other characters is one symbol. A null text, one without a letter, or an
    empty training set gives `und` and 0. Columns named lang_pred or score are replaced.
    """
    given = tuple(sorted(texts.items()))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(given)
        for batch in slices(it):
            langs, scores = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The documents to learn from: crc32 of the id, modulo `folds`, is not `held_out`; rows without an id are left out."""
    return docs.where((crc_of_id(F.col("doc_id"), folds) != held_out) & F.col("doc_id").isNotNull())


def keep_known(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The documents in a learned language, with the columns of `docs`; those without a letter go. Where no language is learned, every document with a letter stays."""
    if not texts:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    prefixed = docs.select([F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])
    kept = identify(prefixed, texts, "own_text").where("lang_pred <> 'und'")
    return kept.select([F.col(f"`own_{c}`").alias(c) for c in docs.columns])
