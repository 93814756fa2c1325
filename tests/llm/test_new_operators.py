"""Hard negatives, repeated windows and source divergence against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and columns of any name."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mined(rows, is_anchor, k=5, n=10, low=30, high=90):
    """Brute force; rows are (id, label, vector)."""
    good = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows if None not in (i, x, v) and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, v in {(i, x, tuple(w)) for i, x, w in good if is_anchor(i)}:
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=True)), i, x) for i, x, w in good if len(w) == len(v)), key=lambda s: s[:2])
        for ps, p, _ in [s for s in scored if s[2] == label and s[1] != a][:k]:
            found = [(-s, i) for s, i, x in scored if x != label and 30 * -ps * low <= 30 * 100 * -s <= 30 * -ps * high]
            out += [(a, p, rank, i, -ps, s) for rank, (s, i) in enumerate(found[:n], 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, chunk string, key int, held string"


def test_hard_negatives_against_all_pairs(spark):
    from sentrylake.llm.negatives import mine

    r = random.Random(11)
    rows = [(i, r.randrange(4), [float(np.float32(r.gauss(0.2, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, i % 3, rows[5][2]) for i in range(60)]  # one vector many times: ties
    rows += [(7, 1, rows[3][2]), (7, 1, rows[3][2]), (10, 2, rows[4][2])]  # repeated ids and rows
    rows += [(None, 1, rows[0][2]), (500, None, rows[0][2]), (501, 1, None), (502, 1, [1.0, None] * 3), (503, 1, [float("nan")] * 6), (504, 2, [float("inf")] * 6)]
    rows += [(510, 1, [0.0] * 6), (520, 1, [0.0] * 6), (511, 2, [0.0] * 6), (530, 0, []), (531, 0, []), (532, 1, []), (540, 3, [1.0]), (541, 3, [2.0]), (542, 1, [1.0]), (-10, 1, [1.0] * 6)]
    table = spark.createDataFrame([(*x, "c", 1, "h") for x in rows], SCHEMA)
    got = mine(table, F.col("vec_id") % 10 == 0, positives=4, negatives=3)
    want = mined(rows, lambda i: i % 10 == 0, 4, 3)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert len({x[0] for x in want}) > 30 and {510, 530, 540} <= {x[0] for x in want}
    assert mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(table, F.col("vec_id") < -100).count() == 0


def test_hard_negatives_of_huge_components_are_exact(spark):
    from sentrylake.llm.negatives import mine

    r = random.Random(3)
    rows = [(i, r.randrange(2), [r.choice([1e5, -3e5, 7.5e6, 2.0**20]) * r.random() for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(x) for x in mine(table, F.col("vec_id") % 5 == 0).collect()) == mined(rows, lambda i: i % 5 == 0)
    huge = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [-1e300]), (3, 2, [1e-3])], "vec_id long, label int, embedding array<double>")
    assert mine(huge, F.col("vec_id") == 0).count() == 0  # scores held at the ends of 64 bits: none is in the window


def kept(texts, length):
    words = [WORDS.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for j in range(k, k + length)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("length", [1, 3, 7, 35])
def test_repeated_windows_against_brute_force(spark, length):
    from sentrylake.llm.repeats import remove_repeats

    r = random.Random(length)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(r.choice("ab cd ef gh é x ZZ".split()) + str(r.randrange(400)) for _ in range(r.randrange(90))) for _ in range(60)]
    texts += [f"{r.random()} {passage} {r.random()}" for _ in range(5)] + [f"x{k}\t\n{passage[: 40 + k]}" for k in range(6)]
    texts += [texts[0]] * 3 + [None, "", "   ", "one", "one", "A a", "w " * 5000, "  " + "long" * 50_000 + " end", "x y \u0085 z"]
    rows = [(k if k % 9 else None, t, "b", "k", 1) for k, t in enumerate(texts)] + [(3, texts[3], "b", "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, kept string, replies int").repartition(5)
    got = sorted((tuple(x) for x in remove_repeats(docs, length).collect()), key=repr)
    want = sorted(((row[0], *k) for row, k in zip(rows, kept([x[1] for x in rows], length), strict=True)), key=repr)
    assert got == want
    assert remove_repeats(docs.limit(0), length).count() == 0


def test_words_cut_in_parts_have_the_same_hashes(monkeypatch):
    from sentrylake.llm import repeats

    r = random.Random(4)
    raw = b" ".join(bytes(r.choice(b"abcdef\xc3\xa9") for _ in range(r.choice([1, 3, 8, 8, 40, 700]))) + r.choice([b"", b"\n", b" \t"]) for _ in range(900)) + b"\n"
    start, end, whole = repeats.tokens(raw)
    assert [raw[a:b] for a, b in zip(start, end, strict=True)] == raw.split()
    assert len(set(whole.tolist())) == len(set(raw.split()))
    assert repeats.levels(35) == [9, 18, 35] and repeats.levels(64) == [8, 16, 32, 64] and repeats.levels(3) == [3]
    monkeypatch.setattr(repeats, "PART", 1000)
    _, _, parts = repeats.tokens(raw)
    assert (parts == whole).all()
    monkeypatch.setattr(repeats, "LONG_WORD", 100)
    start2, end2, long = repeats.tokens(raw)
    assert (start2 == start).all() and (end2 == end).all() and (long == whole)[end - start <= 100].all()
    assert len(set(long.tolist())) == len(set(raw.split()))


def audited(rows, least=3, scale=10**9, top=200):
    split = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(x or "", s or "", split(t)) for x, s, t in rows]
    out = []
    for lang in {x for x, _, _ in rows}:
        docs = collections.Counter(w for x, _, t in rows if x == lang for w in set(t))
        terms = {w for w, n in docs.items() if n >= least}
        sources = sorted({s for x, s, _ in rows if x == lang}, key=lambda s: s.encode())
        n = {s: collections.Counter(w for x, y, t in rows if (x, y) == (lang, s) for w in t if w in terms) for s in sources}
        n[None] = sum(n.values(), collections.Counter())
        size = {s: sum(c.values()) for s, c in n.items()}
        p = {(s, w): 1 + scale * (n[s][w] + 1) // (size[s] + len(terms)) for s in n for w in terms}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(f(p[s, w], p[o, w]) for w in terms), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s, w], p[None, w]), w.encode()) for w in terms if n[s][w] and p[s, w] > p[None, w])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def test_source_divergence_against_brute_force(spark):
    from sentrylake.llm.divergence import audit

    r = random.Random(13)
    vocabulary = ["the", "The", "of", "maison", "straße", "ÉTÉ", "été", "x", "y2k", "don't", "日本"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9)]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "B", "ß", None, "c"]), " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for _ in range(150)]
    rows += [("fr", "a", "un deux"), ("fr", "b", None), ("fr", "z", ""), ("en", "quiet", "12 34 !"), ("one", "a", "mot mot mot"), ("one", "a", "mot"), ("one", "a", "mot")] + [("en", "a", "the same row")] * 4 + [("en", "long", "very " * 300_000)]
    docs = spark.createDataFrame([(*x, "t", 1, 2, 3) for x in rows], "lang string, source string, text string, term string, n int, p int, v int").repartition(3)
    assert sorted(tuple(x) for x in audit(docs, top=7).collect()) == audited(rows, top=7)
    assert sorted(tuple(x) for x in audit(docs, least_docs=1, scale=1000).collect()) == audited(rows, 1, 1000)
    assert audit(docs.limit(0)).count() == 0


def test_documents_without_removal_keep_their_digest(spark):
    from sentrylake.llm.repeats import remove_repeats

    row = remove_repeats(spark.createDataFrame([("k", " a\tb  c ")], "name string, text string"), doc_id="name").selectExpr("*", "sha2(cast(kept as binary), 256) as h").first()
    assert (row.doc_id, row.n_words, row.n_removed, row.h) == ("k", 3, 0, hashlib.sha256(b"a b c").hexdigest())


def test_model_learns_from_every_token(spark):
    import numpy as np

    from sentrylake.llm import lm

    texts = ["a b c a rare", "b", "", "c c c c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "true as train")
    table = lm.Table.of([(b"c", 5), (lm.END, 4), (b"a", 2), (b"b", 2)])
    got = lm._histories([bytes(r.data) for r in lm.positions(docs, table).collect()])
    expected = []
    for t in texts:
        _, word, past = table.ids(lm.tokens(t.encode()))
        before = [lm._BEFORE] * 3 + past.tolist()
        expected += [(w, before[k + 2], before[k + 1], before[k]) for k, w in enumerate(word.tolist())]
    assert sorted(map(tuple, got.tolist())) == sorted(expected) and len(got) == 14
    assert np.array_equal(lm._histories([]).shape, (0, 4))


def test_language_model_groups_in_a_task(spark, monkeypatch):
    """Many groups train in few tasks, each from the common weights: changes that travel are a task's, not a group's."""
    import numpy as np
    from pyspark.sql import functions as F
    from sentrylake.llm import lm

    r = np.random.default_rng(3)
    texts = [(k, r.integers(0, 400, 60).astype(np.int16).tobytes()) for k in range(200)]
    data = spark.createDataFrame([(k, bytearray(t)) for k, t in texts], "part long, data binary")
    made, groups = [], 64
    real = type(data).repartition
    monkeypatch.setattr(type(data), "repartition", lambda self, n, *by: made.append(n) or real(self, n, *by))
    got = lm.fit(data, lm.Weights.start(np.ones(lm.VOCAB)), rounds=1, groups=groups).flat()
    start, total, n = lm.Weights.start(np.ones(lm.VOCAB)).flat(), 0.0, 0
    for g in range(groups):
        own = lm.Weights.of(start)
        rows = lm._histories([t for k, t in sorted(texts) if k % groups == g])
        own.train(rows[np.random.default_rng(len(rows)).permutation(len(rows))], 0.15)
        total, n = total + (own.flat() - start).astype(np.float64) * len(rows), n + len(rows)
    assert made[0] < groups and np.abs(got - (start + total / n)).max() < 1e-4


def test_runs_make_only_pairs_that_bitmaps_allow():
    from sentrylake.llm import shingles

    r = np.random.default_rng(5)
    base = r.integers(1, 1 << 62, 90)
    sets = [np.unique(np.concatenate((base[: r.integers(20, 80)], r.integers(1, 1 << 62, r.integers(1, 60))))).astype(np.uint64) for _ in range(150)]
    sets.sort(key=len)
    bits = [shingles.bitmap(x) for x in sets]
    rows = np.array([(1, 0, len(x), k, k % 7) for k, x in enumerate(sets)], np.int64)
    fits = [(a, b) for b in range(150) for a in range(b) if rows[a, 4] != rows[b, 4] and 5 * len(sets[a]) >= 4 * len(sets[b])]
    want = {(a, b) for a, b in fits if 9 * shingles.most_common(bits[a], bits[b], len(sets[a]), len(sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    batches = [pa.RecordBatch.from_arrays([*(pa.array(rows[s, k].copy()) for k in range(5)), pa.array(bits[s], pa.binary())], names=["key", "part", "n", "digest", "c", "bits"]) for s in (slice(0, 64), slice(64, 150))]
    got = {p for out in shingles._crossing((4, 5))(iter(batches)) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert got == want and len(want) < len(fits) / 2
    assert {tuple(x) for y in shingles._room(rows, bits, (4, 5), words=64) for x in zip(*(z.tolist() for z in y))} == want


def test_the_rarest_of_frequent_shingles_come_first():
    from sentrylake.llm import shingles

    found, common = np.arange(1, 101, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64)
    assert shingles.prefix(found, common, (4, 5), np.arange(100, 0, -1)).tolist() == list(range(100, 79, -1))
