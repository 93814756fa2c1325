"""The search of one task over several shards, against brute force."""

from __future__ import annotations

import collections
import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest


class Sent:
    def __init__(self, value):
        self.value = value


def shards_of(s, texts, size):
    names = [f.split()[0] for f in s._INDEX.split(", ")]
    out = []
    for at in range(0, len(texts), size):
        shard = s._Shard()
        shard.add(list(range(at, min(at + size, len(texts)))), [t.encode() for t in texts[at : at + size]])
        out.append(dict(zip(names, shard.row())))
    return out


def block_of(s, texts, asked):
    terms = [(q, t.encode(), float(c)) for q in asked for t, c in collections.Counter(texts[q].split()).items()]
    return s.Queries.of(pa.table({"q": [x[0] for x in terms], "h": [0] * len(terms), "token": pa.array([x[1] for x in terms], pa.binary()), "w": [x[2] for x in terms]}))


def brute(texts, q, mean, k):
    counts = [collections.Counter(t.split()) for t in texts]
    score = [(round(sum(f * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, f in counts[q].items()), 8), i) for i, c in enumerate(counts)]
    return [i for _, i in sorted((-x, i) for x, i in score if x > 0)[:k]]


def found(s, rows, queries, mean, k):
    batches = [pa.RecordBatch.from_pylist([row]) for row in rows]
    got, sent = collections.defaultdict(list), 0
    for batch in s._searcher(Sent(queries), mean, k)(iter(batches)):
        for place, doc, score in zip(*(c.to_pylist() for c in batch.columns[1:])):
            place, doc, score = np.frombuffer(place, np.int64), np.frombuffer(doc, np.int64), np.frombuffer(score)
            sent += len(place)
            for p, i, x in zip(place.tolist(), doc.tolist(), score.tolist()):
                got[int(queries.ids[p])].append((-x, i))
    return {q: [i for _, i in sorted(x)[:k]] for q, x in got.items()}, sent


@pytest.mark.parametrize(("dense", "queries_at_once"), [(1 / 20, 512), (1 / 3, 2), (2, 512)])
def test_a_task_sends_each_querys_best_once_however_many_shards_it_has(monkeypatch, dense, queries_at_once):
    from sentrylake.llm import search as s

    monkeypatch.setattr(s, "DENSE", dense)
    monkeypatch.setattr(s, "QUERIES", queries_at_once)
    monkeypatch.setattr(s, "POSTINGS", 50, raising=False)
    r = random.Random(3)
    kinds = [[f"{c}{k}" for k in range(90)] for c in "abc"]
    texts = [" ".join(r.choice(kinds[k % 3])[: r.choice([2, 3])] for _ in range(r.randint(0, 60))) for k in range(400)]
    texts += [texts[7]] * 9 + [""] + ["a1 " * 70_000]
    asked, k = [7, 10, 20, 33, 300, 7 + 393], 5
    mean = sum(len(t.split()) for t in texts) / len(texts)
    got, sent = found(s, shards_of(s, texts, 40), block_of(s, texts, asked), mean, k)
    for q in asked:
        assert got.get(q, []) == brute(texts, q, mean, k)
    assert sent <= k * len(asked)


def test_scores_nearer_than_single_precision_are_told_apart():
    from sentrylake.llm import search as s

    same = " ".join(f"w{k}" for k in range(400))
    texts = [same + f" only{k}" for k in range(60)]  # a query's own word decides; other words' scores are alike
    queries = block_of(s, texts, [5, 41])
    rows, n_words = shards_of(s, texts, 20), 401
    count = np.bincount(queries.terms)
    # the word that one document alone has weighs less than the single precision of the sum
    queries = dataclasses.replace(queries, weights=np.where(count[queries.terms] == 1, 1e-4, 1000.0))
    got, _ = found(s, rows, queries, n_words, 3)
    assert got[5][0] == 5 and got[41][0] == 41
    assert got[5][1:] == [0, 1] and got[41][1:] == [0, 1]


def test_words_whose_keys_are_alike_in_their_first_half(monkeypatch):
    from sentrylake.llm import search as s

    real = s.xxhash.xxh3_128_digest

    class Alike:
        xxh3_128_digest = staticmethod(lambda token: bytes(8) + real(token)[8:])

    r = random.Random(4)
    texts = [" ".join(f"x{r.randint(0, 40)}" for _ in range(r.randint(1, 25))) for _ in range(90)]
    mean = sum(len(t.split()) for t in texts) / len(texts)
    monkeypatch.setattr(s, "xxhash", Alike)
    got, _ = found(s, shards_of(s, texts, 30), block_of(s, texts, [0, 50]), mean, 4)
    assert got == {q: brute(texts, q, mean, 4) for q in (0, 50)}


def test_words_of_odd_texts_are_those_of_split():
    from sentrylake.llm import search as s

    r = random.Random(6)
    letters = [bytes([i]) for i in range(256)] + [b" "] * 60 + [b"A", b"\xc3\x84", b"\xc2\xa0", b"\xe2\x80\x83"] * 10
    for _ in range(60):
        raws = [b"".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 8))]
        words, ends = s._split(raws)
        words, ends = words.to_pylist(), ends.tolist()
        assert [words[a:b] for a, b in zip(ends, ends[1:])] == [x.lower().split() for x in raws]
