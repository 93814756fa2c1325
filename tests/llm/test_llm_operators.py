"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, lang_pred string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    kinds = {"en": "the of and to in that is was thing house", "de": "der die und das nicht von haus ist ein mit", "fr": "le la les des une est dans que maison pas"}
    rows = []
    for i in range(120):
        lang = r.choice(list(kinds))
        rows.append((i, " ".join(r.choice(kinds[lang].split()) + r.choice(["", "", "s", "en"]) for _ in range(r.randint(5, 120))), lang, r.choice(["a", "b", "c", None])))
    base = rows[3][1]
    rows += [(200, base, "en", "a"), (201, base, "en", "a"), (202, base.replace(" ", "  ").upper(), "en", "b"), (202, base.replace(" ", "  ").upper(), "en", "b")]
    rows += [(300, None, "en", "a"), (301, "", None, "b"), (302, "... 123", "de", None), (None, "the thing was in that house", "en", "a"), (303, "word " * 30_000, "en", "c")]
    return rows


def union_find(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_repeated_edges(spark):
    from sentrylake.llm.components import components

    r = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(5, 5), (None, 3), (7, 6)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    root = union_find(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges if a is not None and b is not None and a != b])
    assert got == {n: nodes[root[k]] for k, n in enumerate(nodes)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, width=4):
    w = WORDS.findall(lower(text))
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, corpus):
    from sentrylake.llm.simhash import deduplicate, near_duplicates

    docs = make(spark, corpus)
    fps = [fingerprint(t) for _, t, *_ in corpus]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = union_find(len(fps), pairs)
    ids = collections.defaultdict(list)
    for k, (i, *_) in enumerate(corpus):
        if i is not None:
            ids[root[k]].append(i)
    want = sorted(((i, fps[k], min(ids[root[k]], default=None)) for k, (i, *_) in enumerate(corpus)), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "segments"), [(4, 2), (3, 2), (3, 4), (2, 1)])
def test_simhash_links_in_blocks_of_hot_keys(spark, most, segments):
    from sentrylake.llm.components import components
    from sentrylake.llm.simhash import links

    r = random.Random(most)
    fps = [r.getrandbits(64) for _ in range(40)]
    near = fps[0]
    fps += list({near ^ sum(1 << r.randrange(20) for _ in range(r.randint(0, 6))) for _ in range(300)})
    fps = sorted({f % 2**64 for f in fps})
    root = union_find(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= most])
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    edges = links(table, most, segments, cap=16).distinct()
    assert all(((a % 2**64) ^ (b % 2**64)).bit_count() <= most for a, b in edges.collect())
    got = {x.node % 2**64: x.component for x in components(edges).collect()}
    groups = collections.defaultdict(set)
    for k, f in enumerate(fps):
        groups[root[k]].add(f)
    for members in groups.values():
        assert len({got.get(f, ("alone", f)) for f in members}) == 1


@pytest.mark.parametrize("block", [4096, 8])
def test_shingle_stage_against_all_pairs(spark, corpus, block):
    import corpus_pipeline
    from sentrylake.llm.shingles import near_duplicates

    r = random.Random(11)
    line = "one line that stands in very many of these texts and says nothing at all"
    rows = list(corpus)
    for k in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(30, 200))]
        for c in range(4):
            edited = list(words)
            for at in r.sample(range(len(words)), min(len(words), c * r.choice([1, 1, 2, 3]) * len(words) // 120 + (c > 0))):
                edited[at] = f"new{r.randrange(10**6)}"
            rows.append((1000 + 10 * k + c, " ".join(edited) + (" " + line if k % 2 else ""), "en", "a"))
    hot = [f"h{k}" for k in range(150)]
    rows += [(3000 + k, " ".join(hot[:k] + [f"x{k}"] + hot[k + 1 :]), "en", "b") for k in range(60)]
    # alike at 0.8 exactly (4 of 5 shingles), and just below (3 of 4)
    rows += [(4000, "a b c d e f g h i", "en", "a"), (4001, "a b c d e f g h", "en", "a"), (4100, "j k l m n o p q", "en", "a"), (4101, "j k l m n o p", "en", "a")]

    def found(t):
        w = WORDS.findall(lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [found(t) for _, t, *_ in rows]
    like = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))
    root = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if like(sets[a], sets[b])])
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = sorted(((i, least.get(root[k])) for k, (i, *_) in enumerate(rows)), key=repr)
    docs = make(spark, rows)
    assert sorted(((x.doc_id, x.component_id) for x in near_duplicates(docs, block=block).collect()), key=repr) == want
    assert near_duplicates(docs.limit(0)).count() == 0
    if block == 4096:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(least.values()))


def test_embeddings_against_all_pairs(spark):
    from sentrylake.llm.embed import near_duplicates

    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    rows = []
    for k in range(220):
        v = base[r.integers(12)] + r.normal(0, 0.12, 16)
        rows.append((k, v.astype(np.float32).tolist(), int(r.integers(3)) if k % 40 else None))
    rows += [(500, rows[1][1], rows[1][2]), (501, rows[1][1], rows[1][2]), (501, rows[1][1], rows[1][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] + [1.0] * 15, 1), (505, [None] + [1.0] * 15, 1), (506, [], 1), (507, [1.0, 2.0], 1), (508, [float("inf")] * 16, 1)]
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in ok}
    pairs = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root = union_find(len(rows), pairs + [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0]])
    n = collections.Counter(x for p in pairs for x in p)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    want = sorted((i, n[k], least[root[k]], i == least[root[k]]) for k, (i, *_) in enumerate(rows))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as unit")
    for options in ({}, {"cells": 4, "block": 16}):
        assert sorted(tuple(x) for x in near_duplicates(table, **options).collect()) == want
    assert near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_a_length_that_few_have(spark):
    from sentrylake.llm.embed import near_duplicates

    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=8).tolist(), 1) for k in range(300)] + [(900, [1.0, 2.0], 1), (901, [1.0, 2.1], 1), (902, [-1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in near_duplicates(table, cells=4, sample_rows=2).collect()}
    assert len(got) == len(rows) and got[901].component_id == 900 and (got[900].n_links, got[901].n_links, got[902].n_links) == (1, 1, 0)


def test_mixing_targets_and_order(spark, corpus):
    from sentrylake.llm.mixing import mix, targets

    s = spark.createDataFrame([("a", 100, 4), ("b", 10, 4), ("c", 1000, 4), (None, 30, 2), ("z", 0, 1)], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in targets(s).collect()}
    # b and the null source are capped at three times their size, and what they leave goes to a and c by weight
    size, w = {"a": 100, "b": 10, "c": 1000, "z": 0, None: 30}, {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    free, left, want = set(size), 1140.0, {}
    while True:
        x = left / sum(w[k] for k in free)
        over = {k for k in free if x * w[k] > 3 * size[k] + 1e-9}
        if not over:
            want |= {k: x * w[k] for k in free}
            break
        for k in over:
            want[k] = 3.0 * size[k]
            left -= want[k]
        free -= over
    assert got == pytest.approx(want)
    docs = make(spark, corpus)
    rows = mix(docs, bucket_rows=7).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert len(rows) == len(corpus)
    for of in by.values():
        assert sum(r["size"] for r in of) == of[0].source_size
        assert abs(sum(r["size"] * r.epochs for r in of) - of[0].target) <= max(r["size"] for r in of)
        assert max(r.epochs for r in of) <= 3 and max(r.epochs for r in of) - min(r.epochs for r in of) <= 1
    assert sorted(rows, key=repr) == sorted(mix(docs.repartition(3), bucket_rows=1000).collect(), key=repr)
    assert mix(docs.limit(0)).count() == 0


def test_sharding_is_even_gapless_and_moves_little(spark, corpus):
    from sentrylake.llm.sharding import deal, shard

    docs = spark.range(0, 5000).selectExpr("id as doc_id", "repeat('é', cast(id % 7 as int)) as text", "0 as arc", "1 as h")
    got = {n: {r.doc_id: r for r in shard(docs, n).collect()} for n in (10, 11)}
    for n, of in got.items():
        by = collections.defaultdict(list)
        for r in of.values():
            by[r.shard].append(r.slot)
        assert len(by) == n and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(got[10][k].shard != got[11][k].shard for k in got[10])
    assert moved < 5000 * 0.5  # a new deal by modulus would move ten in eleven
    slack = {n: {r.doc_id: r.shard for r in shard(docs, n, slack=0.25).collect()} for n in (10, 11)}
    assert max(collections.Counter(slack[10].values()).values()) <= math.ceil(1.25 * 500)
    assert sum(slack[10][k] != slack[11][k] for k in slack[10]) < 5000 * 0.3
    assert [x.text_crc32 for x in shard(docs.where("doc_id = 3"), 4).collect()] == [zlib.crc32("ééé".encode())]
    assert [x["size"] for x in shard(docs.where("doc_id = 3"), 4).collect()] == [22]
    assert shard(make(spark, corpus), 4).count() == len(corpus)
    assert shard(docs.limit(0), 4).count() == 0
    assert deal([3, 0, 2], [0, 1, 0], [2, 3]) == [[(2, 0, 0), (3, 1, 0)], [], [(2, 1, 1)]]


def test_language_of_held_out_texts(spark, corpus):
    from sentrylake.llm.langid import identify, keep_known, sample, training_rows

    docs = make(spark, corpus)
    texts = sample(training_rows(docs))
    assert sorted(texts) == ["de", "en", "fr"]
    found = identify(docs, texts).collect()
    assert len(found) == len(corpus)
    held = [r for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 200]
    assert len(held) > 15 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    none = {r.doc_id for r in found if r.lang_pred == "und"}
    assert none == {300, 301, 302} and all(r.score == 0 for r in found if r.doc_id in none)
    assert all(0 <= r.score <= 1 for r in found)
    kept = keep_known(docs, texts)
    assert kept.columns == docs.columns and kept.count() == len(corpus) - 3
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    assert identify(docs.limit(0), texts).count() == 0


def test_language_sample_counts_copies_once(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('l', id % 10) as lang", "concat('text ', id % 10, ' ', id div 10 % 3) as text")
    from sentrylake.llm.langid import sample

    for rows in (1, 200):
        got = {k: v.split("\n") for k, v in sample(docs, rows).items()}
        assert sorted(got) == [f"l{k}" for k in range(10)]
        assert all(len(v) == len(set(v)) == min(3, rows) for v in got.values())


def test_cross_parsing_counts_the_greedy_phrases():
    from sentrylake.llm.langid import WIDTH, Automaton

    train, text = b"\1\2\3\1\2\4\2\2", b"\1\2\4\4\3\1\1\2\3\5\2\2\2"
    table, state, phrases = Automaton(train).table(0), 0, 1
    for c in text:
        v = int(table[(state >> 1) + c])
        phrases += v & 1
        state = v
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train:
            n += 1
        want, at = want + 1, at + n
    assert WIDTH == 64 and abs(phrases - want) <= 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_regex(text):
    from sentrylake.llm.pii import luhn

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_equal_the_patterns():
    from sentrylake.llm.pii import base_spans

    r = random.Random(9)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "B", "1", "2", "25", ".", "@", "-", " ", "+", "(", ")", "é", "4111 1111 1111 1111", "+1 (625) 555-1892", "a.b@c.d", "10.0.0.255", "%"]) for _ in range(r.randint(0, 16)))
        assert base_spans(text) == base_by_regex(text), text
    assert len(base_spans("1" * 300_000 + "a@" * 50_000 + "1." * 100_000)) == 25_001  # one email, whose domain is every number, and the addresses in it


def test_pii_model_finds_what_the_patterns_miss_and_leaves_prose_alone(spark):
    from sentrylake.llm.pii import decode, detect, redact, shapes, train

    r = random.Random(4)
    prose = lambda n: " ".join(r.choice("the of house tree walks on and blue while seven".split()) for _ in range(n))
    things = lambda: [f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", f"n{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 250)) for _ in range(4)), "4" + "".join(r.choice("0123456789") for _ in range(15)), f"version {r.randint(1, 9)}.{r.randint(0, 9)}", str(r.randint(1, 3000))]
    texts = [" ".join(x for t in things() for x in (prose(r.randint(3, 30)), t)) + " " + prose(5) for _ in range(150)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(900, None, "en", "a"), (901, "", "en", "a"), (902, prose(2000), "en", "a"), (903, prose(400) + " " + texts[0], "en", "a")]
    docs = make(spark, rows)
    tagger = train(docs.where("doc_id < 100 or doc_id >= 900"))
    found = decode(tagger, texts[100:])
    want, got = ({(k, s) for k, x in enumerate(y) for s in x} for y in ([[s for s in shapes(t) if s[2] != "card" and s[2] != "ip"] for t in texts[100:]], [[s for s in x if s[2] != "card"] for x in found]))
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    miss = detect(spark.createDataFrame([(1, prose(20) + " (625) 555-1892 " + prose(20)), (2, prose(300))], "doc_id long, text string"), tagger)
    assert {r.doc_id: r.n_phone for r in miss.collect()} == {1: 0, 2: 0}
    assert "phone" in next(r.spans for r in miss.collect() if r.doc_id == 1)
    all_ = {r.doc_id: r for r in detect(docs, tagger).collect()}
    for k, t, *_ in rows:
        base = base_by_regex(t or "")
        assert all_[k].base_sha256 == hashlib.sha256(",".join(f"{x}:{a}:{b}" for a, b, x in base).encode()).hexdigest()
        assert {f"{x}:{a}:{b}" for a, b, x in base} <= set(all_[k].spans.split(",")) | {""}
    assert all_[902].spans == "" and all_[900].spans == ""
    clean = {r.doc_id: r for r in redact(docs, tagger).collect()}
    assert clean[902].text == rows[-2][1] and clean[900].text is None and clean[5].size == "x"
    assert not any(base_by_regex(clean[k].text or "") for k in clean)
    assert all(r.n_chars == len(r.text) for r in clean.values() if r.text)
    assert train(docs.limit(0)) is None and detect(docs.limit(0), None).count() == 0


def test_pieces_equal_sentencepiece_and_read_back(spark):
    import sentencepiece

    from sentrylake.llm.pieces import MODEL, decode, encode

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = [None, "", " ", "  a", "a  b   ceé\n\n  x\n", "\n\n", "   \n   ", "日本語 text 12345 \U0001f600", "tab\there \0 nul", " " * 40 + "x" + " " * 35, "<0x0A><s></s>", "aaaa " * 3000, "a" * 5000]
    texts += ["".join(r.choice("abcdeeeettthhhino  \n'éñ.,<>/_0129日 ") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    rows = {k: t for k, t in enumerate(texts)} | {9999: "mark ▁ itself▁▁"}
    out = encode(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).cache()
    for x in out.collect():
        assert x.round_trip
        if x.doc_id < 9999:
            assert x.ids == sp.encode(rows[x.doc_id] or ""), rows[x.doc_id]
        assert x.n_tokens == len(x.ids)
    assert {x.doc_id: x.text for x in decode(out).collect()} == {k: t or "" for k, t in rows.items()}
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edges_are_all_occurrences():
    from sentrylake.llm.pieces import MODEL, Vocabulary, edges

    v = Vocabulary(MODEL)
    units = ["▁the", "theatre", "a", "▁internationalisation"]
    position, piece, _, starts = edges(units, v)
    got = {(int(p), v.text[i]) for p, i in zip(position, piece)}
    want = {(int(s) + k, u[k : k + n]) for u, s in zip(units, starts) for k in range(len(u)) for n in range(2, 17) if k + n <= len(u) and u[k : k + n] in v.id}
    assert got == want


def test_lm_base_counts_and_a_proper_model(spark, corpus):
    from sentrylake.llm.lm import score

    docs = make(spark, corpus)
    rows = collections.defaultdict(list)
    for x in score(docs, stride=2, common=40).collect():
        rows[x.doc_id].append(x)
    toks = lambda t: WORDS.findall(lower(t)) + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t, *_ in corpus if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert sum(map(len, rows.values())) == len(corpus)
    for i, t, *_ in corpus:
        x = rows[i][0]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), rel=1e-9)
    out = [x for i, of in rows.items() if held(i) and (i or 0) < 200 for x in of]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)  # the languages' words follow each other
    assert score(docs.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one():
    from sentrylake.llm.lm import VOCAB, Weights, features

    w = Weights.start(np.random.default_rng(1).integers(0, 50, VOCAB).astype(float))
    data = np.random.default_rng(2).integers(0, 40, (4000, 4))
    w.train(data, 0.2)
    past = [np.full(VOCAB, x) for x in (3, 7, 11)]
    assert np.exp(w.forward(np.arange(VOCAB), *features(*past))[0]).sum() == pytest.approx(1, abs=1e-4)


def test_chat_layouts_escapes_and_digests(spark):
    from sentrylake.llm.chat import digests, format_turns, read_back, to_turns

    records = [
        {"turn": 1, "role": "user", "text": "a <turn x> \\ </turn>\n</turn>\n"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 5},
        {"instruction": "i", "input": "", "output": "o"},
        {"prompt": "p", "completion": "c", "extra": {"x": 1}},
        {"question": "q", "answer": {"n": 1}},  # an answer with fields is another layout
        {"unknown": 1},
        [1],
        {"turn": 2, "role": "odd>\\role", "text": None},
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(records)] + [(90, None), (91, "{not json")]
    turns = to_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    got = collections.defaultdict(list)
    for x in sorted(turns.collect(), key=lambda x: (x.conv_id, x.turn)):
        got[x.conv_id].append((x.role, x.text))
    assert got == {0: [("user", records[0]["text"])], 1: [("user", "q"), ("assistant", "")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", "i"), ("assistant", "o")], 4: [("user", "p"), ("assistant", "c")], 8: [("odd>\\role", "")]}
    r = random.Random(8)
    table = [(r.randint(0, 9), k, r.choice(["user", "assistant", None, ">", "\\"]), r.choice([None, ""]) if k % 9 == 0 else "".join(r.choice(["\\", "<turn", "</turn", "</turn>\n", "<", ">", "\n", "é", "x"]) for _ in range(12))) for k in range(300)]
    formatted = format_turns(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    back = {x.turn: x for x in read_back(formatted).collect()}
    for c, k, role, text in table:
        assert (back[k].role, back[k].text) == (role or "", text or "")
        assert back[k].loss_text == ((text or "") if role == "assistant" else "")
    for x in digests(read_back(formatted)).collect():
        own = [t for t in table if t[0] == x.conv_id]
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (x.n_turns, x.loss_chars) == (len(own), len(loss))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize(("block", "shard_docs", "first"), [(64, 4096, 4), (2, 16, 2), (3, 11, 4)])
def test_search_against_all_scores(spark, corpus, block, shard_docs, first):
    from sentrylake.llm import search as s

    rows = [x for x in corpus if x[0] is not None]
    docs = make(spark, rows)
    count = [collections.Counter(WORDS.findall(lower(t))) for _, t, *_ in rows]
    length = [sum(c.values()) for c in count]
    df = collections.Counter(w for c in count for w in c)
    n, mean = len(rows), sum(length) / len(rows)
    sizes = {"BLOCK": block, "SHARD_DOCS": shard_docs, "FIRST_SHARDS": first, "BLOCK_TERMS": 300, "QUERIES": 5, "QUERY_TERMS": 200, "DENSE": 1 / 4}
    old = {k: getattr(s, k) for k in sizes}
    try:
        for k, v in sizes.items():  # pickled by value: this module's functions are sent with what they read
            setattr(s, k, v)
        got = collections.defaultdict(list)
        for x in s.search(docs.repartition(3), docs.where("doc_id % 5 = 0"), k=7).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.doc_id, x.score))
    finally:
        for k, v in old.items():
            setattr(s, k, v)
    for (i, *_), q in zip(rows, count):
        if i % 5:
            continue
        score = {}
        for k, c in enumerate(count):
            x = sum(f * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[k] / mean)) for w, f in q.items() if w in c)
            if x > 0:
                score[k] = round(x, 8)
        want = sorted((-x, rows[k][0]) for k, x in score.items())[:7]
        assert [d for d, _ in got[i]] == [d for _, d in want]
        assert [x for _, x in got[i]] == pytest.approx([-x for x, _ in want])
    assert s.search(docs.limit(0), docs.where("doc_id = 0")).count() == 0


def test_search_skips_postings_and_keeps_ties(monkeypatch):
    import pyarrow as pa

    from sentrylake.llm import search as s

    monkeypatch.setattr(s, "BLOCK", 4)
    monkeypatch.setattr(s, "DENSE", 1 / 3)
    r = random.Random(5)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    texts = [" ".join(r.choice(kinds[k % 3]) for _ in range(r.randint(3, 40))) for k in range(240)]
    texts += [texts[7]] * 12
    shard = s._Shard()
    shard.add([1000 - k for k in range(len(texts))], [t.encode() for t in texts])
    row = dict(zip([f.split()[0] for f in s._INDEX.split(", ")], shard.row()))
    asked = [7, 10, 20, 33]
    terms = [(q, 0, t.encode(), float(c)) for q in asked for t, c in collections.Counter(texts[q].split()).items()]
    queries = s.Queries.of(pa.table({"q": [x[0] for x in terms], "h": [x[1] for x in terms], "token": pa.array([x[2] for x in terms], pa.binary()), "w": [x[3] for x in terms]}))
    mean, skipped, got = row["total"] / row["n"], [0, 0], {}
    for place, ids, score, _ in s.search_shard(s.Shard(row, queries.words, mean), queries, 5, skipped):
        for p, i, x in zip(place.tolist(), ids.tolist(), score.tolist()):
            got.setdefault(int(queries.ids[p]), []).append((i, x))
    counts = [collections.Counter(t.split()) for t in texts]
    for q in asked:
        score = [(round(sum(f * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, f in counts[q].items()), 8), 1000 - k) for k, c in enumerate(counts)]
        assert [i for i, _ in got[q]] == [i for _, i in sorted((-x, i) for x, i in score if x > 0)[:5]]
    assert skipped[0] > 0 < skipped[1]


def test_search_tells_apart_texts_under_one_id(spark):
    from sentrylake.llm import search as s

    docs = spark.createDataFrame([(1, "a a b"), (2, "b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "a a b"), (9, "a b"), (9, "a b")], "doc_id long, text string")
    both = [round(x.score, 6) for t in ("a a b", "a b") for x in s.search(docs, asked.where(F.col("text") == t)).collect()]
    assert sorted(round(x.score, 6) for x in s.search(docs, asked).collect()) == sorted(both)


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, corpus, tmp_path):
    import corpus_pipeline

    make(spark, corpus + [(700, "mail me at some.one@mail.example.com in the house of that thing", "en", "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen[name] = out.collect()
        if name != "pieces":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    assert {r.doc_id for r in seen["language"]}.isdisjoint({300, 301, 302})
    assert {r.doc_id for r in seen["near_duplicates"]}.isdisjoint({200, 201, 202})
    assert "[EMAIL]" in next(r.text for r in seen["personal_data"] if r.doc_id == 700)
    assert len(seen["pieces"]) == len(seen["mixing"]) and all(r.round_trip for r in seen["pieces"])


def test_embeddings_with_ids_beyond_62_bits_and_without(spark):
    from sentrylake.llm.embed import near_duplicates

    big = 1 << 62
    rows = [(big + 5, [1.0, 0.0], 1), (big + 9, [1.0, 0.01], 1), (-7, [0.0, 1.0], 1), (None, [0.01, 1.0], 1), (None, [5.0, 5.0], 2), (None, [-1.0, 0.0], 1), (3, [0.0, 1.0], None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert got == sorted([(big + 5, 1, big + 5, True), (big + 9, 1, big + 5, False), (-7, 1, -7, True), (None, 1, -7, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True)], key=repr)


@pytest.mark.parametrize("tiny", ["a", "hello", "x y"])
def test_language_with_a_tiny_training_text(spark, corpus, tiny):
    from sentrylake.llm.langid import identify, sample

    docs = make(spark, [x for x in corpus if x[1] and len(x[1].split()) > 10 and x[0] is not None and x[0] < 300] + [(900, tiny, "xx", "a")])
    found = identify(docs, sample(docs)).where("doc_id < 200").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in found) >= 0.97 * len(found)


def test_language_against_slow_parsing():
    from sentrylake.llm.langid import BLOCK, WIDTH, Model

    texts = {"aa": "the thing was in that house and the hand", "bb": "der die und das haus ist nicht von ein mit", "cc": "q"}
    model = Model(texts)
    asked = ["the house", "und das nicht", "zzz", "q q q", "the thing " * 200, "a1b2 c"]
    bits, letter = model.entropies(asked)
    sym = lambda t: model.symbols(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0]))[0].tolist()
    for k, lang in enumerate(texts):
        learned = bytes(sym(texts[lang]))
        for n, t in enumerate(asked):
            s, phrases = sym(t), 0
            for at in range(0, len(s), BLOCK):
                block, i = bytes(s[at : at + BLOCK]), 0
                while i < len(block):
                    j = i
                    while j < len(block) and block[i : j + 1] in learned:
                        j += 1
                    # a symbol that is in no phrase is passed over: it ends the phrase before it and counts once more
                    phrases, i = phrases + 1, max(j, i + 1)
            cost = np.log2(len(learned) + WIDTH)
            assert abs(bits[n, k] * len(s) / cost - phrases) <= 1 + len(s) // BLOCK + sum(x not in learned for x in s)
    assert letter.all()


@pytest.mark.parametrize("rows", [[(5, "one two three four", "a")] * 200 + [(6, "x " * 50, "b")], [(None, f"w{k} v", "a") for k in range(150)] + [(k, "y " * 9, "b") for k in range(40)], [(None, "same text", None)] * 90 + [(1, "z", "b")]])
def test_mixing_of_rows_that_are_alike(spark, rows):
    from sentrylake.llm.mixing import mix

    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, source string, key int").repartition(5)
    got = mix(docs, bucket_rows=50)
    assert got.columns == ["doc_id", "text", "source", "key", "size", "source_size", "target", "epochs"]
    got = got.collect()
    assert sorted(x.key for x in got) == list(range(len(rows)))
    for source in {x[2] for x in rows}:
        mine = [x for x in got if x.source == source]
        assert abs(sum(x.size * x.epochs for x in mine) - mine[0].target) <= max(x.size for x in mine) / 2
        assert max(x.epochs for x in mine) <= 3


@pytest.mark.parametrize(("shards", "slack"), [(3, 0.0), (7, 0.0), (5, 0.2)])
def test_sharding_against_a_ring_dealt_row_by_row(spark, shards, slack):
    from sentrylake.llm.sharding import ring, shard

    r = random.Random(shards)
    rows = [(r.randrange(60), f"text {r.randrange(5)}") for _ in range(200)] + [(None, f"t{k}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    points, owner = ring(shards, 8)
    crc = lambda t: zlib.crc32(t.encode())
    hashed = docs.withColumn("c", F.crc32(F.col("text").cast("binary"))).withColumn("n", (F.octet_length("text") + 16).cast("long"))
    hashed = hashed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("c", "n")).otherwise(F.xxhash64("doc_id")).alias("h")).collect()
    waiting = sorted(((int(np.searchsorted(points, x.h, side="left")) % len(points), x.h, x.doc_id if x.doc_id is not None else -1, crc(x.text), len(x.text)) for x in hashed))
    n = len(rows)
    free = [math.ceil((1 + slack) * n / shards)] * shards if slack else [n // shards + (s < n % shards) for s in range(shards)]
    filled, want = [0] * shards, []
    for step in range(len(points)):
        left = []
        for row in waiting:
            s = int(owner[(row[0] + step) % len(owner)])
            if free[s]:
                want.append((row[2], row[3], s, filled[s]))
                free[s], filled[s] = free[s] - 1, filled[s] + 1
            else:
                left.append(row)
        waiting = left
    assert not waiting
    got = [(x.doc_id if x.doc_id is not None else -1, x.text_crc32, x.shard, x.slot) for x in shard(docs, shards, 8, slack).collect()]
    assert sorted(got) == sorted(want)


def test_dedup_keeps_columns_of_any_name_and_kind(spark):
    from sentrylake.llm.simhash import deduplicate

    rows = [(1, "a b c d e f", {"k": "v"}, 7, "x"), (1, "a b c d e f", {"k": "w"}, 8, "x"), (2, "q r s t u v", None, 9, "y"), (3, "a b c d e f", {}, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>, __id int, `a.b` string")
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((x[0], x[3]) for x in kept.collect()) == [(1, 7), (2, 9)]


def test_pipeline_language_stage_without_labels(spark):
    import corpus_pipeline

    docs = make(spark, [(1, "the house", None, "a"), (2, None, None, "a"), (3, "... 12", None, "b"), (4, "x", None, None)])
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 4]


def test_personal_data_in_a_very_long_run_of_digits(monkeypatch):
    from sentrylake.llm import pii

    r = random.Random(8)
    monkeypatch.setattr(pii, "MOST_WINDOWS", 6)
    tagger = pii.Tagger()
    text = " ".join(str(r.randrange(10**9)) for _ in range(400))
    parts = pii.decode(tagger, [text, "", "no trigger"])
    assert len(parts) == 3 and parts[1] == parts[2] == []
    assert all(0 <= s < e <= len(text) for s, e, _ in parts[0])


def test_shared_folder_is_asked_for_on_a_cluster():
    from sentrylake.lineage import shared_folder

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_bitmaps_bound_the_common_shingles():
    from sentrylake.llm.shingles import bitmap, most_common

    r = np.random.default_rng(1)
    for n, m, both in ((5, 9, 3), (300, 310, 280), (1000, 600, 10), (1, 1, 1), (4000, 4100, 3900)):
        x = r.integers(0, 2**64, n + m - both, np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - both :])
        common = len(np.intersect1d(a, b))
        assert common <= most_common(bitmap(a), bitmap(b), len(a), len(b)) == most_common(bitmap(b), bitmap(a), len(b), len(a))


def test_gradients_are_summed_by_row():
    """Sums for rows that stand once, a few times and very often, and features from tables as from their hashes."""
    from sentrylake.llm import lm

    rng = np.random.default_rng(5)
    for n in (1, 7, 1024):
        rows = np.stack((np.zeros(n, np.int64), rng.integers(1, 40, n), rng.zipf(1.5, n) % 8192))
        g = rng.standard_normal((n, 16)).astype(np.float32)
        want = np.zeros((8192, 16))
        for r in rows:
            np.add.at(want, r, g)
        u, got = lm.summed(g, rows)
        assert u.tolist() == np.unique(rows).tolist() and np.allclose(got, want[u], atol=1e-4)
    h1, h2, h3 = rng.integers(0, 4096, (3, 500))
    classes, words = lm.features(h1, h2, h3)
    row = lambda m, h: (1 + (h % np.uint64(m - 1)).astype(np.int64)).tolist()
    assert classes[1].tolist() == row(lm.CLASS_ROWS, lm._mix(1, h1)) and classes[4].tolist() == row(lm.CLASS_ROWS, lm._mix(4, h3))
    assert classes[2].tolist() == row(lm.CLASS_ROWS, lm._mix(2, h1, h2)) and words[2].tolist() == row(lm.WORD_ROWS, lm._mix(6, h2)) and not words[0].any()
