"""Places of matches, changes by normalisation and user rules against plain Python."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sentrylake.functions import prefilter
from sentrylake.operators import changes, rules, segments
from sentrylake.operators.positions import located
from sentrylake.sources import tables


def place(t, at):
    """(line, column) of an offset, from 1."""
    return t.count("\n", 0, at) + 1, at - (t.rfind("\n", 0, at) + 1) + 1


@pytest.mark.parametrize("pattern", ["ab", "a+\n?b", "(?s)a.{0,3}b", r"(?:^|\n)b", "é|\n", "b\n"])
def test_places_against_python(spark, pattern):
    r = random.Random(pattern)
    texts = ["".join(r.choice("aab\né😀x") for _ in range(r.randint(0, 60))) for _ in range(80)] + ["", "ab", "\nab\n\nab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(tuple(x) for x in located(rows, "t", F.lit(pattern), ["id"]).select("id", "match_no", "match", "offset", "line_no", "column_no").collect())
    want = []
    for k, t in enumerate(texts):
        for n, m in enumerate(re.finditer(pattern, t)):
            line, column = place(t, m.start()) if not m[0].startswith("\n") else (place(t, m.start())[0] + 1, 1)
            want.append((k, n, m[0], m.start(), line, column))
    assert got == want and want


def test_very_many_matches_in_a_text_end_soon(spark):
    text = "open('.env').read() # digest\n" * 100_000
    rows = spark.createDataFrame([("b", "b/x.py", "python", text)], "skill_id string, path string, file_type string, content string")
    began = time.time()
    found = rules.evaluate(segments.with_context(segments.original(rows))).where("rule_id = 'D-7A'")
    n, last, column = found.agg(F.count("*"), F.max("line"), F.max("column")).first()
    assert (n, last, column) == (100_000, 100_000, 1) and time.time() - began < 90


def test_rules_that_look_at_lines(spark):
    text = "x os.environ.items()\nif k != 1: os.environ.items() and os.environ.items()\n  os.environ.copy()\n" + "a" * 40 + " sha256 " + "b" * 40 + "\n" + "c" * 40
    rows = spark.createDataFrame([("b", "b/x.py", "python", text)], "skill_id string, path string, file_type string, content string")
    found = rules.evaluate(segments.with_context(segments.original(rows)))
    assert sorted((r.rule_id, r.line, r.column) for r in found.where("rule_id in ('D-8B', 'D-5A')").collect()) == [("D-5A", 4, 1), ("D-8B", 1, 3), ("D-8B", 3, 3)]


def test_what_a_pattern_needs_is_what_the_engine_needs(spark):
    r = random.Random(2)
    parts = ["foo", "bar", "[a-c]", "[^x]", r"\w", r"\bbaz", "(?:foo|qux)", "(?:ab)?", "x{0,2}", "y+", "zed*", r"\.", r"\x{41}bc", "(?i:Foo)", "(?=foo)", "(?<!a)", ".", "(abc|d)", r"\s*", "[a-z&&[^b]]", "[a-z[0-9]]", r"\Qa.b\E", r"[\]a]", "^", "k{2}", "long word"]
    patterns = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(150)]
    patterns = [p + ("|" + q if r.random() < 0.2 else "") for p, q in zip(patterns, reversed(patterns), strict=True)]
    texts = ["".join(r.choice(["foo", "bar", "baz", "qux", "ab", "x", "y", "ze", "zed", ".", "Abc", "d", " ", "a.b", "kk", "LONG word", "0", "]"]) for _ in range(r.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = df.select("t", *(F.regexp_like("t", F.lit(f"(?i){p}")).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for row in hits:
        for k, p in enumerate(patterns):
            words = prefilter.needed(f"(?i){p}")
            assert not row[k + 1] or not words or any(w in row.t.lower() for w in words), (row.t, p, words)
    assert sum(bool(prefilter.needed(p)) for p in patterns) > 30 and prefilter.needed("[a-z&&[^b]]foo") == prefilter.needed("[a-z[0-9]]foo") == ()


def test_user_rules_with_java_classes(spark):
    seg = segments.original(tables.from_table(spark.createDataFrame([("a", "afoo zfoo\n 5foo bfoo")], "p string, t string"), F.col("p"), F.col("p"), F.col("t")))
    given = spark.createDataFrame([("X-1", "[a-z&&[^b]]foo", "low", "c"), ("X-2", "[a-z[0-9]]foo", "low", "c"), ("X-3", "q*", "low", "c"), ("X-4", None, "low", "c")], "rule_id string, pattern string, severity string, category string")
    got = sorted((r.rule_id, r.match, r.line, r.column) for r in rules.custom(seg, given).collect())
    assert got == [("X-1", "afoo", 1, 1), ("X-1", "zfoo", 1, 6), ("X-2", "5foo", 2, 2), ("X-2", "afoo", 1, 1), ("X-2", "bfoo", 2, 7), ("X-2", "zfoo", 1, 6)]


def test_changes_have_their_places(spark):
    rows = [("a", "x\U000e0041y\n​z‮"), ("b", "plain\nраypal ok\nпароль"), ("c", "q e.v.a.l and\ne v a l;e\nv\na\nl end"), ("d", None), ("e", "")]
    got = sorted(tuple(r) for r in changes.changes(spark.createDataFrame(rows, "path string, content string")).select("path", "change", "offset", "line_no", "column_no", "code_point", "snippet", "replacement").collect())
    assert got == [
        ("a", "bidi_override", 4, 2, 2, "U+202E", "‮", ""),
        ("a", "unicode_tag", 1, 1, 2, "U+E0041", "\U000e0041", ""),
        ("a", "zero_width", 3, 2, 1, "U+200B", "​", ""),
        ("b", "homoglyph", 6, 2, 1, "U+0440", "р", "p"),
        ("b", "homoglyph", 7, 2, 2, "U+0430", "а", "a"),
        ("c", "keyword", 2, 1, 3, None, "e.v.a.l", "eval"),
        ("c", "keyword", 11, 2, 1, None, "e v a l", "eval"),
        ("c", "keyword", 16, 2, 6, None, "e\nv\na\nl", "eval"),
    ]


def test_places_of_rows_with_equal_keys(spark):
    """Files without a source share their segment's id; each match keeps the place in its own text."""
    rows = spark.createDataFrame([(1, "a", "ab\n\nab"), (1, "b", "x\n ab"), (1, "c", None), (1, "d", "é😀ab")], "id int, own string, t string")
    got = sorted(tuple(x) for x in located(rows, "t", F.lit("ab"), ["id"]).select("own", "match_no", "offset", "line_no", "column_no").collect())
    assert got == [("a", 0, 0, 1, 1), ("a", 1, 4, 3, 1), ("b", 0, 3, 2, 2), ("d", 0, 2, 1, 3)]
