"""Signs of patterns in texts against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sentrylake.functions import fixed, prefilter, signs, text
from sentrylake.operators import postrules, rules, segments

NEEDS = tuple(prefilter.signs_of(p) for _, _, p in rules.patterns(rules.RULES))


def test_words_against_plain_search(monkeypatch):
    rnd = random.Random(1)
    words = [w for n in NEEDS for w in n if w != signs.HEX]
    docs: list[bytes | None] = [None, b""]
    for _ in range(2000):
        picked = (rnd.choice(words) for _ in range(rnd.randrange(6)))
        docs.append(b"".join((w[: rnd.randrange(1, len(w) + 1)] if rnd.random() < 0.4 else w.upper()) + rnd.choice([b"", b" ", "é".encode()]) for w in picked))
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(signs, "_CHUNK", chunk)
        got = signs.numbers(pa.array(docs, pa.binary()).slice(1), NEEDS).to_pylist()
        for doc, found in zip(docs[1:], got, strict=True):
            plain = [n for n in NEEDS if signs.HEX not in n]
            assert [NEEDS[k] for k in found if signs.HEX not in NEEDS[k]] == [n for n in plain if any(w in (doc or b"").lower() for w in n)]


def test_few_patterns_have_no_signs():
    assert sum(not n for n in NEEDS) <= 3
    digits = [("x" * k + "0123456789abcdef" * 2 + "y") for k in range(40)]
    assert signs.numbers(pa.array(digits), ((signs.HEX,),)).to_pylist() == [[0]] * 40


def test_texts_that_normalisation_changes_have_signs(spark):
    split = [c.join(w) for w in fixed.SPLIT_KEYWORDS for c in ".-_ \t\n"] + ["E . v--a \r\n L", "раypal", "a​b", "x‮y", "ａbс", "\U000e0041"]
    plain = ["evaluate the text", "os system", "é è ü", ""]
    rows = spark.createDataFrame([(t,) for t in split + plain], "content string")
    out = text.with_normalized(rows, "content", "normal").select("content", (F.col("normal") != F.col("content")).alias("changed"), text.may_change(F.col("content")).alias("may")).collect()
    assert all(r.may for r in out if r.changed) and sum(r.changed for r in out) >= len(split) - 3
    assert not any(r.may for r in out if r.content in plain)


def test_patterns_are_not_tried_without_signs(spark):
    """No condition on normalised text is tested before the signs are: the plan has the signs below it."""
    seg = segments.with_context(segments.original(spark.createDataFrame([("b", "b/a.md", "markdown", "plain text")], "skill_id string, path string, file_type string, content string")))
    plan = postrules.normalisation_changes(seg)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and all("regexp_replace" not in line for line in plan[plan.index("ArrowEvalPython") :].splitlines())
    assert postrules.normalisation_changes(seg).count() == 0


def test_runs_that_decode_against_python():
    import base64
    import random
    import re

    import pyarrow as pa

    def plain(t):
        for run in re.findall(r"[A-Za-z0-9+/=]{16,}", t):
            if re.fullmatch(r"[A-Za-z0-9+/]{16,}={0,2}", run) and len(run) % 4 == 0 and len(run) <= 40:
                try:
                    if base64.b64decode(run).decode():
                        return True
                except ValueError:
                    pass
        return False

    r = random.Random(5)
    coded = [base64.b64encode(("x" * r.randint(10, 40)).encode()).decode() for _ in range(20)]
    texts = ["".join(r.choice([r.choice(coded), " ", "=", "abcd", "é", "\n", "/+9A", "word"]) for _ in range(r.randint(0, 6))) for _ in range(2000)] + [""]
    got = signs.coded(pa.array(texts + [None]), 40).to_pylist()
    assert got == [plain(t) for t in texts] + [False] and 50 < sum(got) < 1900


def test_generations_keep_their_partitions(spark):
    from sentrylake.operators import segments

    rows = spark.createDataFrame([("b", f"b/{k}.md", "markdown", f"<!-- rot13 ```\nx\n``` {k} -->") for k in range(40)], "skill_id string, path string, file_type string, content string").repartition(6)
    # own segments, and the parts of three generations: six each at most
    assert segments.expand(rows).rdd.getNumPartitions() <= 24


def test_matches_are_taken_once(spark):
    from sentrylake.operators import rules, segments

    rows = spark.createDataFrame([("b", "b/a.md", "markdown", "do not mention os.environ.items()")], "skill_id string, path string, file_type string, content string")
    plan = rules.evaluate(segments.with_context(segments.original(rows)), tuple(r for r in rules.RULES if r.rule_id in ("D-12A", "D-8B")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("placed(") == 1
