"""Behaviour chains of any number of flags against the product of all findings."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from sentrylake.operators import chains

SCHEMA = "finding_id string, skill_id string, path string, segment_id string, line int, context string, source_kind string, reference_example boolean, segment_type string, flags string"
POLICY = (("two", "X-2", "c", "A", "B"), ("three", "X-3", "c", "A", "B", "C"), ("four", "X-4", "c", "A", "B", "C", "D"))


def score(parts, heads):
    """The reference's own rule, in words: what a combination of findings scores."""
    md = all(p["source_kind"] == "markdown" for p in parts)
    acts = any(p["context"] in ("actionable_instruction", "executable_snippet") for p in parts)
    points = 0
    lines = [p["line"] for p in parts]
    span = max(lines) - min(lines)
    if len({p["path"] for p in parts}) == 1:
        points += 1 + (3 if span <= 3 else 2 if span <= 15 else 1 if span <= 60 else 0)
        points -= 3 if md and span > 3 else 0
    points += 0 if md else 2
    points += 1 if acts else 0
    points -= 2 if md and not acts else 0
    points -= 3 if all(p["reference_example"] for p in parts) else 0
    points -= 2 if all(p["segment_type"] in ("code_fence", "html_comment") for p in parts) else 0
    if md and len({p["segment_id"] for p in parts}) == 1 and any(min(lines) < h < max(lines) for h in heads.get(parts[0]["segment_id"], ())):
        points -= 2
    return points - (1 if any("/references/" in p["path"] for p in parts) else 0)


def order(parts):
    if len({p["path"] for p in parts}) == 1:
        return (0, parts[0]["path"], max(p["line"] for p in parts), [(-p["line"], p["finding_id"]) for p in parts])
    return (1, "", 0, [(p["path"], p["line"], p["finding_id"]) for p in parts])


def bundle(r, name):
    rows, heads = [], {}
    for f in range(r.randint(1, 3)):
        md = r.random() < 0.6
        path = r.choice(["b/", "b/references/"]) + f"{name}-{f}." + ("md" if md else "py")
        top = r.choice([6, 25, 120])
        for _ in range(r.randint(0, 6)):
            part = r.choice(["", "#1", "#2"]) if md else ""
            kind = r.choice(["markdown", "markdown", "frontmatter_description"]) if md and not part else "markdown" if md else "code"
            rows.append((f"{r.getrandbits(40):010x}", name, path, path + part, r.randint(1, top), r.choice(["documentation", "actionable_instruction"]) if md else "code", kind, r.random() < 0.4, "code_fence" if part else "original", "," + "".join(f"{x}," for x in "ABCD" if r.random() < 0.45)))
        for part in ("", "#1", "#2"):
            heads[path + part] = sorted(r.sample(range(1, top + 1), min(top, r.randint(0, 3))))
    return rows, heads


def test_chains_of_two_three_and_four_flags_equal_the_product(spark):
    r = random.Random(19)
    rows, heads = [], {}
    for b in range(200):
        more, tops = bundle(r, f"s{b}")
        rows, heads = rows + more, heads | tops
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = {}
    for skill in {x[1] for x in rows}:
        own = [dict(zip(names, x, strict=True)) for x in rows if x[1] == skill]
        for chain, _, _, *flags in POLICY:
            combos = [c for c in itertools.product(*([p for p in own if f",{f}," in p["flags"]] for f in flags)) if len({p["finding_id"] for p in c}) == len(c)]
            if combos:
                best = min(combos, key=lambda c: (-score(c, heads), order(c)))
                want[skill, chain] = score(best, heads), [p["finding_id"] for p in best]
    found = spark.createDataFrame(rows, SCHEMA)
    tops = spark.createDataFrame([(k, v) for k, v in heads.items() if v], "segment_id string, headings array<int>")
    got = {(x.skill_id, x.chain): (x.score, [p.finding_id for p in x.parts]) for x in chains.best_links(found, tops, POLICY).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want and len({k[1] for k in want}) == 3


def test_a_file_with_very_many_findings_ends_soon(spark):
    rows = spark.range(100_000).select(
        F.lpad(F.hex("id"), 16, "0").alias("finding_id"), F.lit("s").alias("skill_id"), F.lit("s/x.py").alias("path"), F.lit("g").alias("segment_id"), (F.col("id") * 5).cast("int").alias("line"), F.lit("code").alias("context"), F.lit("code").alias("source_kind"),
        F.lit(False).alias("reference_example"), F.lit("original").alias("segment_type"), F.concat(F.lit(","), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")), F.lit(",")).alias("flags"),
    )
    began = time.time()
    got = {x.chain: x.score for x in chains.best_links(rows, policy=POLICY).collect()}
    assert got == {"two": 5, "three": 5} and time.time() - began < 60
    assert chains.best_links(rows.limit(0), policy=POLICY).count() == 0


def test_reference_examples_alone_make_no_chain(spark):
    row = lambda k, flag, example: (k, "s", "s/x.md", "g", 1, "actionable_instruction", "markdown", example, "original", f",{flag},")
    policy = (("two", "X-2", "c", "A", "B"),)
    assert chains.linked(spark.createDataFrame([row("1", "A", True), row("2", "B", True)], SCHEMA), policy=policy).count() == 0
    one = chains.linked(spark.createDataFrame([row("1", "A", True), row("2", "B", False), row("3", "A,B", False)], SCHEMA), policy=policy).first()
    assert (one.parts, one.severity, one.score) == (["1", "2"], "high", 5)
