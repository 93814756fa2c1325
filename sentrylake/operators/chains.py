"""Behaviour chains: findings of a bundle that together show all flags of a chain, any number of them, by a sweep over each file and by representatives across files."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..shipping import ship

#: Paths of reference material, in lower case, and headings.
_HINT = r"/references/|/readme\.md$|/license\.txt$"
_HEADING = r"^\s{0,3}#{1,6}\s+\S"
#: Facts of a finding as bits: what linkage reads besides places.
MARKDOWN, ACTS, REFERENCE, HIDDEN, HINT = 1, 2, 4, 8, 16
# Points of linkage.
SPANS = ((3, 3), (15, 2), (60, 1))
ONE_FILE, MARKDOWN_APART, CODE, ACTING, IDLE_MARKDOWN, ALL_REFERENCE, ALL_HIDDEN, HEADING_BETWEEN, HINTED, LEAST = 1, -3, 2, 1, -2, -3, -2, -2, -1, 2


class Part(NamedTuple):
    order: tuple
    finding_id: str
    bits: int
    path: str
    line: int
    segment: str | None
    above: int
    base: int  # headings up to and with its line
    flags: tuple[str, ...]


def facts_points(every: int, some: int) -> int:
    """Points of what parts are: bits that all of them have, and bits that some have."""
    points = 0 if every & MARKDOWN else CODE
    points += ACTING if some & ACTS else 0
    points += IDLE_MARKDOWN if every & MARKDOWN and not some & ACTS else 0
    points += ALL_REFERENCE if every & REFERENCE else 0
    points += ALL_HIDDEN if every & HIDDEN else 0
    return points + (HINTED if some & HINT else 0)


def span_points(span: int) -> int:
    return next((p for most, p in SPANS if span <= most), 0)


def in_file_points(every: int, span: int, crosses: bool) -> int:
    """Points of where parts of one file stand."""
    points = ONE_FILE + span_points(span)
    if every & MARKDOWN:
        points += (MARKDOWN_APART if span > SPANS[0][0] else 0) + (HEADING_BETWEEN if crosses else 0)
    return points


def folded(roles: list[list[Part]], start: Any, step: Callable[[Any, Part], Any], shared: Callable[[Part], bool]) -> dict[Any, tuple[Part, ...]]:
    """For each state that one part a role can lead to, the parts that come first. Parts must differ; only those that fill several roles (`shared`) can be taken twice, so the state holds them."""
    front: dict[Any, tuple[Part, ...]] = {(start, frozenset()): ()}
    for role in roles:
        new: dict[Any, tuple[Part, ...]] = {}
        for (state, taken), parts in front.items():
            for part in role:
                if part.finding_id in taken:
                    continue
                key = step(state, part), taken | {part.finding_id} if shared(part) else taken
                got = (*parts, part)
                if key not in new or [p.order for p in got] < [p.order for p in new[key]]:
                    new[key] = got
        front = new
    best: dict[Any, tuple[Part, ...]] = {}
    for (state, _), parts in front.items():
        if state not in best or [p.order for p in parts] < [p.order for p in best[state]]:
            best[state] = parts
    return best


class Sweep:
    """The best combination of a chain's flags in a file whose findings come by line, those of a line by falling id.

    For each flag and set of facts it holds the last few parts, by segment where headings count; at each line the combinations that end there are folded from them. So each line costs the same,
    however many findings stand above it. Of equal points the combination that ends first is best, then the one whose parts, flag by flag, stand nearest to its end.
    """

    def __init__(self, flags: tuple[str, ...]):
        self.flags, self.k = flags, len(flags)
        self.near: dict[str, dict[int, OrderedDict[str | None, list[Part]]]] = {f: {} for f in flags}
        self.best: tuple[int, tuple[Part, ...]] | None = None

    def add(self, part: Part) -> None:
        for flag in part.flags:
            if flag in self.near:
                by_segment = self.near[flag].setdefault(part.bits, OrderedDict())
                segment = part.segment if part.bits & MARKDOWN else None
                by_segment[segment] = [part, *by_segment.pop(segment, [])[: self.k - 1]]

    def _options(self, flag: str, here: set[str | None]) -> list[Part]:
        out: list[Part] = []
        for by_segment in self.near[flag].values():
            for n, segment in enumerate(reversed(by_segment)):
                if n > self.k:
                    break
                out += by_segment[segment]
            for segment in here.intersection(by_segment).difference(list(reversed(by_segment))[: self.k + 1]):
                out += by_segment[segment]
        return out

    def end(self, line: int, here: set[str | None]) -> None:
        """All findings of this line have come; `here` are their segments."""
        if not all(self.near.values()):
            return
        some = [any(bits & ACTS for bits in self.near[f]) for f in self.flags]
        code = any(not bits & MARKDOWN for f in self.flags for bits in self.near[f])
        span = max(min(line - next(reversed(s.values()))[0].line for s in self.near[f].values()) for f in self.flags)
        if self.best and self.best[0] >= ONE_FILE + span_points(span) + (CODE if code else 0) + (ACTING if any(some) else 0) + (0 if code or any(some) else IDLE_MARKDOWN):
            return

        def step(state: tuple, part: Part) -> tuple:
            every, some, span, segment, top, base = state
            same = part.segment if segment in ("", part.segment) and part.bits & every & MARKDOWN else None
            return every & part.bits, some | part.bits, max(span, next((i for i, (most, _) in enumerate(SPANS) if line - part.line <= most), len(SPANS))), same, max(top, part.above) if same else 0, min(base, part.base) if same else 0

        found = folded([self._options(f, here) for f in self.flags], (31, 0, 0, "", 0, 1 << 60), step, lambda p: sum(f in self.near for f in p.flags) > 1)
        for (every, some_bits, bucket, segment, top, base), parts in found.items():
            reach = (*(most for most, _ in SPANS), SPANS[-1][0] + 1)[bucket]
            points = facts_points(every, some_bits) + in_file_points(every, reach, bool(segment) and top > base)
            if max(p.line for p in parts) == line and (self.best is None or points > self.best[0] or (points == self.best[0] and self.best[1] and line == max(p.line for p in self.best[1]) and [p.order for p in parts] < [p.order for p in self.best[1]])):
                self.best = points, parts


def _result(skill: str, path: str, chain: int, points: int, last: int, parts: tuple[Part, ...]) -> dict:
    return {"skill_id": skill, "one_path": path, "chain_no": chain, "score": points, "last": last, "parts": [{"finding_id": p.finding_id, "path": p.path, "markdown": bool(p.bits & MARKDOWN), "reference": bool(p.bits & REFERENCE)} for p in parts]}


_RESULT = "skill_id string, one_path string, chain_no int, score int, last int, parts array<struct<finding_id:string,path:string,markdown:boolean,reference:boolean>>"
_ARROW = pa.schema([("skill_id", pa.string()), ("one_path", pa.string()), ("chain_no", pa.int32()), ("score", pa.int32()), ("last", pa.int32()), ("parts", pa.list_(pa.struct([("finding_id", pa.string()), ("path", pa.string()), ("markdown", pa.bool_()), ("reference", pa.bool_())])))])


def sweeper(policy: list[tuple[str, ...]]):
    """A mapInArrow function over findings sorted by bundle, file, line and falling id: the best combination of each file and chain."""

    def sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, line, here, sweeps = None, 0, set(), []

        def close() -> list[dict]:
            out = []
            for n, s in enumerate(sweeps):
                s.end(line, here)
                if s.best:
                    out.append(_result(*file, n, s.best[0], max(p.line for p in s.best[1]), s.best[1]))
            return out

        for batch in it:
            out: list[dict] = []
            for r in batch.to_pylist():
                if (now := (r["skill_id"], r["path"])) != file:
                    out += close() if file else []
                    file, line, here, sweeps = now, r["line"], set(), [Sweep(c) for c in policy]
                elif r["line"] != line:
                    for s in sweeps:
                        s.end(line, here)
                    line, here = r["line"], set()
                part = Part((-r["line"], r["finding_id"]), r["finding_id"], r["bits"], r["path"], r["line"], r["segment_id"], r["above"], r["base"], tuple(r["flags"]))
                here.add(part.segment)
                for s in sweeps:
                    s.add(part)
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
        if file and (out := close()):
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return sweep


def crosser(policy: list[tuple[str, ...]]):
    """For a bundle's representatives, a bounded number: the best combination of each chain whose parts are not all in one file."""

    def step(state: tuple, part: Part) -> tuple:
        every, some, path = state
        return every & part.bits, some | part.bits, part.path if path in ("", part.path) else None

    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        parts = {f: [] for c in policy for f in c}
        for r in rows.to_dict("records"):
            parts[r["flag"]].append(Part((r["path"], r["line"], r["finding_id"]), r["finding_id"], r["bits"], r["path"], r["line"], None, 0, 0, tuple(r["flags"])))
        out = []
        for n, flags in enumerate(policy):
            found = folded([parts[f] for f in flags], (31, 0, ""), step, lambda p, flags=flags: sum(f in flags for f in p.flags) > 1)
            ranked = sorted(((-facts_points(every, some), [p.order for p in got]), got) for (every, some, path), got in found.items() if path is None)
            if ranked:
                out.append(_result(rows["skill_id"].iat[0], "", n, -ranked[0][0][0], 0, ranked[0][1]))
        return pd.DataFrame(out, columns=_ARROW.names)

    return cross


def headings(segments: DataFrame) -> DataFrame:
    """(segment_id, headings): the lines of the file on which the Markdown headings of each segment stand."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(x.rlike(_HEADING), F.col("start_line") + i))
    return segments.where((F.col("source_kind") == "markdown") & F.col("content").contains("#")).select("segment_id", F.array_compact(lines).alias("headings")).where("size(headings) > 0")


def best_links(found: DataFrame, heads: DataFrame | None = None, policy: tuple = fixed.CHAINS) -> DataFrame:
    """(chain, rule_id, category, skill_id, score, parts): for each bundle and chain the best-linked findings, one for each of the chain's flags, that differ from each other.

    policy: rows of (chain, rule, category, flag, flag, ...), with any number of flags. heads: `headings` of the segments; without them no heading stands between findings.
    Files are swept one by one, sorted by Spark, in a pass that holds a few parts a flag (`Sweep`). Across files and lines only facts count: of findings with a flag and the same facts a few
    represent all, the first ones, and the first ones outside the first one's file. No product of findings is built, and a bundle or file with very many findings is neither gathered nor compared
    pair by pair. Of equal points those within a file come first, by path, last line and nearness (see `Sweep`); across files those of the smallest paths, lines and ids.
    A finding without a line stands on line 0. Without findings there are no rows.
    """
    ship(found.sparkSession)
    flags = sorted({f for c in policy for f in c[3:]})
    chains = [tuple(c[3:]) for c in policy]
    k = max(map(len, chains))
    if heads is None:
        found = found.withColumn("above", F.lit(0)).withColumn("on_heading", F.lit(False))
    else:
        found = found.join(heads, "segment_id", "left").withColumn("above", F.greatest(F.lit(0), F.coalesce(F.size(F.filter("headings", lambda h: h < F.col("line"))), F.lit(0))))
        found = found.withColumn("on_heading", F.coalesce(F.array_contains("headings", F.col("line")), F.lit(False)))
    bit = lambda c, n: F.when(c, n).otherwise(0)
    rows = found.withColumn("flags", F.array_distinct(F.filter(F.split("flags", ","), lambda f: f.isin(*flags)))).where("size(flags) > 0").select(
        "skill_id", "path", F.coalesce("line", F.lit(0)).cast("int").alias("line"), "finding_id", "segment_id", "flags", F.col("above").cast("int").alias("above"), (F.col("above") + F.col("on_heading").cast("int")).cast("int").alias("base"),
        (bit(F.col("source_kind") == "markdown", MARKDOWN) + bit(F.col("context").isin("actionable_instruction", "executable_snippet"), ACTS) + bit(F.col("reference_example"), REFERENCE) + bit(F.col("segment_type").isin("code_fence", "html_comment"), HIDDEN) + bit(F.lower("path").rlike(_HINT), HINT)).alias("bits"),
    )
    within = rows.repartition("skill_id", "path").sortWithinPartitions("skill_id", "path", "line", F.desc("finding_id")).mapInArrow(sweeper(chains), _RESULT)

    each = rows.select("skill_id", "path", "line", "finding_id", "bits", "flags", F.explode("flags").alias("flag"))
    kind = ["skill_id", "flag", "bits"]
    first = F.row_number().over(Window.partitionBy(*kind).orderBy("path", "line", "finding_id"))
    least = each.groupBy(*kind).agg(F.min("path").alias("least"))
    few = each.withColumn("n", first).where(F.col("n") <= k)
    outside = each.join(least, kind).where("path > least").drop("least").withColumn("n", first).where(F.col("n") <= k)
    across = few.unionByName(outside).drop("n").groupBy("skill_id").applyInPandas(crosser(chains), _RESULT)

    order = F.row_number().over(Window.partitionBy("skill_id", "chain_no").orderBy(F.desc("score"), F.col("one_path") == "", "one_path", "last"))
    names = F.broadcast(found.sparkSession.createDataFrame([(n, *c[:3]) for n, c in enumerate(policy)], "chain_no int, chain string, rule_id string, category string"))
    best = within.unionByName(across).withColumn("n", order).where("n = 1")
    return best.join(names, "chain_no").select("chain", "rule_id", "category", "skill_id", "score", "parts")


def linked(found: DataFrame, heads: DataFrame | None = None, least: int = LEAST, policy: tuple = fixed.CHAINS) -> DataFrame:
    """Behaviour chains (skill_id, chain, rule_id, category, score, severity, parts, paths): the best-linked parts, where they have `least` points or more and aren't all Markdown reference examples; Markdown parts alone make the chain high, else it is critical."""
    md, examples = F.forall("parts", lambda p: p["markdown"]), F.forall("parts", lambda p: p["markdown"] & p["reference"])
    best = best_links(found, heads, policy).where((F.col("score") >= least) & ~examples)
    return best.select("skill_id", "chain", "rule_id", "category", "score", F.when(md, "high").otherwise("critical").alias("severity"), F.col("parts.finding_id").alias("parts"), F.col("parts.path").alias("paths"))
