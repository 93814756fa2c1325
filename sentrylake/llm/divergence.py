"""How far the sources of a language differ in the words they use: exact sums over a frequent-pattern tree of the terms' counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, slices, utf8

#: Entries that a task counts before it hands them on, and bytes of text that it splits at once.
MOST_ENTRIES, PART = 200_000, 1 << 20
#: Bytes as terms hold them: A-Z in lower case, letters and bytes beyond ASCII as they are, the rest a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    plain, at = text.translate(_TERMS), 0
    while at < len(plain):
        end = plain.find(b" ", at + PART)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def count_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as (lang, source, term, n, docs): occurrences, and documents with the term, in some of the rows."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            keys = list(n)
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()),
                    pa.array([n[k] for k in some], pa.int64()), pa.array([docs[k] for k in some], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    entries = 0
    for batch in slices(it):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for some in terms(text):
                n.update(some)
                seen.update(some)
            docs.update(seen)
            entries += len(n) - before
            if entries > MOST_ENTRIES:
                yield from out()
                entries = 0
    yield from out()


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * n / total), exact for counts of any size."""
    return F.call_function("div", n.cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), total.cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def corrections(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, path, m), sorted, as (lang, a, b, value): for pairs of sources that both have a term, what its f(a, b) differs by from what each count alone gives.

    A path is a term's row: the sources that have it, in their order, each with (no, n, p, p0); m terms have that row. The sorted rows are walked as a tree: a node is a prefix that rows share, its
    multiplicity is the sum of theirs, and each node meets each of its ancestors once, both ways. A batch is a tree of its own: a node that two batches share is counted in parts.
    """
    for batch in it:
        langs, m_all = batch.column(0), batch.column(2).to_numpy()
        paths = batch.column(1)
        offsets, items = paths.offsets.to_numpy().astype(np.int64), paths.values
        no, n, p, p0 = (items.field(k).to_numpy().astype(np.int64) for k in range(4))
        lens, lang_no = np.diff(offsets), langs.dictionary_encode().indices.to_numpy()
        names = langs.dictionary_encode().dictionary
        step = max(1, (1 << 20) // max(1, int(lens.max(initial=1))))
        for at in range(0, batch.num_rows, step):
            rows = np.arange(at, min(at + step, batch.num_rows))
            m, here = m_all[rows], lang_no[rows]
            same = np.concatenate(([False], here[1:] == here[:-1]))
            sums: list[tuple[np.ndarray, ...]] = []
            above: list[np.ndarray] = []  # for each depth, where each row's item is
            for depth in range(int(lens[rows].max(initial=0))):
                long = lens[rows] > depth
                where = np.where(long, offsets[rows] + depth, 0)
                equal = np.concatenate(([False], long[1:] & long[:-1] & (no[where[1:]] == no[where[:-1]]) & (n[where[1:]] == n[where[:-1]])))
                same = same & equal
                deep = np.flatnonzero(long)
                first = np.flatnonzero(~same[deep])  # rows of a prefix stand together
                times, node = np.add.reduceat(m[deep], first), deep[first]
                b = where[node]
                for earlier in above:
                    a = earlier[node]
                    pairs = _gap(p0[a], p0[b]), _gap(p0[b], p0[a])
                    sums.append((here[node], no[a], no[b], times * (_gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + pairs[0])))
                    sums.append((here[node], no[b], no[a], times * (_gap(p[b], p[a]) - _gap(p[b], p0[a]) - _gap(p0[b], p[a]) + pairs[1])))
                above.append(where)
            if sums:
                of, a, b, value = (np.concatenate(x) for x in zip(*sums, strict=True))
                order = np.lexsort((b, a, of))
                of, a, b, value = of[order], a[order], b[order], value[order]
                new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of[new])), pa.array(a[new]), pa.array(b[new]), pa.array(np.add.reduceat(value, new))], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ from each other (`pair`) and from the language (`term`).

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a language keeps the V terms that `least_docs` of its documents have. A term that occurs n times in a group has the share
    p = 1 + floor(scale * (n + 1) / (N + V)), N being the group's occurrences of kept terms; f(p, q) = floor((p - q)^2 / q). A `pair` row has the sum of f over all kept terms, the group's share
    against the other source's; a `term` row, of those the group uses more than its language does, f against the language's share, the `top` highest.

    A pair's sum is V * f(p0, q0), as if no term occurred, corrected for the terms that one of both has, by how many terms have each count, and for those that both have by the tree (`corrections`).
    Rows that are equal are counted before they travel, sorted rows are dealt in ranges, and a task sees a batch at a time, so no tree stands whole anywhere. A term's row has an entry for each source
    of its language, and the result a row for each pair of them. All sums are exact.

    Null texts, languages and sources are empty strings. A group without kept terms has shares of no counts; a language without any gives 0 for each pair. Repeated rows are documents each; equal
    values are ranked by the item's UTF-8. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts")).where(F.col("docs") >= least_docs)
    kept = cut(by_term.select("lang", F.col("term").cast("string").alias("term"), "total", "counts"))
    each = kept.select("lang", "term", "total", F.inline("counts"))

    of_lang = rows.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left").na.fill(0)
    groups = rows.select("lang", "source").distinct().join(each.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").na.fill(0, ["size"]).join(of_lang, "lang")
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(1), F.col("size") + F.col("v"), scale))))
    few = bounded(groups)

    items = each.join(few, ["lang", "source"]).withColumn("p", share(F.col("n") + 1, F.col("size") + F.col("v"), scale))
    items = cut(items.select("lang", "source", "term", "no", "n", "p", "p0", share(F.col("total") + 1, F.col("all") + F.col("v"), scale).alias("q")))
    used = items.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    paths = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("no", "n", "p", "p0"))).alias("path"))
    paths = paths.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("m"))
    # ranges by the first items alone, so that the samples that Spark takes for them are small
    head = F.transform(F.slice("path", 1, 3), lambda x: F.struct(x["no"], x["n"]))
    both = paths.repartitionByRange("lang", head).sortWithinPartitions("lang", "path").mapInArrow(corrections, "lang string, a long, b long, value long")
    other = few.select("lang", F.col("no").alias("other"), F.col("p0").alias("q0"))
    alone = items.groupBy("lang", "no", "p", "p0").agg(F.count("*").alias("k")).join(other, "lang").where("no <> other")
    p, p0, q0, k = (F.col(c) for c in ("p", "p0", "q0", "k"))
    ways = F.array(F.struct(F.col("no").alias("a"), F.col("other").alias("b"), (k * (gap(p, q0) - gap(p0, q0))).alias("value")), F.struct(F.col("other").alias("a"), F.col("no").alias("b"), (k * (gap(q0, p) - gap(q0, p0))).alias("value")))
    more = both.unionByName(alone.select("lang", F.inline(ways))).groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("more"))

    a, b = groups.select("lang", "source", F.col("no").alias("a"), "v", "p0"), few.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("p0").alias("q0"))
    pairs = a.join(b, "lang").where("a <> b").join(more, ["lang", "a", "b"], "left")
    base = F.coalesce(F.col("v").cast("decimal(38,0)") * gap(F.col("p0"), F.col("q0")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce(F.col("more"), F.lit(0))).cast("long").alias("value"))

    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranks).unionByName(used.withColumn("rank", ranks).where(F.col("rank") <= top))
