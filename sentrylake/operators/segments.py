"""Segments: the parts of a file that are scanned, with hidden parts as children."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, prefilter, signs, text
from ..functions.portable import portable
from ..lineage import cut
from .positions import located

FENCE = r"(?s)```([^\n`]*)\n(.*?)\n```"
_FENCE0 = r"```[^\n`]*\n.*?\n```"
#: Leftmost of either, so that neither is found within the other.
FENCE_OR_COMMENT = rf"(?s){_FENCE0}|<!--.*?-->"
FENCE_COMMENT_OR_CODE = rf"(?s){_FENCE0}|<!--.*?-->|[A-Za-z0-9+/=]{{16,}}"
BASE64 = r"^[A-Za-z0-9+/]{16,}={0,2}$"
ROT13 = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")
#: Signs of fences, comments and ROT13 (`signs.held`).
_SIGNS = ((b"```",), (b"<!--",), (b"rot13", b"rot_13"))
MOST_DECODED, MOST_CHARS, MOST_SEGMENTS = 8, 4096, 64


def segment_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16)


def original(artifacts: DataFrame) -> DataFrame:
    """One segment for each file."""
    return artifacts.select(
        "skill_id", "path", "file_type", segment_id(F.col("path"), F.lit("original")).alias("segment_id"), F.lit("original").alias("segment_type"), "content", F.lit(1).alias("start_line"),
        F.lit("").alias("language"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<string>").alias("ancestors"), F.array().cast("array<bigint>").alias("key"), F.array(F.lit("original")).alias("chain"),
    )


def children(parents: DataFrame) -> DataFrame:
    """Code fences, comments outside fences, decoded base64 outside both, ROT13 where the text speaks of it, and the description of a manifest's frontmatter. Each kind is looked for in texts with its signs only: one pass over all texts finds these, and those that have any, as a rule few, are kept in the shared folder; places come from `positions.located`."""
    c = F.col("content")
    may = parents.where((F.col("file_type") == "markdown") & F.col("segment_type").isin("original", "html_comment", "code_fence"))
    manifest = (F.col("segment_type") == "original") & F.col("path").rlike(text.MANIFEST)
    may = may.withColumns({"__signs": signs.held(c, _SIGNS), "__coded": signs.has_code(c, MOST_CHARS * 4 // 3)})
    may = cut(may.where((F.size("__signs") > 0) | F.col("__coded") | F.coalesce(manifest, F.lit(False))))
    has = lambda k: F.array_contains("__signs", F.lit(k))

    def matched(sign: Column, pattern: str, keep: Column | None = None) -> DataFrame:
        out = located(may.where(sign), "content", F.lit(pattern), ["segment_id"]).withColumn("line", F.col("start_line") + F.col("line_no") - 1)
        return (out if keep is None else out.where(keep)).drop("offset", "line_no", "column_no", "__signs", "__coded")

    def child(rows: DataFrame, kind: str, no: int, i: Column, content: Column, line: Column, language: Column | None = None) -> DataFrame:
        ordinal = (F.lit(no * 1_000_000_000) + i).cast("long")
        return rows.select(
            "skill_id", "path", "file_type", segment_id(F.col("segment_id"), F.lit(kind), ordinal.cast("string")).alias("segment_id"), F.lit(kind).alias("segment_type"), content.alias("content"), line.cast("int").alias("start_line"), (F.lit("") if language is None else language).alias("language"),
            (F.col("depth") + 1).alias("depth"), F.col("segment_id").alias("parent_id"), F.concat("ancestors", F.array("segment_id")).alias("ancestors"), F.concat("key", F.array(ordinal)).alias("key"), F.concat("chain", F.array(F.lit(kind))).alias("chain"),
        )

    i, m, line = F.col("match_no"), F.col("match"), F.col("line")
    fences = child(matched(has(0), FENCE), "code_fence", 0, i, F.regexp_extract(m, FENCE, 2), line + 1, F.lower(F.trim(F.regexp_extract(m, FENCE, 1))))
    comments = child(matched(has(1), FENCE_OR_COMMENT, m.startswith("<!--")), "html_comment", 1, i, F.substr(m, F.lit(5), F.length(m) - 7), line)
    codes = matched(F.col("__coded"), FENCE_COMMENT_OR_CODE, m.rlike(BASE64) & (F.length(m) % 4 == 0) & (F.length(m) <= MOST_CHARS * 4 // 3))
    codes = codes.withColumn("decoded", F.try_to_binary(m, F.lit("base64")).cast("string")).where(F.is_valid_utf8("decoded") & (F.length("decoded") > 0))
    first = F.row_number().over(Window.partitionBy("segment_id").orderBy("match_no"))
    codes = child(codes.withColumn("n", first).where(F.col("n") <= MOST_DECODED), "base64_decode", 2, i, F.col("decoded"), line)
    rotated = child(may.where(has(2) & c.rlike("(?i)rot_?13")), "rot13", 3, F.lit(0), F.translate(c, *ROT13), F.col("start_line"))
    told, told_line = text.description(c)
    described = child(may.where(manifest & told.isNotNull()), "frontmatter_description", 4, F.lit(0), told, told_line)
    # as many partitions as the parents have: each kind brings its own, and generations would multiply them
    return fences.unionByName(comments).unionByName(codes).unionByName(rotated).unionByName(described).coalesce(max(1, may.rdd.getNumPartitions()))


def expand(artifacts: DataFrame, depth: int = 3, most: int = MOST_SEGMENTS) -> DataFrame:
    """All segments of the files: `depth` generations, unrolled; of a file's derived segments the first `most` in document order."""
    first = original(artifacts)
    level, below = first, None
    for _ in range(depth):
        level = cut(children(level))  # the derived parts, so that no text is taken apart again for the next generation
        below = level if below is None else below.unionByName(level)
    if below is None:
        return first
    n = F.row_number().over(Window.partitionBy("path").orderBy("key"))
    return first.unionByName(below.withColumn("n", n).where(F.col("n") <= most).drop("n"))


def with_context(segments: DataFrame) -> DataFrame:
    """Adds context, source_kind, reference_example and bootstrap, the facts that rules and labels read."""
    given, c, path = segments.columns, F.col("content"), F.lower(F.replace(F.concat(F.lit("/"), F.col("path")), F.lit("\\"), F.lit("/")))
    markdown = F.col("file_type") == "markdown"
    hint = lambda names: F.greatest(*[path.contains(x) for x in names])
    # one pass over the texts finds the words of all patterns
    every = {k: [f"(?i){p}" for p in ps] for k, ps in (("reference", fixed.REFERENCE_PATTERNS), ("bootstrap", fixed.BOOTSTRAP_PATTERNS))}
    needs = [tuple(w.encode() for w in words) for words in (fixed.ACTIONABLE_VERBS, fixed.ACTIONABLE_HEADINGS)] + [prefilter.signs_of(p) for ps in every.values() for p in ps]
    segments = segments.withColumn("__held", signs.held(c, tuple(needs), once=True))
    has = lambda k: F.array_contains("__held", F.lit(k))

    def found_any(kind: str) -> Column:
        at = 2 + (0 if kind == "reference" else len(every["reference"]))
        tests = [(has(k) if needs[k] else F.lit(True)) & c.rlike(portable(p)) for k, p in enumerate(every[kind], at)]
        return functools.reduce(lambda a, b: a | b, tests)

    context = (
        F.when(F.col("segment_type") == "frontmatter_description", "frontmatter_description")
        .when(~markdown, "code")
        .when((F.col("segment_type") == "code_fence") & F.col("language").isin(*fixed.EXECUTABLE_LANGUAGES), "executable_snippet")
        .when((has(0) & c.rlike(portable(text.word_of(fixed.ACTIONABLE_VERBS)))) | (has(1) & c.rlike(portable(text.heading_of(fixed.ACTIONABLE_HEADINGS)))), "actionable_instruction")
        .otherwise("documentation")
    )
    kind = F.when(F.col("segment_type") == "frontmatter_description", "frontmatter_description").when(markdown, "markdown").otherwise("code")
    return segments.withColumns({
        "context": context,
        "source_kind": kind,
        "reference_example": hint(fixed.REFERENCE_PATHS) | (markdown & found_any("reference")),
        "bootstrap": hint(fixed.BOOTSTRAP_PATHS) | found_any("bootstrap"),
    }).select(*given, "context", "source_kind", "reference_example", "bootstrap")
