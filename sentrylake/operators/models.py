"""Hooks for scorers and reviewers that the caller brings, and the text that they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

WORDS = {"very low": 0.1, "low": 0.3, "medium": 0.5, "moderate": 0.5, "high": 0.8, "very high": 0.95, "certain": 1.0}


def candidates(artifacts: DataFrame) -> DataFrame:
    """Files that models read: manifests, prose and documentation; never references or code."""
    p = F.lower("path")
    return artifacts.where((p.rlike(r"(?:^|/)skill\.md$") | p.rlike(r"\.(?:md|ya?ml|txt|rst)$") | p.contains("/docs/")) & ~p.contains("references/"))


def split_chunks(content: str, most: int = 1800, overlap: int = 3, least: int = 12) -> list[str]:
    """Runs of whole lines of at most `most` characters, each beginning with the last `overlap` lines of the one before; a longer line is a chunk by itself."""
    lines, out, at = content.split("\n"), [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= most):
            size += len(lines[end]) + 1
            end += 1
        chunk = "\n".join(lines[at:end])
        if len(chunk.strip()) >= least:
            out.append(chunk)
        if end >= len(lines):
            break
        at = max(at + 1, end - overlap)
    return out


def chunks(segments: DataFrame) -> DataFrame:
    """(skill_id, path, segment_id, chunk_no, chunk) of each segment's text."""
    ship(segments.sparkSession)

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_chunks(t or ""))

    return segments.select("skill_id", "path", "segment_id", F.posexplode(cut_up("content")).alias("chunk_no", "chunk"))


def score(parts: DataFrame, scorers: dict[str, Callable[[], Callable[[list[str]], list[float]]]], batch: int = 8) -> DataFrame:
    """(segment_id, chunk_no, model_id, malicious_score, error): each scorer, made once a task, over batches of chunks. One that fails gives rows with an error and no score."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {}
        for pdf in it:
            for name, make in scorers.items():
                scores, error = [], None
                try:
                    made[name] = made.get(name) or make()
                    for at in range(0, len(pdf), batch):
                        scores += list(made[name](pdf.chunk[at : at + batch].tolist()))
                except Exception as e:
                    scores, error = [None] * len(pdf), str(e)
                yield pd.DataFrame({"segment_id": pdf.segment_id, "chunk_no": pdf.chunk_no, "model_id": name, "malicious_score": scores, "error": error})

    return parts.select("segment_id", "chunk_no", "chunk").mapInPandas(run, "segment_id string, chunk_no int, model_id string, malicious_score double, error string")


def excerpts(segments: DataFrame, found: DataFrame, reach: int = 12, most: int = 4000) -> DataFrame:
    """(segment_id, excerpt): lines within `reach` of a finding; stretches that touch are one, and what is left out between is marked."""
    spans = found.join(segments.select("segment_id", F.col("start_line").alias("s")), "segment_id").select("segment_id", F.greatest(F.col("line") - F.col("s") + 1 - reach, F.lit(1)).alias("a"), (F.col("line") - F.col("s") + 1 + reach).alias("b")).distinct()
    w = Window.partitionBy("segment_id").orderBy("a", "b")
    new = (F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1).cast("int")
    spans = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("segment_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    lines = segments.select("segment_id", F.split("content", "\n").alias("lines"))
    parts = islands.join(lines, "segment_id").select("segment_id", "island", F.array_join(F.expr("slice(lines, cast(a as int), cast(b - a + 1 as int))"), "\n").alias("t"))
    return parts.groupBy("segment_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "t"))), lambda x: x["t"]), "\n[...]\n"), 1, most).alias("excerpt"))


def confidence(value: Column) -> Column:
    """A number from 0 to 1 of a reviewer's confidence, given as a number or in words; 0.5 for others."""
    table = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.expr("0.0D") + F.when(value.rlike(r"^\s*[0-9.]+\s*$"), F.trim(value).cast("double")), F.lit(0.5))))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(disposition, severity, category, message, confidence) of each reply: JSON, alone, in a fence or within prose."""
    body = F.coalesce(F.nullif(F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.regexp_extract("reply", r"(?s)(\{.*\})", 1))
    out = replies.withColumn("x", F.from_json(body, "disposition string, severity string, category string, message string, confidence string"))
    return out.select(*replies.columns, F.lower("x.disposition").alias("disposition"), "x.severity", "x.category", "x.message", confidence(F.col("x.confidence")).alias("confidence"))


def review(jobs: DataFrame, reviewers: dict[str, Callable[[], Callable[[str], str]]]) -> DataFrame:
    """(job, model_id, reply): each reviewer, made once a task, answers the prompt of each row (job string, prompt string)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {name: make() for name, make in reviewers.items()}
        for pdf in it:
            for name, ask in made.items():
                yield pd.DataFrame({"job": pdf.job, "model_id": name, "reply": [ask(p) for p in pdf.prompt]})

    return jobs.select("job", "prompt").mapInPandas(run, "job string, model_id string, reply string")
