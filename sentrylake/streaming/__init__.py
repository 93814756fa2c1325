"""Streams of files: the scan's text rules on a Structured Streaming source, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules, segments


def scan(artifacts: DataFrame) -> DataFrame:
    """Findings of the text rules in the files of a stream (skill_id, path, file_type, content, and others, which are dropped): row by row, so that any output mode will do.

    Files are taken as they are: parts hidden in them and findings that need several files belong to the batch scan.
    """
    return rules.evaluate(segments.with_context(segments.original(artifacts)))


def windowed(found: DataFrame, at: str = "seen_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, rule_id, n) of findings with an event time, late ones up to `late`."""
    return found.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "rule_id").agg(F.count("*").alias("n")).select("w.start", "rule_id", "n")
