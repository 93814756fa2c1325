"""Exports of findings and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def _counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in LEVELS]


def _fields() -> Column:
    return F.struct("path", "line", "rule_id", "severity", "category", "finding_id")


def _results(found: DataFrame) -> DataFrame:
    """(skill_id, rule_id, result): each finding as a result of a SARIF log."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    place = lambda p, n: F.struct(F.struct(F.struct(F.col(p).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col(n), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    refs = found.select("finding_id", F.explode("references").alias("ref")).join(found.select(F.col("finding_id").alias("ref"), "path", "line"), "ref")
    related = refs.groupBy("finding_id").agg(F.array_sort(F.collect_list(place("path", "line"))).alias("relatedLocations"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("category").alias("text")).alias("message"), F.array(place("path", "line")).alias("locations"), "relatedLocations", F.lit(100).alias("rank"))
    return found.join(related, "finding_id", "left").select("skill_id", "rule_id", result.alias("result"))


def findings_json(found: DataFrame) -> DataFrame:
    """(skill_id, document): one JSON document a bundle, with counts by severity and the findings without texts, in canonical order."""
    by = found.groupBy("skill_id").agg(*_counts(), F.array_sort(F.collect_list(_fields())).alias("findings"))
    return by.select("skill_id", F.to_json(F.struct("skill_id", F.struct(*LEVELS).alias("summary"), "findings")).alias("document"))


def sarif(found: DataFrame, tool: str = "sentrylake") -> DataFrame:
    """(skill_id, document): a SARIF 2.1.0 log a bundle, with each rule once and related locations by reference."""
    rows = _results(found)
    by = rows.groupBy("skill_id").agg(F.array_sort(F.collect_list("result")).alias("results"), F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id")))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return by.select("skill_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def write_documents(found: DataFrame, path: str, kind: str = "json", tool: str = "sentrylake") -> None:
    """Writes one document a bundle, as `findings_json` (kind json) or `sarif` (kind sarif) has it, as the only text file of the folder skill_id=... under `path`; a path that is there already is an error.

    A document is written piece by piece from sorted rows: head, a line for each finding, tail. So no bundle's findings are gathered in memory, however many they are; a bundle is one task, since it is
    one file, and its sort spills.
    """
    sarif_ = kind == "sarif"
    if kind not in ("json", "sarif"):
        raise ValueError(f"no kind of document {kind}")
    if sarif_:
        rows = _results(found).select("skill_id", F.col("result").alias("x"))
        heads = found.groupBy("skill_id").agg(F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id")))).alias("rules"))  # as many as there are rules
        head = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":'), F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver"))), F.lit(',"results":['))
    else:
        rows = found.select("skill_id", _fields().alias("x"))
        heads = found.groupBy("skill_id").agg(*_counts())
        head = F.concat(F.lit('{"skill_id":'), F.regexp_extract(F.to_json(F.struct("skill_id")), r'(?s)^\{"skill_id":(.*)\}$', 1), F.lit(',"summary":'), F.to_json(F.struct(*LEVELS)), F.lit(',"findings":['))
    n = F.row_number().over(Window.partitionBy("skill_id").orderBy("x"))
    body = rows.withColumn("n", n).select("skill_id", F.lit(1).alias("part"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.to_json("x")).alias("piece"))
    ends = heads.select("skill_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("n"), head.alias("piece")), F.struct(F.lit(2).alias("part"), F.lit(0).alias("n"), F.lit("]}]}" if sarif_ else "]}").alias("piece")))).alias("e"))
    pieces = body.unionByName(ends.select("skill_id", "e.*"))
    pieces.repartition("skill_id").sortWithinPartitions("skill_id", "part", "n").select("skill_id", "piece").write.partitionBy("skill_id").mode("errorifexists").text(path)


def save_run(results: DataFrame, run_id: str, path: str) -> None:
    """Adds a run's results, partitioned by run, and a row of its summary (rows, columns of numbers as sums); a run that is there already is an error."""
    root = path.rstrip("/")
    rows = results.drop("run_id")
    rows.write.mode("errorifexists").parquet(f"{root}/run_id={run_id}")
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    summary = rows.agg(F.count("*").alias("n_results"), *[F.sum(f"`{c}`").alias(f"sum_{c}") for c in numbers])
    summary.write.mode("errorifexists").parquet(f"{root}/summaries/run_id={run_id}")


def load_run(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Results and summary of an earlier run."""
    return spark.read.parquet(f"{path.rstrip('/')}/run_id={run_id}"), spark.read.parquet(f"{path.rstrip('/')}/summaries/run_id={run_id}")


def bless(path: str, run_id: str, name: str, spark) -> None:
    """Keeps a run under a baseline's name, in place of what it held."""
    spark.read.parquet(f"{path.rstrip('/')}/run_id={run_id}").write.mode("overwrite").parquet(f"{path.rstrip('/')}/baselines/name={name}")
