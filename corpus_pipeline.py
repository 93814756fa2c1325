"""The corpus pipeline: language, near-duplicates, personal data, mixing and encoding, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import langid, mixing, pieces, pii, simhash
from sentrylake.llm.common import table, written
from sentrylake.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language (null, or without a letter); the languages are learned from the labelled documents."""
    ship(spark)
    return langid.keep_known(docs, langid.sample(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the one with the smallest id."""
    ship(spark)
    return simhash.deduplicate(docs, similarity=(4, 5), width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    ship(spark)
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have their target weights; a document taken in three epochs is three rows."""
    ship(spark)
    own = {c: f"__own_{c}" for c in ("size", "source_size", "target", "epochs") if c in docs.columns}
    taken = mixing.mix(docs.withColumnsRenamed(own)).where("epochs > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return taken.drop("__copy", "size", "source_size", "target", "epochs").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ship(spark)
    return pieces.encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("pieces", encoded)]

#: SQL expresses neither suffix automata, XXH64, the tagger nor the vocabulary; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
