"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut as cut, shared_folder
from ..shipping import ship

T = TypeVar("T")
#: Settings for how much of a partition is held at a time.
BATCHES = {"arrow": "spark.sql.execution.arrow.maxBytesPerBatch", "parquet": "spark.sql.parquet.columnarReaderBatchSize"}
#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The table, written as Parquet in the shared folder and read again: for what is too large to keep as a checkpoint's rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings while an action runs, by the last part of their names in BATCHES; what they were before is set again."""
    keys = {BATCHES[k]: v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Marks a small table for broadcast if it has at most `most_rows` rows; a larger one is joined as Spark plans."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def thinned(h: Column, wanted: int, n: int | Column) -> Column:
    """Whether a row's hash puts it among about `wanted` of n rows, so that a top-k by hash gathers few rows from each task, however many tasks there are."""
    share = F.lit(float(wanted)) / F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1))
    return F.pmod(F.shiftright(h, 8), F.lit(1 << 40)) < share * float(1 << 40)


_held: tuple[object, object] = (None, None)


def held(key: object, make: Callable[[], T]) -> T:
    """What `make` gives, kept in this Python worker until another key is asked for: a worker that serves several operators holds one model at a time."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        _held = (key, make())
    return _held[1]  # type: ignore[return-value]


def slices(it: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows`, so that few texts are Python objects at once."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))
