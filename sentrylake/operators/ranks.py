"""Row numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def numbered(df: DataFrame, name: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's number, from 1, in the order of the columns `order`, counted anew for each value of the columns `within`.

    Two levels: rows are dealt in ranges of (within, order), which splits a hot value, and kept in the shared folder; each range numbers its own rows, and the counts of the ranges before are added.
    What meets in one place are counts, one a range, or one a range and value of `within`. Rows that are equal in the order are numbered in any order; nulls come first.
    """
    ranged = cut(df.repartitionByRange(*within, *order).withColumn("__range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__range", *within).orderBy(*order))
    counts = ranged.groupBy("__range", *within).agg(F.count("*").alias("__n"))
    if within:
        earlier = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n").withColumnsRenamed({c: f"__of_{c}" for c in within}).withColumnRenamed("__range", "__of_range")
        same = F.col("__range") == F.col("__of_range")
        for c in within:
            same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        out = ranged.withColumn("__own", own).join(before, same)
    else:
        rows, total = [], 0
        for r in sorted(counts.collect()):  # one a range
            rows.append((r["__range"], total))
            total += r["__n"]
        before = df.sparkSession.createDataFrame(rows or [(0, 0)], "__of_range int, __before long")
        out = ranged.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__of_range"))
    return out.select(*df.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name))
