"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of `edges` (a long, b long); returns (node, component).

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every node passes the smallest
    neighbour on to its other neighbours. A step is a min() per node, which is pre-aggregated, and an equi-join
    with those minima, whose heavy nodes AQE can split; no neighbour list is ever collected. Each round is cut
    into the checkpoint folder. Edges with a null end or equal ends are ignored; an empty table gives no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b")
    e = cut(e.distinct())
    state = None
    for _ in range(most_rounds):
        both = e.select("hi", "lo").union(e.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "k")
        small = large.join(least, large.hi == least.k).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
        e = cut(small.select("x.hi", "x.lo").where("hi <> lo").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("lo").agg(F.lit(1)).select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
