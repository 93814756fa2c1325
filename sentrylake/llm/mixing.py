"""Mixing of sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, words, written

#: Characters that prose seldom holds; their share lowers a document's quality weight.
NOISE = r"[0-9|%*&#@+=<>{}\[\]\\^~_$/]"
#: A source's sampling keys are dealt into buckets of about so many rows; one bucket a source is sorted.
BUCKET_ROWS = 10_000


def quality(text: Column) -> Column:
    """Weight in [0.05, 1]: one less the share of noise characters; 0.05 for null and empty texts."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.05), 1 - F.regexp_count(text, F.lit(NOISE)) / n)).otherwise(F.lit(0.05))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the id (without one, the text) and the seed alone, so that reruns and retried tasks agree."""
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))
    return (F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, n_rows, target) from sizes (source, source_size, n_rows).

    Sources by code point, null last, take `weights` in turn. The budget, `share` of all sizes, is dealt by weight;
    a target stops at `most_epochs` times its source's size and the excess is dealt again until none is above.
    That is min(most_epochs * size, x * weight) with one x for all: sources by size / weight are capped up to the
    first whose cap the x of the rest doesn't exceed. The windows run over one row a source.
    """
    n = len(weights)
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array([F.lit(float(x)) for x in weights]), (nth % n + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(most_epochs))
    order = Window.orderBy(F.col("most") / F.col("w"), "w", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    free = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("x", left / free)
    s = s.withColumn("x", F.min(F.when(F.col("x") * F.col("w") <= F.col("most"), F.struct((F.col("most") / F.col("w")).alias("o"), "w", F.col("source").isNull().alias("n"), "source", "x"))).over(Window.partitionBy())["x"])
    return s.select("source", "source_size", "n_rows", F.round(F.coalesce(F.least("most", F.col("x") * F.col("w")), F.col("most")), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most_epochs: float = 3.0, seed: int = 6, bucket_rows: int = BUCKET_ROWS, weight: Column | None = None) -> DataFrame:
    """`docs` with size, source_size, target and epochs (times that the mix takes the row, an int).

    A source takes floor(target / size) complete epochs of all its rows. The rest goes by weighted sampling without
    replacement (Efraimidis and Spirakis, 2006): the rows with the smallest -ln(u) / weight, as many as the rest
    holds; the row on the border is taken if at least half of it fits, so a source's words are off by half a row
    at most; of rows that are alike (same id, key and size) as many are taken as fit. Weight: `quality` of the text unless given. Prefix sums run over buckets of keys
    first, and only the bucket with the border, of about `bucket_rows` rows, is sorted: a source of any
    size needs no sort as a whole, and texts are never shuffled. Null and empty texts have size 0 and are taken with each epoch;
    a null source is a source, by name the last; rows with equal keys go by doc_id and size. Empty table: no rows.
    Columns named size, source_size, target or epochs are replaced; others keep their names and values.
    """
    docs = docs.drop("size", "source_size", "target", "epochs")
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    rate = weight if weight is not None else quality(F.col("text"))
    key = F.struct((-F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / rate).alias("k"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("d"), words(F.col("text")).alias("s"))
    keyed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], words(F.col("text")).alias("size"), F.col("source").alias("of"), key.alias("key"))
    small = cut(keyed.select("of", "size", "key"))
    # 1 - exp(-k) spreads the keys, which are about exponential, over (0, 1); any monotone map gives the same result.
    spread = 1 - F.exp(-F.col("key.k"))
    goal = targets(small.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share, most_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = cut(goal.withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows)).withColumnRenamed("source", "src"))
    here = F.col("of").eqNullSafe(F.col("src"))
    dealt = small.join(bounded(goal).select("src", "rest", "buckets"), here).drop("src").withColumn("bucket", F.floor(spread * F.col("buckets")))
    sums = dealt.groupBy("of", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy("of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(so_far.orderBy("bucket"))).where("upto > rest")
    border = cut(sums.groupBy(F.col("of").alias("src")).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("had")), "bucket").alias("b")))
    # within the border's bucket, key by key: rows of one key are alike, and as many as fit are taken
    inside = dealt.join(bounded(border), here).where("bucket = b.bucket").groupBy("of", "key").agg(F.count("*").alias("times"), F.first("rest").alias("rest"), F.first("b.had").alias("had"))
    inside = inside.withColumn("before", F.sum(F.col("times") * F.col("key.s")).over(so_far.orderBy("key")) + F.col("had") - F.col("times") * F.col("key.s"))
    fit = F.when(F.col("key.s") > 0, F.least(F.col("times"), F.floor((F.col("rest") - F.col("before")) / F.col("key.s") + 0.5))).otherwise(F.col("times"))
    last = inside.where("before < rest").withColumn("fit", fit).where("fit > 0").groupBy("of").agg(F.max_by(F.struct("key", "fit", "times"), "key").alias("last"))
    plan = goal.join(border.withColumnRenamed("src", "o1"), F.col("src").eqNullSafe(F.col("o1")), "left").join(last.withColumnRenamed("of", "o2"), F.col("src").eqNullSafe(F.col("o2")), "left")
    plan = cut(plan.select("src", "source_size", "target", "whole", "rest", "buckets", F.col("b.bucket").alias("border"), "last"))
    at, at_last = F.floor(spread * F.col("buckets")), F.coalesce(F.col("key") == F.col("last.key"), F.lit(False))
    more = (F.col("rest") > 0) & (F.col("border").isNull() | (at < F.col("border")) | F.coalesce((at == F.col("border")) & ((F.col("key") < F.col("last.key")) | (at_last & (F.col("last.fit") == F.col("last.times")))), F.lit(False)))
    out = keyed.join(bounded(plan), here)
    epochs = lambda more: (F.col("whole") + more.cast("int")).cast("int").alias("epochs")
    back = [*[F.col(o).alias(c) for c, o in own.items()], "size", "source_size", "target"]
    done = out.where(~(at_last & (F.col("last.fit") < F.col("last.times")))).select(*back, epochs(more))
    if plan.where("last.fit < last.times").isEmpty():
        return out.select(*back, epochs(more))
    # alike rows of which some are taken: numbered within the partitions of a written table, whose counts are added up
    tied = written(out.where(at_last & (F.col("last.fit") < F.col("last.times"))).withColumn("no", F.monotonically_increasing_id()).withColumn("part", F.shiftright("no", 33)))
    counts = tied.groupBy("of", "part").count().withColumn("had", F.sum("count").over(so_far.orderBy("part")) - F.col("count")).select(F.col("of").alias("o1"), F.col("part").alias("p1"), "had")
    nth = F.row_number().over(Window.partitionBy("of", "part").orderBy("no"))
    dealt = tied.withColumn("nth", nth).join(bounded(counts), F.col("of").eqNullSafe(F.col("o1")) & (F.col("part") == F.col("p1")))
    return done.unionByName(dealt.select(*back, epochs(F.col("had") + F.col("nth") <= F.col("last.fit"))))
