"""Adjustments of findings before they are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

_ADJUSTERS = ("LLM-DISPUTE", "LLM-CONFIRM", "LLM-TGT-VERIFY")


def cross_layer_duplicates(found: DataFrame) -> DataFrame:
    """(finding_id) of findings (finding_id, segment_id, category, layer, confidence, seq) that another layer's outdo.

    Per segment and category, in order of seq: a finding of the layer of the best so far takes its place if it is surer, and nothing is dropped;
    one of another layer that is surer drops the best and takes its place, else it is dropped. A null confidence is 1. Findings without a segment stay.
    """
    item = F.struct("seq", F.col("finding_id").alias("id"), "layer", F.coalesce("confidence", F.lit(1.0)).alias("conf"))
    groups = found.where("segment_id is not null").groupBy("segment_id", "category").agg(F.array_sort(F.collect_list(item)).alias("xs")).where("size(xs) > 1")
    fold = """aggregate(slice(xs, 2, size(xs)), named_struct('best', xs[0], 'dropped', cast(array() as array<string>)), (a, x) ->
        case when a.best.layer = x.layer then named_struct('best', case when x.conf > a.best.conf then x else a.best end, 'dropped', a.dropped)
             when x.conf > a.best.conf then named_struct('best', x, 'dropped', array_append(a.dropped, a.best.id))
             else named_struct('best', a.best, 'dropped', array_append(a.dropped, x.id)) end)"""
    return groups.select(F.explode(F.expr(fold)["dropped"]).alias("finding_id"))


def adjusted(found: DataFrame) -> DataFrame:
    """Findings (finding_id, rule_id, confidence, references, disposition, seq) without the reviewers' adjustments, with effective confidence, multiplier and disputed.

    An adjustment refers to findings; of several on one the last by seq counts. A dispute takes half of its confidence off the finding's; a confirmation
    multiplies its points by 1 + 0.15 times its confidence. A finding's null confidence is 1, an adjustment's 0.5.
    """
    is_adjuster = F.col("rule_id").isin(*_ADJUSTERS) & F.col("disposition").isin("dispute", "confirm")
    last = found.where(is_adjuster).select(F.explode("references").alias("ref"), "seq", "disposition", F.coalesce("confidence", F.lit(0.5)).alias("c"))
    last = last.groupBy("ref").agg(F.max_by(F.struct("disposition", "c"), "seq").alias("by"))
    out = found.where(~F.coalesce(is_adjuster, F.lit(False))).join(last.withColumnRenamed("ref", "finding_id"), "finding_id", "left")
    disputed = F.coalesce(F.col("by.disposition") == "dispute", F.lit(False))
    own = F.coalesce("confidence", F.lit(1.0))
    return out.withColumns({
        "effective": F.greatest(F.lit(0.0), F.when(disputed, own * (1 - fixed.DISPUTE_FACTOR * F.col("by.c"))).otherwise(own)),
        "multiplier": F.when(F.col("by.disposition") == "confirm", 1 + fixed.CONFIRM_FACTOR * F.col("by.c")).otherwise(1.0),
        "disputed": disputed,
    }).drop("by")


def guardrail_floors(found: DataFrame, policy: DataFrame) -> DataFrame:
    """(skill_id, floor_rank): the highest floor (floor_rank int) of the policy's rows whose categories (array) a bundle's confirmed findings all have; bundles without one are left out."""
    have = found.where("soft_status = 'confirmed'").select("skill_id", "category").distinct()
    asked = policy.select("floor_rank", F.size(F.array_distinct("categories")).alias("n"), F.explode(F.array_distinct("categories")).alias("category"), F.xxhash64("floor_rank", "categories").alias("row"))
    met = have.join(F.broadcast(asked), "category").groupBy("skill_id", "row", "floor_rank", "n").count().where("count = n")
    return met.groupBy("skill_id").agg(F.max("floor_rank").alias("floor_rank"))
