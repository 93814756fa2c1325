"""Queries of the supply-chain rules; each with its ANSI twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed, hosts
from ..operators.supply import COMMENT_HEAVY, INVISIBLE_HEAVY, OPAQUE, _mentions, _near, _OVERRIDDEN, _overrides, _prerequisites, _squats, _urls, density
from . import twins
from .dialect import Ansi, Spark
from .scans import kept


def _q_urls(d):
    return ["ctx", *_urls(d)], "select skill_id, path, segment_id, host, rule_id, context, severity from urls where rule_id <> 'D-15A'"


def _q_page_urls(d):
    page = "ctx as (select 'page' || page_id as skill_id, 'page' || page_id as path, 'page' || page_id as segment_id, 'original' as segment_type, 'markdown' as file_type, '' as language, false as reference_example, false as bootstrap, 'markdown' as source_kind, 1 as start_line, 'see ' || url as content from pages)"
    return [page, *_urls(d)], "select rule_id, context, severity, count(*) as n from urls group by rule_id, context, severity"


def _q_mentions(d):
    return ["ctx", *_mentions(d)], "select ecosystem, package, count(*) as n from mentions where package <> '' group by ecosystem, package"


def _q_squat(d):
    return ["ctx", *_mentions(d), *_squats(d)], "select skill_id, path, ecosystem, name, protected from squats where k = 1"


def _q_bundle_squat(d):
    rows = " union all ".join(f"select '{p}' as protected, {k} as place" for k, p in enumerate(fixed.PROTECTED_BUNDLES))
    names = "n as (select doc_id, case doc_id % 4 when 0 then 'skill-instaler' when 1 then 'Brainstroming' when 2 then 'openai_docs' else 'writing-plants' end as bundle from documents)"
    plain = d.replace("lower(bundle)", "[ _-]+", "-")
    return [names, f"p as ({rows})", f"m as (select doc_id, {plain} as name from n)"], f"select doc_id, name, protected from m join p on {_near(d, 'name', 'protected')}"


def _q_index(d):
    return ["ctx", *_overrides(d)], f"select distinct skill_id, path, rule_id, host from overrides where {_OVERRIDDEN}"


def _q_prerequisite(d):
    return ["ctx", *_mentions(d), *_prerequisites(d)], "select distinct skill_id, path, helper, why from prerequisites"


def _q_density(d):
    """Pages, some with planted comments: plain words, wide characters, and characters without room."""
    planted = "select page_id, html || case page_id % 4 when 0 then '<!-- ' || repeat('hidden words ', 400) || '-->' when 1 then '<!--' || repeat('密', 2000) || '-->' when 2 then '<!--' || repeat('\u200b\u200ba', 1200) || '-->' else '' end as html from pages"
    size, hidden, invisible, cells = density(d, "html")
    seen = [f"planted as ({planted})", f"m as (select page_id, {size} as bytes, {hidden} as comment_bytes, {invisible} as invisible_bytes, {cells} as cells from planted)"]
    numbers = ", ".join(f"cast({x} as bigint) as {x}" for x in ("bytes", "comment_bytes", "invisible_bytes", "cells"))
    rules = f"case when {COMMENT_HEAVY} then case when comment_bytes >= 0.6e0 * bytes then 'high' else 'medium' end end as d23a, case when {INVISIBLE_HEAVY} then 'high' end as d23b, case when {OPAQUE} then 'medium' end as d23c"
    return seen, f"select page_id, {numbers}, {rules} from m"


_PLANS: dict[str, Callable] = {"url_classes": _q_urls, "page_url_classes": _q_page_urls, "package_mentions": _q_mentions, "typosquat_packages": _q_squat, "typosquat_bundles": _q_bundle_squat, "index_overrides": _q_index, "prerequisite_helpers": _q_prerequisite, "density_anomalies": _q_density}


def _spark(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts, last = plan(Spark)
        if "ctx" in parts:
            kept(spark, sf_dir, "segments").createOrReplaceTempView("ctx")
            hosts.register(spark)
        for name in ("pages", "documents"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        rest = [p for p in parts if p != "ctx"]
        return spark.sql(("with " + ",\n".join(rest) + "\n" if rest else "") + last)

    return run


def _ansi(plan: Callable) -> str:
    parts, last = plan(Ansi)
    head = twins.scan(upto="ctx").rstrip() + ",\n" if "ctx" in parts else "with "
    return head + ",\n".join(p for p in parts if p != "ctx") + "\n" + last


QUERIES = {name: _spark(plan) for name, plan in _PLANS.items()}
ORACLE_SQL = {name: _ansi(plan) for name, plan in _PLANS.items()}
