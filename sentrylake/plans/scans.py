"""Queries of the scan: segments, rules, post-rules; each with its ANSI twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..lineage import cut
from ..operators import changes, chains, expectations, postrules, rules, segments, structure
from ..sources import tables
from . import twins

_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Tables that the test queries share: segments (with context) and findings of the planted documents, made once for the state of the documents' files and kept in the shared folder. The operators keep nothing by themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    state = tuple(docs.agg(F.max("_metadata.file_modification_time"), F.count("*")).first())
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _kept:
        made = segments.with_context(segments.expand(tables.planted(spark, sf_dir))) if name == "segments" else postrules.all_findings(kept(spark, sf_dir, "segments"))
        _kept[key] = cut(made)
    return _kept[key]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    docs = tables.planted(spark, sf_dir)
    counts = [F.struct(F.lit(k).alias("change"), F.regexp_count(c, F.lit(p)).alias("n")) for k, p in text.REMOVALS]
    folded = text.fold_look_alikes(text.remove_invisible(c))
    changed = F.when(text.is_mixed_script(text.remove_invisible(c)), F.size(F.filter(F.arrays_zip(F.split(text.remove_invisible(c), "").alias("a"), F.split(folded, "").alias("b")), lambda x: x["a"] != x["b"]))).otherwise(0)
    counts.append(F.struct(F.lit("homoglyph").alias("change"), changed.alias("n")))
    return docs.select(F.explode(F.array(*counts)).alias("x")).where("x.n > 0").groupBy("x.change").agg(F.count("*").alias("files"), F.sum("x.n").alias("changes"))


def _changes_sql() -> str:
    clean = "content"
    for _, p in text.REMOVALS:
        clean = twins.D.replace(clean, p, "")
    parts = [f"select '{k}' as change, len({twins.D.found('content', p)}) as n from artifacts" for k, p in text.REMOVALS]
    parts.append(f"select 'homoglyph', (select count(*) from unnest(range(1, length({clean}) + 1)) u(i) where substr({clean}, i, 1) <> substr({twins._folded('content')}, i, 1)) from artifacts where {twins.mixed(clean)}")
    return f"with {twins.artifacts()}, c as ({' union all '.join(parts)}) select change, count(*) as files, sum(n)::bigint as changes from c where n > 0 group by change"


def norm_delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changes(tables.planted(spark, sf_dir)).select("path", "change", "step", "offset", "line_no", "column_no", "code_point", "snippet", "replacement")


def _delta_sql() -> str:
    """Each character or keyword by its number in the text, places from the text before it."""
    place = "length({0}) as off, 1 + length({0}) - length(replace({0}, chr(10), '')) as line_no, 1 + length(string_split({0}, chr(10))[-1]) as column_no"
    digits = "upper(printf('%04x', unicode(ch)))"
    parts, now = [twins.artifacts(), "t0 as (select path, content as t from artifacts)"], 0
    rows = []
    for change, what in text.REMOVALS:
        parts.append(f"t{now + 1} as (select path, {twins.D.replace('t', what, '')} as t from t{now})")
        each = f"select path, t, unnest(range(1, length(t) + 1)) as i from t{now} where {twins.D.like('t', what)}"
        rows.append(f"select path, '{change}' as change, {now} as step, {place.format('pre')}, 'U+' || {digits} as code_point, ch as snippet, '' as replacement from (select path, substr(t, i, 1) as ch, substr(t, 1, i - 1) as pre from ({each})) where {twins.D.like('ch', what)}")
        now += 1
    each = f"select path, t, unnest(range(1, length(t) + 1)) as i from t{now} where {twins.mixed('t')}"
    chars = f"select path, substr(t, i, 1) as ch, substr(t, 1, i - 1) as pre, regexp_extract(substr(t, 1, i - 1), '\\S*$') || regexp_extract(substr(t, i), '^\\S*') as word from ({each})"
    by = f"translate(ch, '{fixed.LOOK_ALIKES}', '{fixed.LOOKS_LIKE}')"
    rows.append(f"select path, 'homoglyph', {now}, {place.format('pre')}, 'U+' || {digits}, ch, {by} from ({chars}) where {by} <> ch and {twins.mixed('word')}")
    # folded texts of those that have a split run; the removals are made anew within
    parts.append(f"t{now + 1} as materialized (select path, {twins._folded('content')} as t from artifacts where {twins.D.like(twins._folded('content'), text.SPLIT)})")
    now += 1
    for word in fixed.SPLIT_KEYWORDS:
        what, w = text.split_keyword(word), twins.D.text(word)
        for _ in range(3 if word[0] == word[-1] else 1):
            each = f"select path, {twins.D.found('t', what)} as f, string_split_regex(t, {twins.D.text(what)}) as p from t{now} where {twins.D.like('t', what)}"
            one = f"select path, f[i] as m, array_to_string(p[1:i], {w}) as pre from (select *, unnest(range(1, len(f) + 1)) as i from ({each}))"
            rows.append(f"select path, 'keyword', {now}, {place.format('pre')}, null, m, {w} from ({one})")
            parts.append(f"t{now + 1} as materialized (select path, {twins.D.replace('t', what, word)} as t from t{now})")
            now += 1
    every = "\nunion all ".join(rows)
    return "with " + ",\n".join(parts) + f", every as ({every}) select path, change, cast(step as int) as step, cast(off as bigint) as \"offset\", cast(line_no as int) as line_no, cast(column_no as int) as column_no, code_point, snippet, replacement from every"


def _parts(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seg = kept(spark, sf_dir, "segments").where(F.col("segment_type") == kind)
        return seg.select("path", "segment_id", "parent_id", "start_line", "language", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))

    return run


def _parts_sql(kind: str) -> str:
    return twins.scan(upto="segs") + f"select path, segment_id, parent_id, start_line, language, length(content) as n_chars, md5(content) as digest from segs where segment_type = '{kind}'"


def page_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments.expand(tables.pages(spark, sf_dir), depth=1).where("segment_type = 'html_comment'")
    return seg.select("path", "segment_id", "start_line", F.md5(F.col("content").cast("binary")).alias("digest"))


def _rule_hits(*prefixes: str):
    cond = lambda c: " or ".join(f"{c} like '{p}%'" for p in prefixes)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = kept(spark, sf_dir, "findings").where(cond("rule_id"))
        return found.select("finding_id", "skill_id", "path", "segment_type", "rule_id", "severity", "category", "line", "context", "source_kind", "reference_example", "bootstrap")

    sql = twins.scan() + f"select finding_id, skill_id, path, segment_type, rule_id, severity, category, line, context, source_kind, reference_example, bootstrap from everything where {cond('rule_id')}"
    return run, sql


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "segments").groupBy("segment_type", "context", "source_kind", "reference_example", "bootstrap").agg(F.count("*").alias("n"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.planted(spark, sf_dir)
    return text.with_normalized(docs, "content", "normal").select("path", F.md5(F.col("normal").cast("binary")).alias("digest"))


#: Chains of more than two flags, for the query that shows them.
LONG_CHAINS = (
    ("Read, send and run", "X-19A", "data_exfiltration", "READ_SENSITIVE", "NETWORK_SEND", "EXEC_DYNAMIC"),
    ("Silent persistence", "X-19B", "persistence", "SUPPRESSION_PRESENT", "WRITE_SYSTEM", "EXEC_DYNAMIC"),
)


def _parts_of_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return kept(spark, sf_dir, "findings").where("rule_id not like 'D-19%'"), chains.headings(kept(spark, sf_dir, "segments"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda what, k: F.col(what)[k].alias(f"{what[:-1]}_{'ab'[k]}")
    return chains.linked(*_parts_of_chains(spark, sf_dir)).select("skill_id", "chain", "rule_id", "category", "score", "severity", *(part(what, k) for what in ("parts", "paths") for k in (0, 1)))


def _long_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.best_links(*_parts_of_chains(spark, sf_dir), policy=LONG_CHAINS)
    return found.select("skill_id", "chain", "score", F.array_join("parts.finding_id", ",").alias("parts"), F.array_join("parts.path", ",").alias("paths"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(spark, sf_dir, "findings").where(F.col("rule_id").isin(*{r.rule_id for r in rules.RULES}))
    return found.select("finding_id", "rule_id", "path", "line", F.col("column").alias("column_no"))


def _linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.best_links(*_parts_of_chains(spark, sf_dir)).select("skill_id", "chain", F.col("score").alias("best"))


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(spark, sf_dir, "findings").where("rule_id in ('D-21A', 'D-22A')")
    return found.select("finding_id", "path", "rule_id", F.array_join("references", ",").alias("supporting"))


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "segments").groupBy("depth", "segment_type", F.array_join("chain", ">").alias("chain")).agg(F.count("*").alias("n"))


_CUSTOM = (("X-1", "the[a-z]+ing", "low", "custom"), ("X-2", r"[0-9]{3}-[0-9]{4}", "medium", "custom"), ("X-3", "LICENSE", "high", "custom"))


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(_CUSTOM, "rule_id string, pattern string, severity string, category string")
    found = rules.custom(segments.original(tables.planted(spark, sf_dir)), given)
    return found.groupBy("rule_id", "severity", "skill_id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "findings").groupBy("rule_id", "soft").agg(F.count("*").alias("n"))


def _enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("category", "prompt_injection", False), ("rule", "D-11A", True), ("rule", "D-9A", False), ("category", "suppression", False)], "kind string, name string, on boolean")
    on = rules.enabled(rules.catalogue(spark), policy)
    return kept(spark, sf_dir, "findings").join(F.broadcast(on.select("rule_id", F.col("category").alias("family"))), "rule_id").groupBy("rule_id", "family").agg(F.count("*").alias("n"))


_HITS = {
    "rule_hits_unicode": ("D-1", "D-2A", "NC-"), "rule_hits_encoding": ("D-3", "D-4", "D-5"), "rule_hits_secrets": ("D-7", "D-8"), "rule_hits_behavioral": ("D-9", "D-10"), "rule_hits_injection": ("D-11",),
    "rule_hits_suppression": ("D-12",), "rule_hits_temporal": ("D-16", "D-17", "D-18"), "rule_hits_prerelease": ("D-20G",), "rule_hits_supply": ("D-15", "D-20", "D-23"), "keyword_split_findings": ("D-6",),
}
_HITS["rule_hits_unicode"] = ("D-1A", "D-1B", "D-1C", "D-1D", "D-2A", "NC-")
QUERIES = {
    "norm_changes_by_type": _changes,
    "normalized_text": normalized_text,
    "norm_delta_rows": norm_delta_rows,
    "code_fence_segments": _parts("code_fence"),
    "html_comment_segments": _parts("html_comment"),
    "base64_segments": _parts("base64_decode"),
    "rot13_segments": _parts("rot13"),
    "page_comment_segments": page_comments,
    "segment_tree_depth": _depth,
    "segment_context": _context,
    "custom_rules": _custom,
    "soft_tagged": _soft,
    "rules_enabled": _enabled,
    "hidden_content_provenance": _hidden,
    "behaviour_chains": _chains,
    "chain_linkage": _linkage,
    "chain_n_way": _long_chains,
    "finding_columns": _columns,
} | {k: _rule_hits(*v)[0] for k, v in _HITS.items()}
_soft_list = ", ".join(f"'{r}'" for r in fixed.SOFT_RULES)
_cat = ", ".join(f"('{k}', '{c}')" for k, c in sorted({r.rule_id: r.category for r in rules.RULES}.items()) + sorted((r[0], r[2]) for r in rules.OTHER_RULES))
ORACLE_SQL = {
    "norm_changes_by_type": _changes_sql(),
    "norm_delta_rows": _delta_sql(),
    "normalized_text": twins.scan_without_hits() + "select path, md5(t) as digest from normal",
    **{f"{n}_segments": _parts_sql(k) for n, k in (("code_fence", "code_fence"), ("html_comment", "html_comment"), ("base64", "base64_decode"), ("rot13", "rot13"))},
    "page_comment_segments": twins.scan(twins.pages(), "segs") + "select path, segment_id, start_line, md5(content) as digest from segs where segment_type = 'html_comment'",
    "segment_tree_depth": twins.scan(upto="segs") + "select depth, segment_type, array_to_string(chain, '>') as chain, count(*) as n from segs group by all",
    "segment_context": twins.scan(upto="ctx") + "select segment_type, context, source_kind, reference_example, bootstrap, count(*) as n from ctx group by all",
    "custom_rules": f"with {twins.artifacts()}, g(rule_id, pattern, severity) as (values {', '.join(f'({twins.D.text(a)}, {twins.D.text(b)}, {twins.D.text(c)})' for a, b, c, _ in _CUSTOM)}), m as (select rule_id, severity, skill_id, path, unnest(regexp_extract_all(content, '(?i)' || pattern, 0)) as m from artifacts, g) select rule_id, severity, skill_id, count(*) as n, count(distinct path) as files from m group by all",
    "soft_tagged": twins.scan() + f"select rule_id, rule_id in ({_soft_list}) as soft, count(*) as n from everything group by all",
    "rules_enabled": twins.scan() + f", cat(rule_id, family) as (values {_cat}) select rule_id, family, count(*) as n from everything join cat using (rule_id) where case when rule_id = 'D-11A' then true when rule_id = 'D-9A' then false else family not in ('prompt_injection', 'suppression') end group by all",
    "hidden_content_provenance": twins.scan() + "select finding_id, path, rule_id, array_to_string(refs, ',') as supporting from everything where rule_id in ('D-21A', 'D-22A')",
    "behaviour_chains": twins.scan() + "select skill_id, chain, rule_id, category, score, severity, part_a, part_b, path_a, path_b from linked",
    "chain_n_way": twins.scan() + ", " + twins.product(LONG_CHAINS) + " select skill_id, chain, score, parts, paths from chained",
    "finding_columns": twins.scan(upto="hits") + "select finding_id, rule_id, path, cast(line as int) as line, cast(column_no as int) as column_no from hits",
    "chain_linkage": twins.scan() + "select skill_id, chain, max(score) as best from pairs group by all",
} | {k: _rule_hits(*v)[1] for k, v in _HITS.items()}


def _findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import findings_json

    return findings_json(kept(spark, sf_dir, "findings"))


def _sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import sarif

    return sarif(kept(spark, sf_dir, "findings"))


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.models import excerpts

    return excerpts(kept(spark, sf_dir, "segments"), kept(spark, sf_dir, "findings").where("segment_id is not null"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.models import candidates, chunks

    parts = chunks(candidates(kept(spark, sf_dir, "segments").where("segment_type = 'original'")))
    return parts.select("path", "segment_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


QUERIES |= {"findings_json": _findings_json, "sarif_docs": _sarif, "review_excerpts": _excerpts, "text_chunks": _chunks}


def _one_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text rule, a rule on normalised text and a chain, each evaluated with what it needs alone."""
    seg = kept(spark, sf_dir, "segments")
    found = [postrules.evaluate_one(seg, rule) for rule in SINGLE]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("finding_id", "skill_id", "path", "rule_id", "severity", "line")


SINGLE = ("D-12B", "D-2A", "D-19A")
#: Details that the planted texts' findings must have, by slot; the path comes from the document.
DETAILS = ((0, "D-11A", "high"), (1, "D-11B", "medium"), (3, "D-12A", "high"), (15, "D-7B", "high"), (15, "D-7B", "low"), (20, "D-10C", "high"), (5, "D-11A", "high"))


def _expected_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda *names: F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    slots = F.broadcast(spark.createDataFrame([(*d, n) for n, d in enumerate(DETAILS)], "slot int, rule_id string, severity string, n int"))
    docs = tables.planted(spark, sf_dir).withColumn("slot", F.pmod(F.regexp_extract("path", r"(-?[0-9]+)\.md$", 1).cast("long"), F.lit(2 * len(tables.PAYLOADS))))
    expected = docs.join(slots, "slot").select(F.concat_ws(" ", "path", "n").alias("expected_id"), pair("path", "rule_id", "severity").alias("details"))
    found = kept(spark, sf_dir, "findings").select("finding_id", pair("path", "rule_id", "severity", "category", "context", "line").alias("details"))
    return expectations.matched(expected, found)


QUERIES |= {"rule_single": _one_rule, "expected_details": _expected_details}
_details = ", ".join(f"({n}, {s}, '{r}', '{v}')" for n, (s, r, v) in enumerate(DETAILS))
ORACLE_SQL |= {
    "rule_single": twins.scan() + f"select finding_id, skill_id, path, rule_id, severity, line from everything where rule_id in ({', '.join(map(repr, SINGLE))})",
    "expected_details": twins.scan() + f"""select d.source || '/' || d.doc_id || '.md ' || x.n as expected_id, count(e.finding_id) as n, min(e.finding_id) as first_id
from (values {_details}) x(n, slot, rule_id, severity) join documents d on d.doc_id % {2 * len(tables.PAYLOADS)} = x.slot left join everything e on e.path = d.source || '/' || d.doc_id || '.md' and e.rule_id = x.rule_id and e.severity = x.severity group by 1""",
}


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.findings(tables.planted_bundles(spark, sf_dir)).select("skill_id", "path", "rule_id", "severity", F.col("line").cast("int").alias("line"))


#: What the planted bundles must give, by hand: (slot, path, rule, severity, line); a manifest's path is within its bundle.
_EXPECTED = (
    (1, "SKILL.md", "D-13D", "high", 3), (1, "SKILL.md", "D-13A", "low", 5), (2, "SKILL.md", "D-13B", "medium", 2), (2, "SKILL.md", "D-13E", "high", 3), (2, "SKILL.md", "D-13B", "medium", 4), (3, "SKILL.md", "D-13D", "high", 4),
    (4, "SKILL.md", "D-13D", "high", 4), (4, "SKILL.md", "D-13D", "high", 7), (4, "SKILL.md", "D-13D", "high", 7), (5, "sub/SKILL.md", "D-14A", "medium", 1), (5, "sub", "D-14B", "low", 1), (5, ".hidden", "D-14G", "medium", 1), (5, ".secret", "D-14G", "low", 1),
    (5, "node_modules", "D-14B", "medium", 1), (5, "extra", "D-14B", "low", 1), (5, "notes.xyz", "D-14C", "low", 1), (5, "run.sh", "D-14C", "low", 1), (5, "run.sh", "D-14D", "medium", 1), (5, "tool.zip", "D-14C", "low", 1), (5, "tool.zip", "D-14F", "medium", 1),
    (5, "lib.so", "D-14C", "low", 1), (5, "lib.so", "D-14E", "high", 1), (6, "SKILL.md", "D-13C", "low", 3), (7, "SKILL.md", "D-18C", "medium", 1),
)
QUERIES["bundle_structure"] = _structure
ORACLE_SQL["bundle_structure"] = f"""select 'b' || doc_id as skill_id, case when path = 'SKILL.md' then 'b' || doc_id || '/' || path else path end as path, rule_id, severity, line
from documents join (values {', '.join(map(repr, _EXPECTED))}) x(slot, path, rule_id, severity, line) on doc_id % {2 * len(tables.BUNDLES)} = slot"""
