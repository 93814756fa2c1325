"""Findings that follow from others: normalisation changes, hidden parts with findings, behaviour chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, signs, text
from ..functions.portable import portable
from ..lineage import cut
from . import chains, rules, structure, supply
from .rules import OTHER_RULES

#: Chains as rows: (chain, rule, category, flag, flag, ...). More rows make more chains.
CHAINS = fixed.CHAINS


def _finding(df: DataFrame, rule_id: str, line: Column, match: Column, no: Column | None = None) -> DataFrame:
    """Rows of `df` as findings of one rule."""
    _, severity, category, _ = next(r for r in OTHER_RULES if r[0] == rule_id)
    no = F.lit(0) if no is None else no
    return df.withColumns({
        "rule_id": F.lit(rule_id), "pattern_no": F.lit(0), "match_no": no.cast("int"), "match": match, "line": line.cast("int"), "column": F.lit(None).cast("int"), "severity": F.lit(severity), "category": F.lit(category), "flags": F.lit(","), "soft": F.lit(rule_id in fixed.SOFT_RULES),
        "finding_id": F.md5(F.concat_ws("::", "segment_id", F.lit(rule_id), no.cast("string"), match).cast("binary")),
    })


def mixed_script_words(segments: DataFrame) -> DataFrame:
    """D-2A: a finding for each word of two scripts, one of them Latin or full-width, without CJK."""
    words = F.filter(F.split("content", portable(r"\s+")), lambda t: text.is_mixed_script(t) & ~t.rlike(text.CJK))
    # texts without other scripts become nulls, on which nothing is tried; a condition of its own would be tested after the patterns
    c = F.col("content")
    foreign = segments.withColumn("content", F.when(F.size(signs.held(c, (text.OTHER_SCRIPTS,))) > 0, c))
    hit = foreign.where(text.is_mixed_script(c)).select("*", F.posexplode(words).alias("i", "w"))
    return _finding(hit, "D-2A", F.col("start_line"), F.col("w"), F.col("i")).drop("content", "i", "w")


def _changeable(segments: DataFrame) -> DataFrame:
    """The files' own segments that normalisation may change, as a rule few, with the normalised text (`normal`) and the split keywords (`logs`), in order, each taken from the text that the ones before have left."""
    c = F.col("content")
    few = segments.where("segment_type = 'original'").withColumns({"__any": signs.held(c, (text.INVISIBLE, text.OTHER_SCRIPTS)), "__held": signs.held(c, tuple((w,) for w in text.SQUEEZED), squeezed=True)})
    may = (F.size("__any") > 0) | (F.size("__held") > 0)
    # other texts are null, on which nothing is tried; a condition alone would be tested after the patterns
    few = few.where(may).withColumn("__clean", text.remove_invisible(F.when(may, c)))
    few = few.withColumn("now", text.fold_look_alikes(F.col("__clean"))).drop("__clean")
    # a keyword that stands split at any step did so in the folded text: what is put together lends others its first or last letter at most
    words = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("word"), F.lit(text.split_keyword(w)).alias("pattern"), F.lit(3 if w[0] == w[-1] else 1).alias("times")) for k, w in enumerate(fixed.SPLIT_KEYWORDS)])

    def put_together(acc: Column, w: Column) -> Column:
        found = F.transform(F.regexp_extract_all(acc["now"], w["pattern"], F.lit(0)), lambda m: F.concat(w["word"], F.lit(" "), m))
        # a word that begins with its last letter can share it with its next copy
        out = F.aggregate(F.sequence(F.lit(1), w["times"]), acc["now"], lambda t, _: F.regexp_replace(t, w["pattern"], w["word"]))
        return F.struct(out.alias("now"), F.concat(acc["logs"], found).alias("logs"))

    first = F.struct(F.col("now").alias("now"), F.array().cast("array<string>").alias("logs"))
    few = few.withColumn("__end", F.aggregate(F.filter(words, lambda w: (F.size("__any") > 0) | F.array_contains("__held", w["k"])), first, put_together))
    return few.select(*segments.columns, F.col("__end.now").alias("normal"), F.col("__end.logs").alias("logs"))


def split_keywords(segments: DataFrame, changeable: DataFrame | None = None) -> DataFrame:
    """D-6A: a finding for each keyword that stood split in a file, keywords in order, each in the text that the ones before have left. changeable: what `_changeable` gives, if it is there already."""
    hit = (_changeable(segments) if changeable is None else changeable).select("*", F.posexplode("logs").alias("i", "w"))
    return _finding(hit, "D-6A", F.col("start_line"), F.col("w"), F.col("i")).drop("content", "normal", "logs", "i", "w")


def normalisation_changes(segments: DataFrame, changeable: DataFrame | None = None) -> DataFrame:
    """NC-3A: one finding for each file that normalisation changes."""
    c = F.col("content")
    if changeable is None:  # texts that normalisation leaves as they are become nulls
        changeable = text.with_normalized(segments.where("segment_type = 'original'").withColumn("content", F.when(text.may_change(c), c)), "content", "normal")
    hit = changeable.where("normal <> content")
    return _finding(hit, "NC-3A", F.col("start_line"), F.lit("")).drop("content", "normal", "logs")


def hidden_content(segments: DataFrame, found: DataFrame) -> DataFrame:
    """D-21A, D-22A and D-5C: comments, code fences and twice-decoded parts that hold a finding, themselves or in a part of theirs. `references` lists what supports them."""
    supports = F.col("category").isin("prompt_injection", "obfuscation", "suppression") | F.col("rule_id").isin("D-10A", "D-17A") | F.col("rule_id").startswith("D-19")
    # each finding reaches its segment and, by the array that came with it, the segments above: no recursion
    reach = found.where("severity <> 'info'").select("finding_id", supports.alias("supports"), F.explode(F.concat("ancestors", F.array("segment_id"))).alias("segment_id"))
    under = reach.groupBy("segment_id").agg(F.array_sort(F.collect_set(F.when(F.col("supports"), F.col("finding_id")))).alias("strong"), F.array_sort(F.collect_set("finding_id")).alias("any"))
    parts = segments.where("segment_type <> 'original'").drop("content").join(under, "segment_id")
    decodes = F.size(F.filter("chain", lambda x: x.isin("base64_decode", "rot13")))
    a = _finding(parts.where("segment_type = 'html_comment' and size(strong) > 0"), "D-21A", F.col("start_line"), F.lit("")).withColumn("references", F.col("strong"))
    b = _finding(parts.where("segment_type = 'code_fence' and size(strong) > 0"), "D-22A", F.col("start_line"), F.lit("")).withColumn("references", F.col("strong"))
    c = _finding(parts.where(F.col("segment_type").isin("base64_decode", "rot13") & (decodes >= 2)), "D-5C", F.col("start_line"), F.lit("")).withColumn("references", F.col("any"))
    return a.unionByName(b).unionByName(c).drop("strong", "any")


_COLUMNS = ("finding_id", "skill_id", "path", "segment_id", "segment_type", "rule_id", "severity", "category", "flags", "soft", "line", "column", "context", "source_kind", "reference_example", "bootstrap")


#: Rules that follow from any other finding below them.
SUBTREE = ("D-21A", "D-22A", "D-5C")
_SUPPLY = r"D-15.|D-20[A-FH]|D-23."


def needs(rule_id: str, policy: tuple = CHAINS) -> set[str] | None:
    """The rules that must be evaluated for one rule's findings, itself included: a chain needs the rules with its flags, a rule on hidden parts needs all (None)."""
    if rule_id in SUBTREE:
        return None
    flags = {f for c in policy if c[1] == rule_id for f in c[3:]}
    return {rule_id} | {r.rule_id for r in rules.RULES if flags & set(r.flags)}


def evaluate_one(segments: DataFrame, rule_id: str, policy: tuple = CHAINS, files: DataFrame | None = None) -> DataFrame:
    """The findings of one rule, as `all_findings` gives them, by evaluating only the rules that it needs. An unknown rule is an error."""
    if rule_id not in {r.rule_id for r in rules.RULES} | {r[0] for r in OTHER_RULES} | {c[1] for c in policy}:
        raise ValueError(f"no rule {rule_id}")
    return all_findings(segments, policy, files, needs(rule_id, policy)).where(F.col("rule_id") == rule_id)


def all_findings(segments: DataFrame, policy: tuple = CHAINS, files: DataFrame | None = None, only: set[str] | None = None) -> DataFrame:
    """Findings of the text rules, of normalisation, of URLs, packages and density, of hidden content and of chains, with references (absorbed parts) and layer; of layout and frontmatter too, if the bundles' `files` are given.

    only: the rules to evaluate, with all that they need (`needs`); None for all."""
    none = F.array().cast("array<string>").alias("references")
    wanted = lambda pattern: only is None or any(re.fullmatch(pattern, r) for r in only)
    # without any rule the empty table of the first one's findings
    first = rules.evaluate(segments, rules.RULES if only is None else tuple(r for r in rules.RULES if r.rule_id in only) or rules.RULES[:1])
    first = first if only is None else first.where(F.col("rule_id").isin(*only))
    # findings hold no texts; they are kept once, and what follows joins them
    few = cut(_changeable(segments)) if wanted("D-6A|NC-3A") else None
    for pattern, make in (("D-2A", mixed_script_words), ("D-6A", lambda x: split_keywords(x, few)), ("NC-3A", lambda x: normalisation_changes(x, few))):
        if wanted(pattern):
            first = first.unionByName(make(segments).drop("content", "self_limiting"), allowMissingColumns=True)
    if wanted(_SUPPLY):
        first = first.unionByName(supply.findings(segments).join(segments.select("segment_id", "parent_id", "ancestors", "chain"), "segment_id"), allowMissingColumns=True)
    if files is not None and wanted(r"D-1[34].|D-18C"):
        first = first.unionByName(structure.findings(files), allowMissingColumns=True)
    first = cut(first)
    found = first.select(*_COLUMNS, none)
    if only is None:
        found = cut(found.unionByName(hidden_content(segments, first).select(*_COLUMNS, "references")))
    linked = chains.linked(found, chains.headings(segments), policy=policy)
    anchor = linked.select(
        F.md5(F.concat_ws("::", "skill_id", "rule_id").cast("binary")).alias("finding_id"), "skill_id", F.concat("skill_id", F.lit("/SKILL.md")).alias("path"), F.lit(None).cast("string").alias("segment_id"), F.lit("original").alias("segment_type"), "rule_id", "severity", "category",
        F.lit(",").alias("flags"), F.lit(False).alias("soft"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("source_kind"), F.lit(False).alias("reference_example"), F.lit(False).alias("bootstrap"), F.col("parts").alias("references"),
    )
    return found.unionByName(anchor).withColumn("layer", F.lit("deterministic"))
