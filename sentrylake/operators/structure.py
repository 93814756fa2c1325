"""Rules on a bundle's layout and on the frontmatter of its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .rules import OTHER_RULES, RULES

FRONTMATTER = text.FRONTMATTER
_SUFFIX = lambda names: "(?i)(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")$"


def layout(files: DataFrame) -> DataFrame:
    """(skill_id, path, rule_id, severity) of D-14A to D-14G for artifacts (skill_id, relative_path, content, signature, is_executable)."""
    parts = F.split("relative_path", "/")
    f = files.withColumn("top", parts[0]).withColumn("deep", F.size(parts) > 1).withColumn("name", F.element_at(parts, -1))
    hidden = F.col("top").startswith(".") & ~F.col("top").isin(*fixed.TOP_FILES)
    odd_file = ~F.col("name").isin(*fixed.TOP_FILES) & ~F.col("name").rlike(r"(?i)\.(?:md|txt|rst)$") & ~F.col("name").rlike("^(?:" + "|".join(fixed.TOP_PREFIXES) + ")")
    risky = F.col("top").isin(*fixed.RISKY_DIRECTORIES)
    rules = F.array(
        F.when(F.col("deep") & (F.col("name") == "SKILL.md"), F.struct(F.lit("D-14A").alias("rule_id"), F.lit("medium").alias("severity"), F.col("relative_path").alias("path"))),
        F.when(F.col("deep") & ~hidden & ~F.col("top").isin(*fixed.TOP_DIRECTORIES), F.struct(F.lit("D-14B").alias("rule_id"), F.when(risky, "medium").otherwise("low").alias("severity"), F.col("top").alias("path"))),
        F.when(~F.col("deep") & ~hidden & odd_file, F.struct(F.lit("D-14C").alias("rule_id"), F.lit("low").alias("severity"), F.col("relative_path").alias("path"))),
        F.when(hidden, F.struct(F.lit("D-14G").alias("rule_id"), F.when(F.col("deep"), "medium").otherwise("low").alias("severity"), F.col("top").alias("path"))),
    )
    first = f.select("skill_id", F.explode(F.array_compact(rules)).alias("x")).select("skill_id", "x.path", "x.rule_id", "x.severity").distinct()
    # an executable whose name a Markdown file of the bundle mentions is documented; texts are taken apart into names, so that no text meets every executable
    exe = f.where(F.col("is_executable") & (F.col("top") != "scripts")).select("skill_id", "relative_path", "name")
    docs = f.where(F.col("name").rlike(r"(?i)\.md$") & F.col("content").isNotNull())
    plain = r"^[A-Za-z0-9._-]+$"
    said = docs.select("skill_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9._-]+"), F.lit(0)))).alias("name"))
    said = said.select("skill_id", F.explode(F.array("name", F.regexp_replace("name", r"\.+$", ""))).alias("name")).distinct()
    odd = exe.where(~F.col("name").rlike(plain)).join(docs.select("skill_id", F.col("content").alias("doc")), "skill_id").where(F.col("doc").contains(F.col("name"))).select("skill_id", "relative_path")
    helped = exe.where(F.col("name").rlike(plain)).join(said, ["skill_id", "name"]).select("skill_id", "relative_path").unionByName(odd).distinct()
    left = f.join(helped, ["skill_id", "relative_path"], "left_anti")
    archive = F.col("name").rlike(_SUFFIX(fixed.ARCHIVE_SUFFIXES)) | F.col("signature").isin("zip", "gzip")
    binary = F.col("name").rlike(_SUFFIX(fixed.BINARY_SUFFIXES)) | F.col("signature").isin("elf", "pe", "mach_o")
    excused = (F.col("top") == "assets") & ~F.col("is_executable") & ~F.col("name").startswith(".")
    one = lambda cond, rule_id, severity: left.where(F.coalesce(cond, F.lit(False))).select("skill_id", F.col("relative_path").alias("path"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"))
    return first.unionByName(one(F.col("is_executable") & (F.col("top") != "scripts"), "D-14D", "medium")).unionByName(one(binary, "D-14E", "high")).unionByName(one(archive & ~excused, "D-14F", "medium"))


def frontmatter_lines(files: DataFrame) -> DataFrame:
    """(skill_id, path, no, line_text): the lines of each manifest's frontmatter, from 0."""
    block = F.regexp_extract("content", FRONTMATTER, 1)
    return files.where(F.col("path").rlike(r"(?:^|/)SKILL\.md$")).withColumn("block", block).where("block <> ''").select("skill_id", "path", F.posexplode(F.split("block", "\n")).alias("no", "line_text"))


def frontmatter(files: DataFrame) -> DataFrame:
    """(skill_id, path, key, value, line, times, nth): top-level fields of each manifest's frontmatter, as written; times: how often the key occurs, nth: the how manieth of them this is."""
    lines = frontmatter_lines(files)
    pairs = lines.where(F.col("line_text").rlike(r"^[A-Za-z_][A-Za-z0-9_-]*\s*:"))
    pairs = pairs.select("skill_id", "path", F.regexp_extract("line_text", r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:", 1).alias("key"), F.trim(F.regexp_extract("line_text", r"^[^:]*:(.*)$", 1)).alias("value"), (F.col("no") + 2).alias("line"))
    times = pairs.groupBy("skill_id", "path", "key").agg(F.count("*").alias("times"))
    return pairs.join(times, ["skill_id", "path", "key"]).withColumn("nth", F.row_number().over(Window.partitionBy("skill_id", "path", "key").orderBy("line")))


def frontmatter_marks(files: DataFrame) -> DataFrame:
    """(skill_id, path, line, mark): merge keys, document markers, and anchors, aliases and tags of nested values in each manifest's frontmatter. A sign within quotes, in a comment or in a block of text is none."""
    text_of = F.col("line_text")
    value = r"^\s+(?:-\s+)*(?:[^\s#\"'][^:#\"']*:\s+)?"
    marks = F.array(
        F.when(text_of.rlike(r"^\s*<<\s*:"), F.lit("merge_key")), F.when(text_of.rlike(r"^\s*(?:---|\.\.\.)\s*$"), F.lit("document_marker")), F.when(text_of.rlike(value + r"&[A-Za-z0-9_-]"), F.lit("anchor")), F.when(text_of.rlike(value + r"\*[A-Za-z0-9_-]"), F.lit("alias")), F.when(text_of.rlike(value + r"![A-Za-z!]"), F.lit("tag")),
    )
    lines = frontmatter_lines(files)
    # a block of text: what is indented deeper than the key that ends in | or >
    depth = F.length(F.regexp_extract("line_text", r"^( *)", 1))
    before = Window.partitionBy("skill_id", "path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    shallow = lines.withColumn("depth", F.when(F.trim("line_text") == "", F.lit(None)).otherwise(depth)).withColumn("opens", text_of.rlike(r":\s+[|>][+-]?[0-9]?\s*$"))
    last = shallow.withColumn("opened", F.last(F.when(F.col("opens"), F.struct("no", "depth")), ignorenulls=True).over(before))
    closed = F.max(F.when(~F.col("opens") & F.col("depth").isNotNull() & (F.col("depth") <= F.col("opened.depth")), F.col("no"))).over(before)
    inside = F.col("opened").isNotNull() & (F.col("depth") > F.col("opened.depth")) & (F.coalesce(F.col("closed"), F.lit(-1)) < F.col("opened.no"))
    found = last.withColumn("closed", closed).where(~F.coalesce(inside, F.lit(False)))
    return found.select("skill_id", "path", (F.col("no") + 2).alias("line"), F.explode(F.array_compact(marks)).alias("mark"))


def bundle_names(files: DataFrame) -> DataFrame:
    """(skill_id, skill_name): the manifest's name, unless it is given twice, else the id."""
    own = files.where("relative_path = 'SKILL.md'") if "relative_path" in files.columns else files
    named = frontmatter(own).where("key = 'name' and times = 1").groupBy("skill_id").agg(F.min(F.regexp_replace("value", "^[\"']|[\"']$", "")).alias("name"))
    return files.select("skill_id").distinct().join(named, "skill_id", "left").select("skill_id", F.coalesce("name", "skill_id").alias("skill_name"))


def frontmatter_findings(files: DataFrame, long_description: int = 500) -> DataFrame:
    """(skill_id, path, rule_id, severity, line, detail) of D-13A to D-13E."""
    f = frontmatter(files)
    plain = F.regexp_replace("value", "^[\"']|[\"']$", "")
    boolean, number = F.col("value").rlike("(?i)^(?:true|false|yes|no|on|off)$"), F.col("value").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    other = F.col("value").rlike(r"^[\[{]")
    wrong = (F.col("key").isin(*fixed.FRONTMATTER_STRINGS) & (boolean | number | other)) | (F.col("key").isin(*fixed.FRONTMATTER_BOOLEANS) & ~boolean)
    tricks = F.col("value").rlike(r"^(?:[&*!][A-Za-z]|%)") | (F.col("nth") > 1)
    family = lambda c: text.any_of(tuple(p for r in RULES if r.category == c for p in r.patterns))
    found = F.array(
        F.when(~F.col("key").isin(*fixed.FRONTMATTER_FIELDS), F.struct(F.lit("D-13A").alias("rule_id"), F.lit("low").alias("severity"))),
        F.when(wrong & (F.col("value") != ""), F.struct(F.lit("D-13B").alias("rule_id"), F.lit("medium").alias("severity"))),
        F.when((F.col("key") == "description") & (F.length(plain) > long_description), F.struct(F.lit("D-13C").alias("rule_id"), F.lit("low").alias("severity"))),
        F.when(tricks, F.struct(F.lit("D-13D").alias("rule_id"), F.lit("high").alias("severity"))),
        F.when((F.col("key") == "description") & plain.rlike(family("prompt_injection")), F.struct(F.lit("D-13E").alias("rule_id"), F.lit("high").alias("severity"))).when((F.col("key") == "description") & plain.rlike(family("suppression")), F.struct(F.lit("D-13E").alias("rule_id"), F.lit("medium").alias("severity"))),
    )
    keys = f.select("skill_id", "path", "line", F.col("key").alias("detail"), F.explode(F.array_compact(found)).alias("x")).select("skill_id", "path", "x.rule_id", "x.severity", "line", "detail")
    marks = frontmatter_marks(files).select("skill_id", "path", F.lit("D-13D").alias("rule_id"), F.lit("high").alias("severity"), "line", F.col("mark").alias("detail"))
    return keys.unionByName(marks)


def broad_description(files: DataFrame) -> DataFrame:
    """(skill_id, path, rule_id): D-18C, descriptions that claim any task, in many or generic words, unless the model may not invoke the bundle."""
    f = frontmatter(files)
    words = F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: w != "")
    generic = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in fixed.GENERIC_TERMS])))
    phrase = F.col("value").rlike(r"(?i)\b(?:any|almost any|all)\s+(?:request|requests|task|tasks|problem|problems)\b|\bacross the workspace\b|\bfor any task\b")
    off = f.where("key = 'disable-model-invocation' and lower(value) = 'true'").select("path")
    hit = f.where("key = 'description'").where(((F.size(words) >= 18) | (generic >= 5)) & (phrase | (generic >= 8)))
    return hit.join(off, "path", "left_anti").select("skill_id", "path", F.lit("D-18C").alias("rule_id"))


def findings(files: DataFrame) -> DataFrame:
    """Findings of the layout, frontmatter and description rules for artifacts (skill_id, path, relative_path, content, signature, is_executable), with the columns of other findings."""
    rows = layout(files).withColumn("line", F.lit(1)).withColumn("detail", F.lit(""))
    rows = rows.unionByName(frontmatter_findings(files)).unionByName(broad_description(files).withColumns({"severity": F.lit("medium"), "line": F.lit(1), "detail": F.lit("")}))
    category = F.create_map(*[F.lit(x) for r in OTHER_RULES for x in (r[0], r[2])])[F.col("rule_id")]
    return rows.withColumns({
        "category": category, "flags": F.lit(","), "soft": F.col("rule_id").isin(*fixed.SOFT_RULES), "segment_type": F.lit("original"), "context": F.lit("documentation"), "source_kind": F.lit("markdown"),
        "reference_example": F.lit(False), "bootstrap": F.lit(False), "finding_id": F.md5(F.concat_ws("::", "skill_id", "path", "rule_id", F.col("line").cast("string"), "detail").cast("binary")),
    }).drop("detail")
