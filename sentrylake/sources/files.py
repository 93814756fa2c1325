"""Bundles of files from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import file_type

#: Names that are never scanned, and the file that lists more.
IGNORED, IGNORE_FILE, MANIFEST = ("_meta.json", "_meta.yaml", "expected.yaml"), "scanignore", "SKILL.md"
SIGNATURES = (("7F454C46", "elf"), ("4D5A", "pe"), ("FEEDFACE", "mach_o"), ("FEEDFACF", "mach_o"), ("CFFAEDFE", "mach_o"), ("CEFAEDFE", "mach_o"), ("504B0304", "zip"), ("1F8B", "gzip"))
TEXT_SUFFIXES = r"(?i)\.(?:md|txt|rst|py|sh|js|ts|rb|go|rs|ya?ml|json|toml)$"


def files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under `root`: (path relative to it, byte_size, content binary). Paths are Spark's, whose reader leaves out names that begin with a dot or underscore; tables made otherwise may have them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    return raw.select(F.regexp_replace("path", r"^.*?\Q" + base + r"\E/", "").alias("path"), F.col("length").alias("byte_size"), "content")


def without_ignored(found: DataFrame) -> DataFrame:
    """Drops files with a part of their path that is `.git`, an ignored name, or listed in an ignore file (one name a line)."""
    listed = found.where(F.element_at(F.split("path", "/"), -1) == IGNORE_FILE).select(F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("name"))
    names = listed.select(F.trim("name").alias("name")).where("name <> '' and name not like '#%'").distinct()
    parts = found.withColumn("part", F.explode(F.split("path", "/")))
    bad = parts.where(F.col("part").isin(".git", *IGNORED)).select("path").union(parts.join(names, parts.part == names.name, "left_semi").select("path")).distinct()
    return found.join(bad, "path", "left_anti")


def bundles(found: DataFrame) -> DataFrame:
    """(skill_id, path, relative_path, ...): a root with a manifest is one bundle of all files, whatever is nested; else every directory with a manifest is a bundle of all files below it. Files in none form one bundle named `.`."""
    name = F.element_at(F.split("path", "/"), -1)
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    homes = found.where(name == MANIFEST).select(F.regexp_replace("path", f"/?{MANIFEST}$", "").alias("home")).distinct()
    root = homes.where("home = ''")
    homes = homes if root.isEmpty() else root
    held = found.withColumn("home", F.explode(above)).join(homes, "home")
    rest = found.join(held.select("path").distinct(), "path", "left_anti").withColumn("home", F.lit(None).cast("string"))
    out = held.select(*found.columns, "home").unionByName(rest.select(*found.columns, "home"))
    relative = F.when(F.coalesce("home", F.lit("")) == "", F.col("path")).otherwise(F.expr("substring(path, length(home) + 2)"))
    return out.withColumn("relative_path", relative).withColumn("skill_id", F.when(F.col("home") == "", ".").otherwise(F.coalesce("home", F.lit(".")))).drop("home")


def artifacts(found: DataFrame) -> DataFrame:
    """Bundled files as artifacts: file_type, signature, is_text, is_executable, and content as text (null for binary files)."""
    head = F.hex(F.substring("content", 1, 8))
    signature = F.coalesce(*[F.when(head.startswith(h), kind) for h, kind in SIGNATURES])
    text = F.col("content").cast("string")
    out = found.withColumn("signature", signature).withColumn("is_text", F.is_valid_utf8(text) & (F.col("signature").isNull() | F.col("path").rlike(TEXT_SUFFIXES)))
    shebang = F.coalesce(text.startswith("#!"), F.lit(False))
    out = out.withColumn("is_executable", F.col("mode_executable") | shebang if "mode_executable" in found.columns else shebang)
    return out.withColumn("file_type", file_type(F.col("path"))).withColumn("content", F.when(F.col("is_text"), text))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of bundles as JSON lines (id, path, verdict, attack_categories, severity, expected_rules, tier, source_type, tags); a malformed line is an error."""
    schema = "id string, path string, verdict string, attack_categories array<string>, severity string, expected_rules array<string>, tier string, source_type string, tags array<string>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def filtered(entries: DataFrame, tier: str = "standard", tags: tuple[str, ...] = (), source_types: tuple[str, ...] | None = None) -> DataFrame:
    """Entries of a tier, which holds the smaller ones, with all the tags, of the source types given."""
    tiers = ("smoke", "standard", "full")
    out = entries.where(F.col("tier").isin(*tiers[: tiers.index(tier) + 1] if tier in tiers else tiers))
    out = out if source_types is None else out.where(F.col("source_type").isin(*source_types))
    return out.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def labelled_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples as JSON lines (id, skill_name, label, content), as files of bundles of their own; samples without content are left out."""
    raw = spark.read.schema("id string, skill_name string, label string, content string").option("mode", "FAILFAST").json(path).where("content is not null")
    return raw.select(F.col("id").alias("skill_id"), F.concat("id", F.lit(f"/{MANIFEST}")).alias("path"), F.lit("markdown").alias("file_type"), "content", "skill_name", F.upper("label").alias("verdict"))
