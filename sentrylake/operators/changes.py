"""Every change that normalisation makes, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.portable import portable
from ..lineage import cut
from .positions import located

_CHANGE = ("change", "step", "match_no", "offset", "line_no", "column_no", "code_point", "snippet", "replacement")


def _code_point(char: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def changes(artifacts: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, change, step, match_no, offset, line_no, column_no, code_point, snippet, replacement): a row for each character that is removed or folded and each keyword that is put together.

    Steps follow one another; a position is that in the text as the step finds it, for keywords as the ones before have left it. code_point is null for keywords. The few texts that can change are kept
    in the shared folder once, and those with a split run once more when they are folded; all others cost one look. Null texts have no changes; `key` names a text.
    """
    c = F.col(content)
    may = c.rlike("[" + "".join(what[1:-1] for _, what in text.REMOVALS) + "]") | text.is_mixed_script(c) | c.rlike(text.SPLIT)
    now = cut(artifacts.where(may).select(F.col(key).alias("__key"), c.alias("__text")))
    out: list[DataFrame] = []

    def add(found: DataFrame, change: str, step: int, point: Column, by: Column) -> None:
        named = found.withColumns({"change": F.lit(change), "step": F.lit(step), "code_point": point, "snippet": F.col("match"), "replacement": by})
        out.append(named.select(F.col("__key").alias(key), *_CHANGE))

    for step, (change, what) in enumerate(text.REMOVALS):
        hit = now.where(F.col("__text").rlike(what))
        add(located(hit, "__text", F.lit(what), ["__key"]), change, step, _code_point(F.col("match")), F.lit(""))
        now = now.withColumn("__text", F.regexp_replace("__text", what, ""))
    now = cut(now)
    words = located(now.where(text.is_mixed_script(F.col("__text"))), "__text", F.lit(portable(r"\S+")), ["__key"]).where(text.is_mixed_script(F.col("match")))
    chars = words.select("__key", "offset", "line_no", "column_no", F.col("match_no").alias("word_no"), F.posexplode(F.regexp_extract_all("match", F.lit("(?s)."), F.lit(0))).alias("at", "match"))
    chars = chars.withColumns({"offset": F.col("offset") + F.col("at"), "column_no": F.col("column_no") + F.col("at"), "match_no": F.col("word_no") * 1000 + F.col("at"), "by": F.translate("match", fixed.LOOK_ALIKES, fixed.LOOKS_LIKE)}).where("by <> match")
    add(chars, "homoglyph", len(text.REMOVALS), _code_point(F.col("match")), F.col("by"))
    every = "|".join(text.split_keyword(w) for w in fixed.SPLIT_KEYWORDS)
    now = cut(now.withColumn("__text", text.fold_look_alikes(F.col("__text"))).where(F.col("__text").rlike(every)))
    step = len(text.REMOVALS) + 1
    for word in fixed.SPLIT_KEYWORDS:
        for _ in range(3 if word[0] == word[-1] else 1):
            what = text.split_keyword(word)
            add(located(now.where(F.col("__text").rlike(what)), "__text", F.lit(what), ["__key"], put=word), "keyword", step, F.lit(None).cast("string"), F.lit(word))
            now, step = now.withColumn("__text", F.regexp_replace("__text", what, word)), step + 1
    all_of_them = out[0]
    for more in out[1:]:
        all_of_them = all_of_them.unionByName(more)
    return all_of_them
