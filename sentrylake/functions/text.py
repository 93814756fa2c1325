"""Column functions on text: normalisation, its log, and positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, signs
from .portable import portable

_SEPARATORS = r"[.\-_ \t\r\n\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]+"
#: Removals in the order in which they are made.
REMOVALS = (("unicode_tag", fixed.TAG_CHARS), ("zero_width", fixed.ZERO_WIDTH), ("variation_selector", fixed.VARIATION_SELECTORS), ("bidi_override", fixed.BIDI_OVERRIDES))
#: Scripts of letters, as classes.
SCRIPTS = ("[A-Za-z]", r"[\x{0400}-\x{04FF}]", r"[\x{0370}-\x{03FF}]", r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]")
#: What a word of two scripts must hold; texts without it, nearly all, are tried no further.
_NOT_LATIN = "[" + "".join(s[1:-1] for s in SCRIPTS[1:]) + "]"
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def split_keyword(word: str) -> str:
    """Pattern of a keyword with separators between all its characters."""
    return "(?i)" + _SEPARATORS.join(re.escape(c) for c in word)


def is_mixed_script(token: Column) -> Column:
    """At least two scripts, one of them Latin or full-width."""
    latin, cyrillic, greek, wide = (token.rlike(s) for s in SCRIPTS)
    return token.rlike(_NOT_LATIN) & ((latin & (cyrillic | greek | wide)) | (wide & (cyrillic | greek)))


def fold_look_alikes(text: Column) -> Column:
    """Letters that look like ASCII ones become those, in words that mix scripts."""
    words = F.regexp_extract_all(text, F.lit(portable(r"\s+|\S+")), F.lit(0))
    folded = F.transform(words, lambda t: F.when(is_mixed_script(t), F.translate(t, fixed.LOOK_ALIKES, fixed.LOOKS_LIKE)).otherwise(t))
    # texts in one script, nearly all, are left as they are
    return F.when(is_mixed_script(text), F.array_join(folded, "")).otherwise(text)


def remove_invisible(text: Column) -> Column:
    out = text
    for _, what in REMOVALS:
        out = F.regexp_replace(out, what, "")
    return F.when(text.rlike("[" + "".join(what[1:-1] for _, what in REMOVALS) + "]"), out).otherwise(text)


#: Four characters of a keyword in a row with separators between them, which every split keyword begins with.
SPLIT = r"[A-Za-z0-9_.]" + (_SEPARATORS + r"[A-Za-z0-9_.]") * 3


def collapse_keywords(text: Column) -> Column:
    """Keywords that are split by separators between all their characters are put together."""
    out = text
    for word in fixed.SPLIT_KEYWORDS:
        # a word that begins with its last letter can share it with its next copy
        for _ in range(3 if word[0] == word[-1] else 1):
            out = F.regexp_replace(out, split_keyword(word), word)
    return F.when(text.rlike(SPLIT), out).otherwise(text)


def normalized(text: Column) -> Column:
    """The normalised text as one expression; `with_normalized` computes each step once."""
    return collapse_keywords(fold_look_alikes(remove_invisible(text)))


def with_normalized(df: DataFrame, content: str, name: str, folded: str | None = None) -> DataFrame:
    """`df` with the normalised text as `name`, each step computed once; and the text before keywords are put together as `folded`, if named."""
    df = df.withColumn("__clean", remove_invisible(F.col(content)))
    df = df.withColumn("__folded", fold_look_alikes(F.col("__clean"))).drop("__clean")
    df = df.withColumn(name, collapse_keywords(F.col("__folded")))
    return df.withColumnRenamed("__folded", folded) if folded else df.drop("__folded")


#: Signs of what normalisation changes: invisible characters, and first bytes of letters of other scripts (`signs.held`).
INVISIBLE = tuple(w for _, p in REMOVALS for w in signs.characters(p))
OTHER_SCRIPTS = tuple(bytes([n]) for n in (*range(0xCD, 0xD4), 0xEF))
#: Split keywords as `signs.held` reads them squeezed, up to a character that is a separator itself.
SQUEEZED = tuple("".join(f"{c}\x01" for c in re.split(r"[._-]", w.lower())[0]).encode()[: None if re.search(r"[._-]", w) else -1] for w in fixed.SPLIT_KEYWORDS)


def may_change(content: Column) -> Column:
    """Whether normalisation can change a text: exact in what it rules out."""
    return (F.size(signs.held(content, (INVISIBLE, OTHER_SCRIPTS))) > 0) | (F.size(signs.held(content, (SQUEEZED,), squeezed=True)) > 0)


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def word_of(words: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def heading_of(headings: tuple[str, ...]) -> str:
    """A line that is one of the headings, followed by another line."""
    return r"(?i)(?:^|\n)[ \t]*#*[ \t]*(?:" + "|".join(map(re.escape, headings)) + r"):*[ \t]*\r?\n[^\n]*"


MANIFEST = r"(?:^|/)SKILL\.md$"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---(?:\n|\z)"
_DESCRIPTION = r"(?:^|\n)description:[ \t]*"


def description(content: Column) -> tuple[Column, Column]:
    """The description in a manifest's frontmatter, with its indented lines and without quotes or block signs, and the line on which it begins; nulls without one."""
    block = F.regexp_extract(content, FRONTMATTER, 1)
    value = F.regexp_extract(block, _DESCRIPTION + r"([^\n]*(?:\n[ \t]+[^\n]*)*)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[|>][+-]?\s*", ""), "^[\"']|[\"']$", "")
    above = F.split(block, _DESCRIPTION, 2)[0]
    there = block.rlike(_DESCRIPTION)
    return F.when(there & (plain != ""), plain), F.when(there, 2 + newlines(above) + (above != "").cast("int"))
