"""Patterns that mean the same in Spark's engine, whatever Java it runs on, as in the ANSI one."""

from __future__ import annotations

import functools
import re

_SPACE = r" \t\n\f\r"
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_TOKEN = re.compile(r"\\[xpP]\{[^}]*\}|\\.|\[\^?(?:\\.|[^\\\]])+\]|.", re.S)
_WORD = re.compile(r"[A-Za-z0-9_]")
#: A group of plain words.
_GROUP = r"\((?:\?:)?((?:[^()\\\[\]|.*+?{}^$]+(?:\||(?=\))))+)\)"
_AFTER, _BEFORE = re.compile(_GROUP + r"(?![*?{])"), re.compile(_GROUP + r"\Z")


def _all(group: re.Match | None, at: int) -> bool:
    """Whether all words of the group have a letter, digit or underscore at that place."""
    return bool(group) and all(w and _WORD.fullmatch(w[at]) for w in group[1].split("|"))


@functools.cache
def portable(pattern: str) -> str:
    r"""The pattern with letters, blanks and line ends of ASCII only, as RE2 reads it. Java 17 takes `\b` between letters of any script and Java 19 between those of ASCII alone; `\s` holds a vertical tab, `.` and line anchors stop at other line ends, and `$` stands before a last one too."""
    tokens, out = _TOKEN.findall(pattern), []
    lines = bool(re.match(r"\(\?[a-z]*m", pattern))
    for k, t in enumerate(tokens):
        before, after, then = tokens[k - 1] if k else "", "".join(tokens[k + 1 : k + 2]), "".join(tokens[k + 2 : k + 3])
        if t == r"\b":
            # beside a letter that must be there one side tells all
            if (_WORD.fullmatch(after) and then not in ("*", "?", "{")) or _all(_AFTER.match("".join(tokens[k + 1 :])), 0):
                t = r"(?<!\w)"
            elif _WORD.fullmatch(before) or _all(_BEFORE.search("".join(tokens[:k])), -1):
                t = r"(?!\w)"
            else:
                t = _EDGE
        elif t in (r"\s", r"\S"):
            t = f"[{'^' if t == r'\S' else ''}{_SPACE}]"
        elif t[0] == "[" and len(t) > 1:
            t = t.replace(r"\s", _SPACE)
        elif t == "$" and not lines:
            t = r"\z"
        out.append(t)
    return ("(?d)" if "." in tokens or lines else "") + "".join(out)
