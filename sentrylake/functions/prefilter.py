"""Words that a text must hold for a pattern to match, so that few patterns are tried on a text."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import signs

#: A literal shorter than this tells too little; a choice of more literals than that costs too much.
LEAST_CHARS, MOST_WORDS = 3, 24


class _Unknown(Exception):
    """Syntax of which this parser doesn't know what a match must hold."""


class _Parser:
    """Reads a pattern as Java's engine does, as far as literals are concerned: sets of literals, in lower case, of each of which every match holds one at least. What it doesn't know it refuses."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.p[self.at : self.at + n]
        if len(out) < n:
            raise _Unknown
        self.at += n
        return out

    def whole(self) -> list[frozenset[str]]:
        out = self.branches()
        if self.at < len(self.p):
            raise _Unknown
        return out

    def branches(self) -> list[frozenset[str]]:
        every = [self.sequence()]
        while self.peek() == "|":
            self.take()
            every.append(self.sequence())
        if len(every) == 1:
            return every[0]
        best = [_best(x) for x in every]
        return [frozenset().union(*best)] if all(best) else []

    def sequence(self) -> list[frozenset[str]]:
        out: list[frozenset[str]] = []
        run = ""
        while self.at < len(self.p) and self.peek() not in "|)":
            literal, choices = self.atom()
            least = self.quantifier()
            if least is None and literal is not None:
                run += literal
                continue
            # a literal that is there at least once ends the run before it that it belongs to
            run += literal if literal is not None and least else ""
            if run:
                out.append(frozenset([run]))
                run = ""
            if literal is None and choices and (least is None or least > 0):
                out += choices
        return [*out, frozenset([run])] if run else out

    def quantifier(self) -> int | None:
        """Least number of times, None without a quantifier."""
        c = self.peek()
        if c in ("*", "?", "+"):
            self.take()
            least = int(c == "+")
        elif c == "{":
            end = self.p.find("}", self.at)
            inner = self.p[self.at + 1 : end]
            if end < 0 or not re.fullmatch(r"[0-9]+(,[0-9]*)?", inner):
                raise _Unknown
            self.at, least = end + 1, int(inner.split(",")[0])
        else:
            return None
        if self.peek() in ("?", "+"):
            self.take()
        if self.peek() in ("*", "?", "+", "{"):
            raise _Unknown
        return least

    def atom(self) -> tuple[str | None, list[frozenset[str]]]:
        """(literal, choices of a group); a literal is empty for what takes no room."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            self.characters()
            return None, []
        if c == "\\":
            return self.escape(), []
        if c in "^$":
            return "", []
        if c in ".":
            return None, []
        if c in "*+?{":
            raise _Unknown
        return (c.lower() if ord(c) < 128 else None), []

    def escape(self) -> str | None:
        c = self.take()
        if c in "bBAzZG":
            return ""
        if c in "wWdDsShHvVR":
            return None
        if c in "pP":
            if self.peek() == "{":
                end = self.p.find("}", self.at)
                if end < 0:
                    raise _Unknown
                self.at = end + 1
            else:
                self.take()
            return None
        if c == "x":
            if self.peek() == "{":
                end = self.p.find("}", self.at)
                if end < 0:
                    raise _Unknown
                self.at = end + 1
            else:
                self.take(2)
            return None
        if c == "u":
            self.take(4)
            return None
        if c in "tnrfae":
            return None
        if c.isalnum():
            raise _Unknown  # quotes, octal numbers, references to groups, named characters
        return c if ord(c) < 128 else None

    def characters(self) -> None:
        """The rest of a class; one with classes in it, or an intersection, is refused."""
        if self.peek() == "^":
            self.take()
        if self.peek() == "]":
            raise _Unknown
        while (c := self.take()) != "]":
            if c == "[" or c == "&" and self.peek() == "&":
                raise _Unknown
            if c == "\\":
                self.escape()

    def group(self) -> tuple[str | None, list[frozenset[str]]]:
        around = False
        if self.peek() == "?":
            self.take()
            kind = self.take()
            if kind in "=!":
                around = True
            elif kind == "<" and self.peek() in ("=", "!"):
                self.take()
                around = True
            elif kind == "<":
                while self.take() != ">":
                    pass
            elif kind != ":" and kind != ">":
                flags = kind
                while self.peek() not in (":", ")"):
                    flags += self.take()
                if not set(flags) <= set("ismu-"):
                    raise _Unknown
                if self.take() == ")":
                    return "", []
        inner = self.branches()
        if self.take() != ")":
            raise _Unknown
        return ("", []) if around else (None, inner)


def _best(choices: list[frozenset[str]]) -> frozenset[str]:
    """The choice whose shortest literal is longest, of equal ones that of fewest literals; empty if none is good enough."""
    good = [c for c in choices if min(map(len, c)) >= LEAST_CHARS and len(c) <= MOST_WORDS]
    return max(good, key=lambda c: (min(map(len, c)), -len(c), sorted(c)), default=frozenset())


@functools.cache
def needed(pattern: str) -> tuple[str, ...]:
    """Literals of which every text that the pattern matches holds one, in lower case; none if the pattern tells nothing of the kind or has syntax that isn't known here."""
    try:
        return tuple(sorted(_best(_Parser(pattern).whole())))
    except _Unknown:
        return ()


@functools.cache
def signs_of(pattern: str) -> tuple[bytes, ...]:
    """What every text that the pattern matches holds one of, for `signs.held`: words, first bytes of characters, or a run of digits; none if the pattern tells nothing of the kind."""
    if re.fullmatch(r"\(\?i\)\\b\[0-9a-f\]\{(?:3[2-9]|[4-9][0-9])(?:,[0-9]*)?\}\\b", pattern):
        return (signs.HEX,)
    return tuple(w.encode() for w in needed(pattern)) or signs.characters(pattern)


def candidates(content: Column, patterns: list[str]) -> Column:
    """Numbers of the patterns whose signs the text holds, in one pass over the text; patterns without signs are not among them."""
    return signs.held(content, tuple(map(signs_of, patterns)))


def may_match(lowered: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, can match the pattern: exact in what it rules out."""
    words = needed(pattern)
    return functools.reduce(lambda a, b: a | b, [lowered.contains(w) for w in words]) if words else F.lit(True)


def found(content: Column, lowered: Column, pattern: str) -> Column:
    """Whether the text matches the pattern."""
    return may_match(lowered, pattern) & content.rlike(pattern)


def found_any(content: Column, lowered: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """Whether the text matches one of the patterns: each is tried only on texts with its words; those that tell nothing are tried together."""
    with_words = [p for p in patterns if needed(p)]
    rest = [p for p in patterns if not needed(p)]
    tests = [found(content, lowered, flags + p) for p in with_words] + ([content.rlike(flags + "(?:" + "|".join(rest) + ")")] if rest else [])
    return functools.reduce(lambda a, b: a | b, tests)
