"""Which words texts hold, by one pass over their bytes: no pattern is tried on a text without them."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are looked at together; a longer text is looked at by itself.
_CHUNK = 1 << 20
#: In place of a word: sixteen hexadecimal digits in a row, which any thirty-one in a row hold at a multiple of sixteen.
HEX = b"\0hex"
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
#: What a separator or more becomes in `squeezed`.
_ONE = 1
_SEPARATORS = np.isin(np.arange(256), list(b".-_ \t\r\n"))


class _Words:
    """Words by their first three bytes, shorter ones apart; each with the numbers of what needs it."""

    def __init__(self, needs: tuple[tuple[bytes, ...], ...]):
        self.of: dict[bytes, list[int]] = {}
        for k, words in enumerate(needs):
            for w in words:
                self.of.setdefault(w, []).append(k)
        self.by: dict[int, list[bytes]] = {}
        self.first = np.zeros(1 << 24, bool)
        for w in self.of:
            if len(w) > 2 and w != HEX:
                self.by.setdefault(int.from_bytes(w[:3], "big"), []).append(w)
        self.first[list(self.by)] = True

    def places(self, raw: np.ndarray):
        """(word, where it begins) for each word that is there."""
        for w in self.of:
            if w == HEX:
                blocks = _HEX[raw[: len(raw) // 16 * 16]].reshape(-1, 16).all(axis=1)
                yield w, np.flatnonzero(blocks) * 16
            elif len(w) < 3:
                yield w, functools.reduce(lambda at, j: at[raw[at + j] == w[j]], range(1, len(w)), np.flatnonzero(raw[: len(raw) - len(w) + 1] == w[0]))
        if len(raw) < 3 or not self.by:
            return
        code = raw[:-2].astype(np.uint32) << 16
        code |= raw[1:-1].astype(np.uint32) << 8
        code |= raw[2:]
        at = np.flatnonzero(self.first[code])
        code = code[at]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        ends = np.flatnonzero(np.diff(code)) + 1
        for one in np.split(at, ends) if len(at) else ():
            for w in self.by[int.from_bytes(raw[one[0] : one[0] + 3].tobytes(), "big")]:
                p = one[one + len(w) <= len(raw)]
                for j in range(3, len(w)):
                    if not len(p):
                        break
                    p = p[raw[p + j] == w[j]]
                yield w, p


@functools.lru_cache(maxsize=16)
def _words(needs: tuple[tuple[bytes, ...], ...]) -> _Words:
    return _Words(needs)


def _squeezed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of separators as one byte, and where the texts begin then."""
    sep = _SEPARATORS[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    return np.where(sep, np.uint8(_ONE), raw)[keep], np.concatenate(([0], np.cumsum(keep)))[starts]


def numbers(texts: pa.Array, needs: tuple[tuple[bytes, ...], ...], squeezed: bool = False) -> pa.Array:
    """For each text the numbers, in order, of the `needs` of which it holds a word; a null text holds none."""
    words, m = _words(needs), max(1, len(needs))
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    keys, row = [], 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
        end = min(end, len(texts))
        raw, starts = _LOWER[data[off[row] : off[end]]], off[row : end + 1] - off[row]
        if squeezed:
            raw, starts = _squeezed(raw, starts)
        for w, at in words.places(raw):
            if len(at):
                in_row = np.searchsorted(starts, at, "right") - 1
                # a run of digits may reach over an end: one too many is tried, none is lost
                whole = np.unique(in_row if w == HEX else in_row[at + len(w) <= starts[in_row + 1]])
                keys += [(whole + row) * m + k for k in words.of[w]]
        row = end
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    counts = np.bincount(found // m, minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(found % m, pa.int32()))


def held(content: Column, needs: tuple[tuple[bytes, ...], ...], squeezed: bool = False, once: bool = False) -> Column:
    """array<int>: the numbers of the `needs` of which a text holds a word, A-Z read as a-z. squeezed: each run of separators counts as one byte 1. once: no plan moves later conditions ahead of it, or repeats it for them."""
    from pyspark.sql import SparkSession

    from ..shipping import ship

    if session := SparkSession.getActiveSession():
        ship(session)

    def found(texts: pa.Array) -> pa.Array:
        return numbers(texts, needs, squeezed)

    made = F.arrow_udf(found, "array<int>")
    return (made.asNondeterministic() if once else made)(content)


#: Bytes of a Base64 run, and the shape of one that can be decoded.
_CODE = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="))
_CODED = re.compile(rb"[A-Za-z0-9+/]{16,}={0,2}")


def _is_coded(run: bytes) -> bool:
    if not _CODED.fullmatch(run):
        return False
    try:
        return bool(base64.b64decode(run).decode())
    except ValueError:
        return False


def coded(texts: pa.Array, most: int) -> pa.Array:
    """Whether a text holds a run of Base64 of at most `most` characters, as long as it goes, that decodes to a text."""
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, row = np.zeros(len(texts), bool), 0
    while row < len(texts):
        end = min(max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1), len(texts))
        raw, starts = data[off[row] : off[end]], off[row : end + 1] - off[row]
        within = np.zeros(len(raw) + 2, bool)
        within[1:-1] = _CODE[raw]
        at, stop = np.flatnonzero(within[1:] & ~within[:-1]), np.flatnonzero(within[:-1] & ~within[1:])
        # a run that goes over the end of a text is cut there
        cuts = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(raw))]
        cuts = np.unique(cuts[within[cuts] & within[cuts + 1]])
        at, stop = np.sort(np.concatenate((at, cuts))), np.sort(np.concatenate((stop, cuts)))
        size = stop - at
        good = (size >= 16) & (size <= most) & (size % 4 == 0)
        for a, b in zip(at[good], stop[good], strict=True):
            if _is_coded(raw[a:b].tobytes()):
                out[row + np.searchsorted(starts, a, "right") - 1] = True
        row = end
    return pa.array(out)


def has_code(content: Column, most: int) -> Column:
    """boolean: whether `coded` holds; false for a null text."""

    def found(texts: pa.Array) -> pa.Array:
        return coded(texts, most)

    return F.arrow_udf(found, "boolean")(content)


def characters(pattern: str) -> tuple[bytes, ...]:
    """First three bytes of the characters of a class that is written in \\x{...} and ranges of them, all beyond U+07FF; none for other patterns."""
    one = r"\\x\{([0-9A-Fa-f]+)\}"
    if not re.fullmatch(rf"\[(?:{one}(?:-{one})?)+\]", pattern):
        return ()
    points = [n for a, b in re.findall(rf"{one}(?:-{one})?", pattern) for n in range(int(a, 16), int(b or a, 16) + 1)]
    return tuple(sorted({chr(n).encode()[:3] for n in points})) if min(points) > 0x7FF else ()
