"""Where matches stand in a text: offset, line and column of each, from running sums over the pieces between them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_PLACES = "array<struct<offset:bigint,line_no:int,column_no:int>>"


class _Sizes(NamedTuple):
    """Of each text: its characters, its line ends, the characters after the last of them, and whether it begins with one."""

    chars: np.ndarray
    lines: np.ndarray
    tail: np.ndarray
    on_next: np.ndarray


def _sizes(texts: pa.Array) -> _Sizes:
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    begin, end = off[:-1] - off[0], off[1:] - off[0]
    ends = np.flatnonzero(raw == 10)
    upto = np.searchsorted(ends, end)
    lines = upto - np.searchsorted(ends, begin)
    last = begin.copy()
    last[lines > 0] = ends[upto[lines > 0] - 1] + 1
    # characters between neighbouring places: from each text's begin to its last line end, and from there to its end
    at = np.append(np.column_stack((begin, last)).ravel(), len(raw))
    first = np.append((raw & 0xC0) != 0x80, False).astype(np.uint8)
    between = np.where(at[1:] > at[:-1], np.add.reduceat(first, at, dtype=np.int64)[:-1], 0)
    starts = np.append(raw, 0)[begin] == 10
    return _Sizes(between[0::2] + between[1::2], lines, between[1::2], starts & (end > begin))


def places(found: pa.Array, pieces: pa.Array, put: str | None = None) -> pa.Array:
    """For each text the places of its matches, given these and the pieces between them, one piece for each match at least."""
    n = np.diff(found.offsets.to_numpy())
    rows = np.repeat(np.arange(len(n)), n)
    starts = np.concatenate(([0], np.cumsum(n)))
    no = np.arange(len(rows)) - starts[rows]
    match = _sizes(found.flatten())
    own = match if put is None else _Sizes(*(np.repeat(x, len(rows)) for x in _sizes(pa.array([put]))))
    piece_at = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
    pre = _Sizes(*(x[piece_at[rows] + no] for x in _sizes(pieces.flatten())))

    chars, lines = np.cumsum(pre.chars + own.chars), np.cumsum(pre.lines + own.lines)
    before = np.concatenate(([0], chars))[starts[rows]]
    begin, line_no = chars - own.chars, 1 + lines - own.lines - np.concatenate(([0], lines))[starts[rows]]
    # where the last line began, in pieces and matches so far; what earlier texts hold lies before this one's begin
    began = np.column_stack((np.where(pre.lines > 0, begin - pre.tail, 0), np.where(own.lines > 0, chars - own.tail, 0))).ravel()
    column = begin - np.maximum(np.maximum.accumulate(began)[0::2] if len(began) else began, before) + 1
    on_next = match.on_next
    fields = [pa.array(begin - before, pa.int64()), pa.array(line_no + on_next, pa.int32()), pa.array(np.where(on_next, 1, column), pa.int32())]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, ["offset", "line_no", "column_no"]))


def with_matches(rows: DataFrame, content: str, pattern: Column, name: str, first: Column | None = None, put: str | None = None) -> DataFrame:
    """The rows without `content`, with the array `name` of their matches, as `located` gives them; row by row, so on streams too."""
    ship(rows.sparkSession)
    c = F.col(content)
    found, pieces = F.regexp_extract_all(c, pattern, F.lit(0)), F.split(c, pattern, -1)
    if first is not None:
        found = F.when(first, F.slice(found, 1, 1)).otherwise(found)

    def placed(found: pa.Array, pieces: pa.Array) -> pa.Array:
        return places(found, pieces, put)

    keep = [F.col(x) for x in rows.columns if x != content]
    # rows without a content or a pattern have no matches
    none = F.array().cast("array<string>")
    cut = rows.select(*keep, F.coalesce(found, none).alias("__found"), F.coalesce(pieces, none).alias("__pieces"))
    cut = cut.withColumn("__places", F.arrow_udf(placed, _PLACES)("__found", "__pieces"))
    zipped = F.zip_with(F.col("__found"), F.col("__places"), lambda m, p: F.struct(m.alias("match"), p["offset"].alias("offset"), p["line_no"].alias("line_no"), p["column_no"].alias("column_no")))
    return cut.withColumn(name, F.transform(zipped, lambda x, i: F.struct(i.alias("match_no"), x["match"].alias("match"), x["offset"].alias("offset"), x["line_no"].alias("line_no"), x["column_no"].alias("column_no")))).drop("__found", "__pieces", "__places")


def one_each(rows: DataFrame, name: str) -> DataFrame:
    """A row for each match in the array `name`. An inner explode would have Spark infer a filter on the array's size and push it down, with all that makes the array, below everything that it is made from."""
    return rows.select("*", F.explode_outer(name).alias("__x")).drop(name).where("__x.match_no is not null").select("*", "__x.*").drop("__x")


def located(rows: DataFrame, content: str, pattern: Column, key: list[str], first: Column | None = None, put: str | None = None) -> DataFrame:
    """One row for each match of `pattern` in the column `content`: the other columns, and match_no (from 0), match, offset (code points, from 0), line_no and column_no (from 1).

    key: columns that name a row of `rows`; places don't depend on it, so rows of equal keys do no harm. first: where it holds, only the first match is given. put: the text that takes each match's place
    before the next one is looked at; positions are those in the text as it is then. A match that begins with a line end stands on the line after it. Each text is cut once, at its matches; lengths and
    line ends of the pieces are summed up for a batch of texts at once, so the work is in proportion to the texts and their matches, and nothing is shuffled. A pattern that can match nothing gives no
    sound positions.
    """
    return one_each(with_matches(rows, content, pattern, "__at", first, put), "__at")
