"""Chat formatting: records of different layouts become turns, and turns a marked-up text that reads back exactly."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. `paths`: the field paths that mark the layout. `turns`: (role, path) in order, a role
    that starts with @ names the field beside the text that holds the role; `many`: the list that holds the turns, or
    "". `order`: the field with the turn's number, or ""."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    many: str = ""
    order: str = ""


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), (("@role", "text"),), order="turn"),
    Layout("messages", ("messages[].content", "messages[].role"), (("@role", "content"),), "messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (("@from", "value"),), "conversations"),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt and completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
)
#: Names of roles that mean one of ours.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a parsed JSON value; elements of a list share the path with []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return {at}


def fingerprint(found: set[str] | tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found)), 0)


class Mapper:
    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.by_print = {fingerprint(x.paths): x for x in layouts}
        self.known = {p for x in layouts for p in x.paths}
        self.names = {p.split(".")[0].split("[")[0] for p in self.known}

    def layout(self, record: object) -> Layout | None:
        """By the fingerprint of the record's paths, of those that some layout uses."""
        if not isinstance(record, dict):
            return None
        found = paths({k: v for k, v in record.items() if k in self.names})
        return self.by_print.get(fingerprint(found)) or self.by_print.get(fingerprint(found & self.known))

    def turns(self, record: object) -> list[tuple[int | None, str | None, str]]:
        """(order, role, text) of each turn. Records of no known layout have none; text that isn't a string is written as JSON, null as nothing."""
        if (of := self.layout(record)) is None:
            return []
        out = []
        for item in record.get(of.many) or [] if of.many else [record]:
            for role, field in of.turns:
                if isinstance(item, dict) and (field in item or not of.many):
                    name, text = item.get(role[1:]) if role[0] == "@" else role, item.get(field)
                    name = name if name is None or isinstance(name, str) else json.dumps(name)
                    text = "" if text is None else text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)
                    if text or role[0] == "@" or field != "input":
                        out.append((item.get(of.order) if of.order else len(out), ROLES.get(name, name), text))
        return out


def to_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, key: str = "conv_id", record: str = "record") -> DataFrame:
    """(conv_id, turn, role, text) of records (key long, record JSON string). Null and malformed records, and those of an unknown layout, give no turns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(layouts)
        for batch in it:
            out: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parsed = json.loads(raw) if raw else None
                except ValueError:
                    continue
                out += [(k, n if isinstance(n, int) else None, role, text) for n, role, text in mapper.turns(parsed)]
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "turn", "role", "text"])

    return records.select(F.col(key).cast("long").alias("conv_id"), F.col(record).alias("record")).mapInArrow(run, "conv_id long, turn long, role string, text string")


def _escape(text: Column, what: str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), what, r"\\$0")


def format_turns(turns: DataFrame) -> DataFrame:
    r"""`turns` (conv_id, turn, role, text) with formatted, loss_start and loss_end, one row a turn.

    A turn is written as `<turn ROLE>`, a line end, the text, a line end, `</turn>` and a line end. In texts a backslash goes before
    every backslash, `<turn` and `</turn`; in roles before every backslash and `>`. What is within
    loss_start and loss_end (code points, in the turn) counts for the loss: the whole text of assistants, else nothing. A conversation
    is the concatenation of its turns by number; it is kept as rows, so no conversation is too long. Null roles and texts count as empty.
    """
    role, text = _escape(F.col("role"), r"[\\>]"), _escape(F.col("text"), r"\\|</?turn")
    out = turns.withColumn("__role", role).withColumn("__text", text)
    head = F.concat(F.lit("<turn "), "__role", F.lit(">\n"))
    out = out.withColumn("formatted", F.concat(head, "__text", F.lit("\n</turn>\n"))).withColumn("loss_start", F.length(head))
    end = F.when(F.col("role") == "assistant", F.col("loss_start") + F.length("__text")).otherwise(F.col("loss_start"))
    return out.withColumn("loss_end", end).drop("__role", "__text")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, chars) of formatted turns, from formatted and the mask alone."""
    pattern = r"(?s)\A<turn ((?:[^\\>]++|\\.)*+)>\n(.*)\n</turn>\n\z"
    plain = lambda c, what: F.regexp_replace(c, r"\\(" + what + ")", "$1")
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    texts = r"\\|</?turn"
    return formatted.select("conv_id", "turn", plain(F.regexp_extract("formatted", pattern, 1), r"[\\>]").alias("role"), plain(F.regexp_extract("formatted", pattern, 2), texts).alias("text"), plain(loss, texts).alias("loss_text"), F.length("formatted").alias("chars"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of read_back's turns, by number, then role and text.

    A task reads its conversations turn by turn in order and holds two hash states, never a conversation.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, out, open_ = None, [], False
        n = lost = chars = 0
        whole = part = None

        def done() -> tuple:
            return now, n, whole.hexdigest(), lost, part.hexdigest(), chars

        for batch in it:
            for conv, role, text, loss, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if not open_ or conv != now:
                    if open_:
                        out.append(done())
                    now, open_, n, lost, chars, whole, part = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, lost, chars = n + 1, lost + len(loss), chars + size
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                part.update(loss.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)
            out = []
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), kinds)], names=names)

    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
