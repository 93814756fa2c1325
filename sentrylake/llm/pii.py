"""Personal data: fixed patterns, and a character-level BiLSTM-CRF trained from their labelled spans."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, thinned

KINDS = ("email", "ip", "card", "phone")
#: Every kind holds one of these characters.
TRIGGER = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        # what precedes this @ cannot begin a later match: @ is no local character
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, in code points, by start and then by kind as listed. Each kind by itself: leftmost matches that don't overlap; a match that fails its test is dropped.

    Every search is linear: an email is sought from its @ leftwards, the others can't backtrack over runs of digits.
    """
    if not TRIGGER.search(text):
        return []
    out = list(_emails(text))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(d := "".join(_DIGIT.findall(m[0]))) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shapes(text: str) -> list[Span]:
    """What the model learns to find: the patterns' matches before their tests of digits, which no tagger could learn; `plausible` repeats those tests."""
    out = list(_emails(text)) + [(m.start(), m.end(), "ip") for m in _IP.finditer(text)] + [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out + [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 12 <= len(_DIGIT.findall(m[0])) <= 19])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


#: Characters by class: printable ASCII as such, then other letters, other white space, the rest, and padding.
_N_CHARS = 99
_TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind


@functools.cache
def _classes() -> np.ndarray:
    import sys

    out = np.full(sys.maxunicode + 1, 97, np.uint8)
    for c in range(sys.maxunicode + 1):
        out[c] = c - 32 if 32 <= c < 127 else 96 if chr(c).isspace() else 95 if chr(c).isalpha() else 97
    return out


def encode(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    """One tag a character; of overlapping spans the earlier, longer one."""
    tags = np.zeros(n, np.int64)
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not tags[s:e].any():
            tags[s:e] = 2 + 2 * KINDS.index(k)
            tags[s] -= 1
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Bidirectional LSTM over character classes with CRF transitions, in numpy."""

    def __init__(self, hidden: int = 20, seed: int = 2):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"x{d}": r.normal(0, 0.3, (_N_CHARS, 4 * h)) for d in "fb"} | {f"u{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)) for d in "fb"}
        self.p |= {"w": r.normal(0, 1 / np.sqrt(2 * h), (2 * h, _TAGS)), "c": np.zeros(_TAGS), "t": np.zeros((_TAGS, _TAGS))}
        for d in "fb":
            self.p[f"x{d}"][:, h : 2 * h] += 0.5
        for k in range(1, len(KINDS) + 1):  # an inside tag follows its own kind only
            for a in range(_TAGS):
                if a not in (2 * k - 1, 2 * k):
                    self.p["t"][a, 2 * k] = -8
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: steps x batch of classes; hidden states of the same shape."""
        h = self.h
        hid = np.zeros((x.shape[1], h), np.float32)
        cell, out = hid, np.empty((*x.shape, h), np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        table, u = self.p[f"x{d}"], self.p[f"u{d}"]
        for t in steps:
            z = table[x[t]] + hid @ u
            g = np.tanh(z[:, 3 * h :])
            s = _sigmoid(z[:, : 3 * h])
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            before, prev = cell, hid
            cell = f * cell + i * g
            tc = np.tanh(cell)
            hid = o * tc
            out[t] = hid
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, prev))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: batch x steps; batch x steps x tags."""
        x = np.ascontiguousarray(x.T)
        both = np.concatenate((self._lstm(x, "f"), self._lstm(x, "b")), axis=2)
        return (both @ self.p["w"] + self.p["c"]).transpose(1, 0, 2)

    def _lstm_grad(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        h, u = self.h, self.p[f"u{d}"]
        dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        for t, i, f, o, g, before, tc, prev in reversed(kept):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            np.add.at(grad[f"x{d}"], x[t], dz)
            grad[f"u{d}"] += prev.T @ dz
            dh, dc = dz @ u.T, dc * f

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag paths y (batch x steps), and its gradient."""
        n, steps = x.shape
        xt, kept = np.ascontiguousarray(x.T), {d: [] for d in "fb"}
        both = np.concatenate([self._lstm(xt, d, kept[d]) for d in "fb"], axis=2)
        e = both @ self.p["w"] + self.p["c"]  # steps x batch x tags
        tr, rows = self.p["t"], np.arange(n)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        lse = lambda v, axis: (m := v.max(axis=axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis=axis))
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de, dt = np.exp(alpha + beta - z[:, None]), np.zeros_like(tr)
        score = e[0][rows, y[:, 0]].copy()
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            dt += pair.sum(axis=0)
            np.add.at(dt, (y[:, t - 1], y[:, t]), -1)
            score += tr[y[:, t - 1], y[:, t]] + e[t][rows, y[:, t]]
        for t in range(steps):
            de[t][rows, y[:, t]] -= 1
        de, dt = de / n, dt / n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["t"], grad["c"] = dt, de.sum(axis=(0, 1))
        grad["w"] = both.reshape(-1, 2 * self.h).T @ de.reshape(-1, _TAGS)
        dboth = de @ self.p["w"].T
        self._lstm_grad(xt, "f", kept["f"], dboth[:, :, : self.h], grad)
        self._lstm_grad(xt, "b", kept["b"], dboth[:, :, self.h :], grad)
        return float((z - score).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 48, rate: float = 0.025, seed: int = 2) -> Tagger:
        r, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for n in range(1, steps + 1):
            pick = r.integers(0, len(x), min(batch, len(x)))
            _, g = self.step(x[pick], y[pick])
            norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in g.values()))) / 5)
            for k in self.p:
                a = g[k] / norm
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
                lr = rate * (1 - n / (steps + 1))
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tag path of emissions (steps x batch x tags), as steps x batch."""
        tr, rows = self.p["t"], np.arange(e.shape[1])
        best, back = e[0], np.zeros((len(e), *e.shape[1:]), np.int8)
        for t in range(1, len(e)):
            s = best[:, :, None] + tr
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[t]
        path = np.empty(e.shape[:2], np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][rows, path[t]]
        return path


    def odds(self, e: np.ndarray, tags: np.ndarray, start: int, end: int) -> float:
        """Probability of the path `tags` against the one that has no span from start to end, in an otherwise fixed path."""
        other = tags.copy()
        other[start:end] = 0
        a, b = max(0, start - 1), min(len(tags), end + 1)
        score = lambda p: e[np.arange(a, b), p[a:b]].sum() + self.p["t"][p[a : b - 1], p[a + 1 : b]].sum()
        return float(_sigmoid(np.float64(score(tags) - score(other))))


WINDOW, STRIDE = 96, 48
#: Windows of a stretch that are decoded at a time, and those that two such parts share on either side.
MOST_WINDOWS, MARGIN = 1024, 4


def windows(text: str) -> list[int]:
    """Starts of the windows, laid over the whole text at STRIDE, that hold a character of TRIGGER; no labelled kind is without one."""
    hits = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    return sorted({min(max(w, 0), last) * STRIDE for h in hits for w in (h - 1, h)})


def plausible(kind: str, text: str) -> bool:
    """What a span of the model must look like to be added."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]*[A-Za-z0-9]", text))
    if kind == "ip":
        return False  # the pattern has every valid address
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and bool(re.search(r"[0-9][ ().-]+[0-9]", text))


def decode(tagger: Tagger, texts: list[str], sure: float = 0.9, at_once: int = 512) -> list[list[Span]]:
    """The model's spans of each text. Overlapping windows vote with emissions weighted by distance from the window's edge; one Viterbi path then runs over every covered stretch.

    A stretch of more than MOST_WINDOWS windows is decoded in parts that overlap by MARGIN windows on either side; a span counts where it begins in the part's own windows, so memory does not grow with the text.
    """
    stretches: list[tuple[int, int, list[int], int, int]] = []
    for n, text in enumerate(texts):
        run: list[int] = []
        for w in [*windows(text), -1]:
            if run and (w < 0 or w > run[-1] + STRIDE):
                for at in range(0, len(run), MOST_WINDOWS):
                    part = run[max(0, at - MARGIN) : at + MOST_WINDOWS + MARGIN]
                    stretches.append((n, part[0], part, run[at] if at else 0, run[at + MOST_WINDOWS] if at + MOST_WINDOWS < len(run) else len(text)))
                run = []
            run.append(w)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    out: list[list[Span]] = [[] for _ in texts]
    stretches.sort(key=lambda s: len(s[2]))
    at = 0
    while at < len(stretches):
        end = at + 1
        while end < len(stretches) and (end - at + 1) * len(stretches[end][2]) <= at_once:
            end += 1
        group, at = stretches[at:end], end
        steps = WINDOW + STRIDE * (len(group[-1][2]) - 1)
        total = np.zeros((steps, len(group), _TAGS), np.float32)
        share = np.zeros((steps, len(group), 1), np.float32)
        todo = [(g, k, encode(texts[n][w : w + WINDOW])) for g, (n, _, starts, _, _) in enumerate(group) for k, w in enumerate(starts)]
        for a in range(0, len(todo), at_once):
            x = np.full((len(todo[a : a + at_once]), WINDOW), 98, np.uint8)
            for r, (_, _, codes) in enumerate(todo[a : a + at_once]):
                x[r, : len(codes)] = codes
            for (g, k, codes), e in zip(todo[a : a + at_once], tagger.emissions(x)):
                s = k * STRIDE
                total[s : s + len(codes), g] += e[: len(codes)] * weight[: len(codes)]
                share[s : s + len(codes), g] += weight[: len(codes)]
        total /= np.maximum(share, 1e-6)
        total[:, :, 0] += np.where(share[:, :, 0] > 0, 0, 50)
        path = tagger.viterbi(total)
        for g, (n, start, _, own, own_end) in enumerate(group):
            tags = path[:, g]
            for s in np.flatnonzero(tags % 2 == 1).tolist():
                kind, e = (int(tags[s]) - 1) // 2, s + 1
                while e < steps and tags[e] == 2 + 2 * kind:
                    e += 1
                text = texts[n][start + s : start + e]
                if own <= start + s < own_end and tagger.odds(total[:, g], tags, s, e) >= sure and plausible(KINDS[kind], text):
                    out[n].append((start + s, start + e, KINDS[kind]))
    return [sorted(x) for x in out]


def find(tagger: Tagger | None, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans: those of the model join if they touch no base span."""
    base = [base_spans(t) for t in texts]
    extra = decode(tagger, texts) if tagger else [[] for _ in texts]
    every = [b + [x for x in e if all(x[1] <= s[0] or s[1] <= x[0] for s in b)] for b, e in zip(base, extra)]
    return base, [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in every]


def surroundings(text: str, reach: int = 70) -> list[str]:
    return [text[max(0, m.start() - reach) : m.end() + reach] for m in re.finditer(r"[0-9@](?:.{0,20}?[0-9@])*", text)]


def examples(got: list[str], seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags, from texts of a trigger and what surrounds it."""
    r, xs, ys = np.random.default_rng(seed), [], []
    for text in sorted(set(got)):
        versions = [(text, shapes(text))]
        for a, b, kind in versions[0][1]:
            if kind == "phone" and (m := re.match(r"\+[0-9]{1,2}[ .-]?", text[a:b])):
                for number in (text[a + m.end() : b], re.sub(r"[()]", "", text[a + m.end() : b])):
                    t = text[:a] + number + text[b:]
                    others = [x for x in shapes(t) if x[1] <= a or x[0] >= a + len(number)]
                    versions.append((t, [*others, (a, a + len(number), "phone")]))
                break
        for t, spans in versions:
            shift = int(r.integers(0, 40))
            codes, tags = encode(t)[shift : shift + WINDOW], tags_of(spans, len(t))[shift : shift + WINDOW]
            if len(tags) and tags[0] and tags[0] % 2 == 0:  # a span that the window cuts is no example
                cut_at = int(np.argmin(tags == tags[0])) or len(tags)
                codes, tags = codes[cut_at:], tags[cut_at:]
            x, y = np.full(WINDOW, 98, np.uint8), np.zeros(WINDOW, np.int64)
            x[: len(codes)], y[: len(tags)] = codes, tags
            xs.append(x)
            ys.append(y)
    return np.array(xs, np.uint8).reshape(-1, WINDOW), np.array(ys, np.int64).reshape(-1, WINDOW)


def train(docs: DataFrame, rows: int = 1500, seed: int = 2) -> Tagger | None:
    """A tagger fitted on a bounded sample of passages with a digit or @, from anywhere in whole texts.

    Of about 8 * rows documents, thinned by text hash, each gives at most one passage for each labelled kind and one without a label, that of least hash; of each of these five sorts the
    rows / 5 passages with the smallest hashes are learned, each text once. So `rows` bounds the sample. Labels are the patterns' matches (`shapes`). Passages with a phone number are repeated with its
    country code, and with its brackets, cut off, so that the model also learns numbers that the pattern misses. None if no passage has a label.
    """
    with_trigger = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    n = with_trigger.agg(F.approx_count_distinct("h", 0.02)).first()[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 256):
            found: dict[tuple[str, bytes], int] = {}
            for text in batch.column(0).to_pylist():
                best: dict[str, tuple[int, bytes]] = {}
                for part in surroundings(text):
                    raw = part.encode("utf-8", "surrogatepass")
                    h = zlib.crc32(raw)
                    for kind in {k for _, _, k in shapes(part)} or {""}:
                        best[kind] = min(best.get(kind, (1 << 32, b"")), (h, raw))
                found |= {(kind, raw): h for kind, (h, raw) in best.items()}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([raw for _, raw in found], pa.binary())], names=["kind", "h", "part"])

    picked = with_trigger.where(thinned(F.col("h"), 8 * rows, n)).mapInArrow(run, "kind string, h long, part binary").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h", "part"))
    got = [r.part.decode("utf-8", "surrogatepass") for r in picked.withColumn("nth", nth).where(F.col("nth") <= rows // (len(KINDS) + 1)).orderBy("kind", "nth").select("part").collect()]
    x, y = examples(got, seed)
    return Tagger(seed=seed).fit(x, y, seed=seed) if y.any() else None


def detect(docs: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, all) of every whole text; all: array of (start, end, kind).

    Counts and base_sha256 (of the base spans as listed by `listed`) are of the fixed patterns; spans are theirs and the model's.
    A null text is empty and has none; repeated rows are returned as often.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(it):
            base, every = find(tagger, [x or "" for x in batch.column(1).to_pylist()])
            cols = [batch.column(0), *(pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS)]
            cols += [pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()), pa.array([listed(e) for e in every], pa.string())]
            cols.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in every], spans_type))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "all"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, all array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets (of overlapping spans the first names the whole); n_chars, if there, is counted anew. Null texts stay null."""
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            given = batch.column(at).to_pylist()
            _, every = find(tagger, [x or "" for x in given])
            new = pa.array([x if x is None else redact_text(x, s) for x, s in zip(given, every)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out
