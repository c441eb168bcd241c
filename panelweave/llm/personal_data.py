"""Personal data: plain patterns, and a linear-chain conditional random field that adds what they miss.

The field looks at word shapes: a word's shape and those of its neighbours score the labels of the word, and pairs of
adjacent labels are scored too. It is trained from a small labelled table by gradient ascent on the log-likelihood and
decoded by Viterbi for many runs of words at once. A word without digit or sign, four words away from any that has one,
is outside by definition, so only the runs between such words are decoded. What the field proposes is kept where it
does not touch a pattern's span and could be of its kind by the number of digits or parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import begin, slices, strings, thinned

KINDS = ("email", "ip", "card", "phone")
NEAR = 4
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The first branch is an address; the second takes chains too short for one as a whole, so no digit is read twice.
FOUR = re.compile(r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)|[0-9]+(?:\.[0-9]+){0,2}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def byte_parts(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the patterns: leftmost, not overlapping, failing matches dropped; linear in the text."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        found[0] = list(_emails(text))
    if any(d in text for d in "0123456789"):
        found[1] = [m.span() for m in FOUR.finditer(text) if m[1] and byte_parts(m[1].split("."))]
        for m in DIGITS.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in CALL.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return found


def shape(word: str) -> str:
    """Letters as x or X, digits as 9 with runs up to four counted, other signs as they are; empty for a plain word."""
    if not any(c.isdigit() or c in "@+" for c in word):
        return ""
    kinds = ["9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word]
    out: list[str] = []
    for c in kinds:
        if c in "xX" and out and out[-1] == c or c == "9" and out[-4:] == ["9"] * 4:
            continue
        out.append(c)
    return "".join(out)


class Shapes(dict):
    """Number of a word's shape: 0 for plain words, 1 for shapes not learned, 2 for the border of a run."""

    def __init__(self, known: dict[str, int], limit: int = 200_000):
        super().__init__()
        self.known, self.limit = known, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        name = shape(word)
        value = self[word] = self.known.get(name, 1) if name else 0
        return value


class Field:
    """Weights of a chain over labels: outside, then one for each of ``KINDS``."""

    def __init__(self, shapes: dict[str, int]):
        self.shapes = shapes
        n, y = len(shapes) + 3, len(KINDS) + 1
        self.own, self.left, self.right = (np.zeros((n, y)) for _ in range(3))
        self.step = np.zeros((y, y))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(T, runs, labels) from shape numbers (T + 2, runs), bordered above and below."""
        return self.own[ids[1:-1]] + self.left[ids[:-2]] + self.right[ids[2:]]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels (T, runs) of runs sorted longest first, by Viterbi over all runs at once."""
        score = self.scores(ids)
        steps = len(score)
        back = np.zeros(score.shape, np.int8)
        best = score[0].copy()
        for t in range(1, steps):
            k = int(np.searchsorted(-lengths, -t, side="left"))
            ways = best[:k, :, None] + self.step
            back[t, :k] = ways.argmax(axis=1)
            best[:k] = ways.max(axis=1) + score[t, :k]
        labels = np.zeros((steps, len(lengths)), np.int8)
        now = best.argmax(axis=1).astype(np.int8)
        for t in range(steps - 1, -1, -1):
            k = int(np.searchsorted(-lengths, -t, side="left"))
            labels[t, :k] = now[:k]
            now[:k] = np.take_along_axis(back[t, :k], now[:k, None].astype(np.int64), axis=1)[:, 0]
        return labels

    def train(self, runs: list[tuple[list[int], list[int]]], rounds: int = 120, rate: float = 1.0, decay: float = 1e-4) -> Field:
        """Ascend the mean log-likelihood of labelled runs (shape numbers, labels) by forward and backward sums."""
        runs = sorted((r for r in runs if r[0]), key=lambda r: -len(r[0]))
        if not runs:
            return self
        lengths = np.array([len(r[0]) for r in runs])
        steps, n, y = int(lengths[0]), len(runs), self.step.shape[0]
        ids, gold = np.full((steps + 2, n), 2), np.zeros((steps, n), int)
        for k, (own, labels) in enumerate(runs):
            ids[1 : len(own) + 1, k], gold[: len(own), k] = own, labels
        inside = np.arange(steps)[:, None] < lengths
        both = inside[1:]
        actual = np.eye(y)[gold] * inside[..., None]
        pairs = np.einsum("tna,tnb->ab", actual[:-1], actual[1:])
        for at in range(rounds):
            score = self.scores(ids)
            ahead, behind = np.zeros((steps, n, y)), np.zeros((steps, n, y))
            ahead[0] = score[0]
            for t in range(1, steps):
                new = _sum((ahead[t - 1][:, :, None] + self.step), 1) + score[t]
                ahead[t] = np.where(inside[t][:, None], new, ahead[t - 1])
            for t in range(steps - 2, -1, -1):
                new = _sum(self.step + (score[t + 1] + behind[t + 1])[:, None, :], 2)
                behind[t] = np.where(both[t][:, None], new, 0.0)
            whole = _sum(ahead[-1], 1)
            p = np.exp(ahead + behind - whole[None, :, None]) * inside[..., None]
            joint = np.exp(ahead[:-1, :, :, None] + self.step + (score[1:] + behind[1:])[:, :, None, :] - whole[None, :, None, None]) * both[..., None, None]
            change = (actual - p) / n
            pace = rate * (1 - 0.9 * at / rounds)
            for weights, seen in ((self.own, ids[1:-1]), (self.left, ids[:-2]), (self.right, ids[2:])):
                slope = np.zeros_like(weights)
                np.add.at(slope, seen.ravel(), change.reshape(-1, y))
                weights += pace * (slope - decay * weights)
            self.step += pace * ((pairs - joint.sum(axis=(0, 1))) / n - decay * self.step)
        return self


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def active_runs(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of words that lie near a word with a digit or sign, within one text."""
    n = len(ids)
    edges = np.zeros(n + 1, np.int64)
    hot = np.flatnonzero(ids)
    if not len(hot):
        return hot, hot
    first = np.searchsorted(owner, owner[hot], side="left")
    last = np.searchsorted(owner, owner[hot], side="right")
    np.add.at(edges, np.maximum(first, hot - NEAR), 1)
    np.add.at(edges, np.minimum(last, hot + NEAR + 1), -1)
    on = np.cumsum(edges[:-1]) > 0
    begins = np.flatnonzero(on & np.concatenate([[True], ~on[:-1] | (owner[1:] != owner[:-1])]))
    ends = np.flatnonzero(on & np.concatenate([~on[1:] | (owner[1:] != owner[:-1]), [True]])) + 1
    return begins, ends


def plausible(kind: int, said: str) -> bool:
    digits = NO_DIGIT.sub("", said)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+(?:\s?\.\s?[A-Za-z0-9-]+)+", said))
    if kind == 1:
        return byte_parts(re.split(r"[^0-9]+", said.strip("[](){}<>,;:.")))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z@+]", said)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z@]", said) and ("+" in said or "(" in said)


def find_spans(field: Field, shapes: Shapes, texts: list[str], bases: list[list[list[tuple[int, int]]]]) -> list[list[list[tuple[int, int]]]]:
    """All spans of each text and kind: those of the patterns and those the field adds."""
    words = [TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((shapes[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    begins, ends = active_runs(ids, owner)
    found = [[list(k) for k in b] for b in bases]
    order = np.argsort(begins - ends, kind="stable")
    offset = np.cumsum(sizes) - sizes
    places: dict[int, list[tuple[int, int]]] = {}
    for at in range(0, len(order), 2048):
        part = order[at : at + 2048]
        a, b = begins[part], ends[part]
        steps = np.arange((b - a)[0])
        table = np.full((len(steps) + 2, len(part)), 2)
        table[1:-1] = np.where(steps[:, None] < b - a, ids[np.minimum(a + steps[:, None], len(ids) - 1)], 2)
        labels = field.decode(table, b - a)
        for col in np.flatnonzero(labels.any(axis=0)).tolist():
            line, doc = labels[:, col].tolist(), int(owner[a[col]])
            if doc not in places:
                places[doc] = [m.span() for m in TOKEN.finditer(texts[doc])]
            t, size = 0, int(b[col] - a[col])
            while t < size:
                stop = t + 1
                while stop < size and line[stop] == line[t]:
                    stop += 1
                if line[t]:
                    first = int(a[col] - offset[doc]) + t
                    _add(found[doc], line[t] - 1, texts[doc], places[doc][first][0], places[doc][first + stop - t - 1][1])
                t = stop
    return [[sorted(k) for k in f] for f in found]


def _add(found: list[list[tuple[int, int]]], kind: int, text: str, start: int, end: int) -> None:
    while start < end and text[end - 1] in ".,;:!?":
        end -= 1
    if all(end <= s or e <= start for spans in found for s, e in spans) and plausible(kind, text[start:end]):
        found[kind].append((start, end))


def label_words(text: str, spans: list[list[tuple[int, int]]]) -> tuple[list[str], list[int]]:
    """Words of ``text`` and the label of each: the kind of a span that it touches."""
    words, labels = [], []
    flat = sorted((s, e, k + 1) for k, kind in enumerate(spans) for s, e in kind)
    for m in TOKEN.finditer(text):
        words.append(m[0])
        labels.append(next((k for s, e, k in flat if s < m.end() and m.start() < e), 0))
    return words, labels


def learn(docs: DataFrame, most_rows: int = 400, length: int = 400) -> Field:
    """A field trained on a small labelled table: at most ``most_rows`` pieces of ``length`` characters around the first
    digit of a text, chosen by a hash of id and text, labelled by the patterns."""
    at = F.regexp_instr("text", F.lit(r"[0-9]"))
    piece = F.substring(F.col("text"), F.greatest(F.lit(1), at - length // 2), F.lit(length))
    table = docs.where(F.col("text").rlike("[0-9]")).select(F.xxhash64("doc_id", "text").alias("draw"), piece.alias("piece"))
    rows = thinned(table, "draw", docs.count(), 100 * most_rows).orderBy("draw", "piece").limit(most_rows).collect()
    labelled = [label_words(r.piece, base_spans(r.piece)) for r in rows]
    names = sorted({s for words, _ in labelled for w in words if (s := shape(w))})
    field = Field({s: k + 3 for k, s in enumerate(names)})
    shapes, runs = Shapes(field.shapes), []
    for words, labels in labelled:
        ids = np.array([shapes[w] for w in words], int)
        runs += [(ids[a:b].tolist(), labels[a:b]) for a, b in zip(*active_runs(ids, np.zeros(len(ids), int)))]
    return field.train(runs)


def spans_of(docs: DataFrame, field: Field, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans``: arrays of (kind, start, end), code points, end exclusive, by kind and start.

    Null texts are empty. Repeated rows are each searched, other columns are ignored, an empty table gives an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    kind = "array<struct<kind: string, start: int, end: int>>"

    def listed(spans: list[list[tuple[int, int]]]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for k, found in zip(KINDS, spans) for s, e in found]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("personal_data")
        shapes = Shapes(field.shapes)
        for piece in slices(batches):
            texts = strings(piece.column("text"))
            bases = [base_spans(t) for t in texts]
            whole = find_spans(field, shapes, texts, bases)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(map(listed, bases), pa.list_(span)), pa.array(map(listed, whole), pa.list_(span))], [*keep, "base", "spans"])

    text = [] if "text" in keep else ["text"]
    return docs.select(*keep, *text).mapInArrow(search, f"{schema}, base {kind}, spans {kind}")


def redact(text, spans):
    """``text`` with each of ``spans`` replaced by its kind in brackets; where two overlap, the one that starts first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start, s.end, s.kind)))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    piece = lambda a, s: F.concat(a.done, F.substring(text, a["at"] + 1, s.start - a["at"]), F.lit("["), F.upper(s.kind), F.lit("]"))
    walked = F.aggregate(ordered, start, lambda a, s: F.when(s.start >= a["at"], F.struct(piece(a, s).alias("done"), s.end.alias("at"))).otherwise(a))
    rest = F.concat(walked["done"], F.substring(text, walked["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
