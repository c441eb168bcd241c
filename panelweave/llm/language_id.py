"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network labels every byte: a state read from the left and one read from the right each add to the scores of the
languages, and the probabilities of all bytes of a text are averaged. It is trained in numpy by backpropagation through
time on a bounded sample of labelled rows. Texts are read in segments, side by side, all bytes of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import begin, slices, strings

SEGMENT = 128
UNDECIDED = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Direction:
    """A gated recurrent unit: byte tables (3H, 256), recurrent weights (3H, H), scores (L, H). Rows: update, reset, new."""

    table: np.ndarray
    recur: np.ndarray
    score: np.ndarray

    def step(self, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, ...]:
        size = h.shape[0]
        x, u = self.table[:, byte], self.recur @ h
        gates = np.clip(0.25 * (x[: 2 * size] + u[: 2 * size]) + 0.5, 0, 1)
        update, reset = gates[:size], gates[size:]
        new = np.tanh(x[2 * size :] + reset * u[2 * size :])
        return new + update * (h - new), update, reset, new, u[2 * size :]


@dataclass
class Network:
    languages: list[str]
    left: Direction
    right: Direction
    bias: np.ndarray

    def pooled(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each segment of the languages' probabilities; segments (T, B), longest first."""
        steps, n = segments.shape
        open_ = np.searchsorted(-lengths, -np.arange(steps), side="left")  # segments still read at each step
        size, total = self.left.recur.shape[1], np.zeros((len(self.languages), n), np.float32)
        scores = np.empty((steps, len(self.languages), n), np.float32)
        h = np.zeros((size, n), np.float32)
        for t in range(steps):
            k = open_[t]
            h = self.left.step(h[:, :k], segments[t, :k])[0]
            scores[t, :, :k] = self.left.score @ h
        h = np.zeros((size, 0), np.float32)
        for t in range(steps - 1, -1, -1):
            k = open_[t]
            h = np.concatenate([h, np.zeros((size, k - h.shape[1]), np.float32)], axis=1) if k > h.shape[1] else h
            h = self.right.step(h, segments[t, :k])[0]
            p = np.exp(scores[t, :, :k] + self.right.score @ h + self.bias)
            total[:, :k] += p / p.sum(axis=0)
        return total

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probability over all bytes; zero for an empty text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        data = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
        first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(pieces) - pieces) * SEGMENT, pieces) + np.arange(len(owner)) * SEGMENT
        lengths = np.minimum(SEGMENT, np.repeat(np.cumsum(sizes), pieces) - first)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            segments = np.ascontiguousarray(data[first[part][:, None] + np.arange(lengths[part[0]])].T)
            np.add.at(out, owner[part], self.pooled(segments, lengths[part]).T)
        return out / np.maximum(sizes, 1)[:, None]


def train(languages: list[str], label: np.ndarray, segments: np.ndarray, hidden: int = 8, rounds: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit to ``segments`` (rows, T) of bytes, each of language ``label``; batches draw languages alike often."""
    rng = np.random.default_rng(seed)
    n = len(languages)

    def fresh() -> Direction:
        return Direction(rng.normal(0, 0.3, (3 * hidden, 256)), rng.normal(0, 0.3, (3 * hidden, hidden)), rng.normal(0, 0.3, (n, hidden)))

    left, right, bias = fresh(), fresh(), np.zeros((n, 1))
    weights = [left.table, left.recur, left.score, right.table, right.recur, right.score, bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    rows_of = [np.flatnonzero(label == k) for k in range(n)]
    for at in range(1, rounds + 1 if n > 1 else 1):
        pick = np.concatenate([rng.choice(r, max(1, batch // n)) for r in rows_of])
        data, wanted = segments[pick].T, label[pick]
        runs = [_forward(left, data), _forward(right, data[::-1])]
        scores = np.stack([left.score @ h for h in runs[0][0][1:]]) + np.stack([right.score @ h for h in runs[1][0][1:]])[::-1] + bias
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, wanted, np.arange(len(pick))] -= 1
        p /= p.shape[0] * p.shape[2]
        slopes = [*_backward(left, data, *runs[0], p), *_backward(right, data[::-1], *runs[1], p[::-1]), p.sum(axis=(0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        for w, g, (m, v) in zip(weights, slopes, moments):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (1 - 0.9 * at / rounds) * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.99**at)) + 1e-8)
    small = [Direction(*(x.astype(np.float32) for x in (d.table, d.recur, d.score))) for d in (left, right)]
    return Network(languages, *small, bias.astype(np.float32))


def _forward(d: Direction, data: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    states, kept = [np.zeros((d.recur.shape[1], data.shape[1]))], []
    for byte in data:
        h, *rest = d.step(states[-1], byte)
        states.append(h)
        kept.append(tuple(rest))
    return states, kept


def _backward(d: Direction, data: np.ndarray, states: list[np.ndarray], kept: list[tuple[np.ndarray, ...]], error: np.ndarray) -> list[np.ndarray]:
    """Slopes of table, recur and score; ``error`` is the slope of the scores at each step."""
    g_table, g_recur, g_score = np.zeros_like(d.table), np.zeros_like(d.recur), np.zeros_like(d.score)
    size, back = d.recur.shape[1], 0.0
    for t in range(len(data) - 1, -1, -1):
        (update, reset, new, u_new), before = kept[t], states[t]
        g_score += error[t] @ states[t + 1].T
        g_h = d.score.T @ error[t] + back
        g_new = g_h * (1 - update) * (1 - new * new)
        gates = np.concatenate([g_h * (before - new) * ((update > 0) & (update < 1)), g_new * u_new * ((reset > 0) & (reset < 1))]) * 0.25
        g_x, g_u = np.concatenate([gates, g_new]), np.concatenate([gates, g_new * reset])
        np.add.at(g_table.T, data[t], g_x.T)
        g_recur += g_u @ before.T
        back = d.recur.T @ g_u + g_h * update
    return [g_table, g_recur, g_score]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def shared_out(counts: list[int], most: int) -> int:
    """The number at which to stop every one of ``counts`` so that at most ``most`` are left of all."""
    left = most
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return left // (len(counts) - k)
        left -= n
    return max(counts, default=0)


def learn(docs: DataFrame, most_rows: int = 2000, pieces: int = 4, length: int = 64) -> Network:
    """Train on at most ``most_rows`` labelled rows outside the held-out part, chosen by a hash of id and text, with ``pieces`` slices of each.

    Languages get alike many rows, what a rare one does not have going to the others. Should there be more languages than
    rows, the most frequent get one row each. Held-out rows have no part in any of this.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0))
    draw = F.xxhash64("doc_id", "text")
    size = F.greatest(F.lit(1), F.octet_length("text") - length)
    cuts = [F.substring(F.col("text").cast("binary"), (1 + F.pmod(F.xxhash64(draw, F.lit(k)), size)).cast("int"), F.lit(length)) for k in range(pieces)]
    table = labelled.select("lang", draw.alias("draw"), *[c.alias(f"cut{k}") for k, c in enumerate(cuts)])
    tallied = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_rows).collect()
    counts = {r.lang: r.n for r in tallied}
    quota = shared_out(list(counts.values()), most_rows)
    rows = []
    if counts:
        thin = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (8 * max(1, quota))))])[F.col("lang")]
        few = table.where(F.col("lang").isin(*counts)).where(F.pmod(F.col("draw"), thin) == 0)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", *[f"cut{k}" for k in range(pieces)]))
        drawn = few.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place").collect()
        rows = sorted(drawn, key=lambda r: (r.draw, r.lang, *map(bytes, r[2:])))
    languages = sorted({r.lang for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    found = [(number[r.lang], bytes(r[2 + k])) for r in rows if r.lang in number for k in range(pieces)]
    segments = np.frombuffer(b"".join((x * (length // max(1, len(x)) + 1))[:length] for _, x in found), np.uint8).reshape(-1, length)
    return train(languages, np.array([k for k, _ in found], int), segments)


def predict(docs: DataFrame, network: Network, keep: list[str] = ["doc_id"]) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, the mean probability of that language over all bytes of the text.

    A text that is null or has no letters gets ``und`` and score 0, as does every text when nothing was learned. Ties go
    to the first language by name. Repeated rows are each predicted; an empty table gives an empty result.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language_id")
        for piece in slices(batches, 1 << 20):
            texts = strings(piece.column("text"))
            lettered = [bool(LETTER.search(t)) for t in texts]
            mean = network.documents([t.encode() if has else b"" for t, has in zip(texts, lettered)])
            sure = [bool(network.languages) and has for has in lettered]
            best = mean.argmax(axis=1) if network.languages else np.zeros(len(texts), int)
            said = [network.languages[k] if ok else UNDECIDED for k, ok in zip(best.tolist(), sure)]
            score = [min(1.0, float(mean[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best.tolist(), sure))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(said, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    text = [] if "text" in keep else ["text"]
    return docs.select(*keep, *text).mapInArrow(label, schema + ", lang_pred string, score double")
