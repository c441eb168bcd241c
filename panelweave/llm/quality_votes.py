"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Every rule looks at counts of one document and says good (1), bad (-1) or nothing (0). Documents of the same votes count
as one, so the fit works on a table of at most 3 to the number of rules rows (6,561 for eight), whatever the corpus.
The fit finds how often each rule says what of good and of bad documents, and how many documents are good; a document's
posterior probability then weighs all its votes, so one unreliable rule does not reject it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WordHashes, kept_table, slices, strings, window_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_distinct"]
#: P(bad, none, good) of a rule's vote before any data: for good documents, for bad ones.
BELIEF = ((0.003, 0.197, 0.8), (0.1, 0.14, 0.76))


def _counts(text: str, words: list[bytes], data: bytes) -> tuple[int, ...]:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        0,
        len(lines),
        len(data) - len(data.translate(None, LETTERS)),
        len(data) - len(data.translate(None, UPPER)),
        data.count(b"!") + data.count(b"?"),
        len(set(words)),
    )


def text_counts(docs: DataFrame, width: int = 8) -> DataFrame:
    """(doc_id, n_words, word_chars, ...): counts over each whole text; see ``COUNTS``. A null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece in slices(batches):
            texts = strings(piece.column("text"))
            datas = [t.encode() for t in texts]
            split = [d.split() for d in datas]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            owner = np.repeat(np.arange(len(texts)), sizes)
            flat = np.fromiter((hashes[w] for ws in split for w in ws), np.uint64, len(owner))
            found, starts = window_hashes(flat, owner, width, 0x9E3779B97F4A7C15)
            table = np.array([_counts(*x) for x in zip(texts, split, datas)], np.int64).reshape(-1, len(COUNTS))
            order = np.lexsort((found, owner[starts]))
            same = (found[order[1:]] == found[order[:-1]]) & (owner[starts[order[1:]]] == owner[starts[order[:-1]]])
            again = np.zeros(len(order), bool)
            again[order[1:]] |= same
            again[order[:-1]] |= same
            edges = np.zeros(len(owner) + 1, np.int64)
            np.add.at(edges, starts[again], 1)
            np.add.at(edges, starts[again] + width, -1)
            table[:, 4] = np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *map(pa.array, table.T)], ["doc_id", *COUNTS])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, Column]:
    """Name and vote of each rule, from the columns of ``text_counts``."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 50),
        "symbols": vote(10 * c("n_symbols") > c("n_words"), 100 * c("n_symbols") <= c("n_words")),
        "repeats": vote(4 * c("n_repeat_words") > c("n_words"), 20 * c("n_repeat_words") <= c("n_words")),
        "lines": vote(2 * c("n_dup_lines") > c("n_lines"), (c("n_lines") > 1) & (20 * c("n_dup_lines") <= c("n_lines"))),
        "word_size": vote((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), c("word_chars").between(3 * c("n_words"), 10 * c("n_words"))),
        "capitals": vote(10 * c("n_upper") > 3 * c("n_letters"), (c("n_letters") > 0) & (10 * c("n_upper") <= c("n_letters"))),
        "marks": vote(5 * c("n_marks") > c("n_words"), 20 * c("n_marks") <= c("n_words")),
        "variety": vote(10 * c("n_distinct") < F.sqrt(c("n_words").cast("double")) * 10, (c("n_words") > 0) & (c("n_distinct") >= 4 * F.sqrt(c("n_words").cast("double")))),
    }


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.5) -> tuple[float, np.ndarray]:
    """Share of good documents and P(vote | good), P(vote | bad) of each rule, as an array (rules, votes bad/none/good, 2).

    ``votes`` has a row for each pattern met. Starts from the belief that a document any rule calls bad is bad. A rule
    is taken to be no worse than chance: it calls bad documents bad at least as often as good ones, and good likewise.
    ``prior`` is the weight of ``BELIEF`` beside what is counted; without it the two classes may drift to another split
    of the corpus than by quality, such as short and long documents.
    """
    weight = counts / max(1.0, counts.sum())
    hits = [votes == v for v in (-1, 0, 1)]
    good = np.where(hits[0].any(axis=1), 0.03, 0.97)
    share, says = 0.9, np.full((votes.shape[1], 3, 2), 1 / 3)
    for _ in range(rounds):
        share = min(max(float((weight * good).sum()), 0.2), 0.8)
        for k, belief in enumerate((weight * good, weight * (1 - good))):
            seen = np.stack([belief @ h for h in hits], axis=1) + 1e-9
            says[:, :, k] = (1 - prior) * seen / seen.sum(axis=1, keepdims=True) + prior * np.array(BELIEF[k])
        says[:, 0, 1] = np.maximum(says[:, 0, 1], says[:, 0, 0])
        says[:, 2, 1] = np.minimum(says[:, 2, 1], says[:, 2, 0])
        ratio = np.log(says[:, :, 0] / says[:, :, 1])
        odds = np.log(share / (1 - share)) + sum(h @ ratio[:, v] for v, h in enumerate(hits))
        good = 1 / (1 + np.exp(-odds.clip(-60, 60)))
    return share, says


def judge(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Counts of each document with ``base_failed``, ``posterior`` (probability of good quality) and ``kept``.

    A document is kept if it passes the base and its posterior is ``at_least``; the fit looks at those that pass the base. Null and empty texts have no words and
    fail the base. Repeated rows are each judged, other columns are ignored; an empty table gives an empty result.
    """
    found = rules()
    table = kept_table(text_counts(docs).withColumns({f"vote_{k}": v for k, v in found.items()}), "votes")
    names = [f"vote_{k}" for k in found]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = table.where(~failed).groupBy(*names).count().collect()  # at most 3 ** len(names) rows
    votes = np.array([r[:-1] for r in patterns], np.int8).reshape(-1, len(names))
    share, says = fit(votes, np.array([r[-1] for r in patterns], float))
    odds = F.lit(float(np.log(share / (1 - share))))
    for name, (bad, none, good) in zip(names, np.log(says[:, :, 0] / says[:, :, 1]).tolist()):
        odds += F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    judged = table.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= at_least))
