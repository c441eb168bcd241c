"""Token counts of a unigram vocabulary by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton finds all pieces of the vocabulary in a text. For each end the pass keeps the best score and
the number of tokens that reach it, no path. Ties go as in the tokenizers themselves, which try starts from left to
right and replace a path only by a strictly better one: of equal scores the one with the longest last piece stays.
Scores are rounded to multiples of 2^-20, so sums are exact in whatever order and a text may be cut at word starts,
which no piece spans, and words be remembered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices, strings

SPACE = "▁"
GRID = 2.0**20
PENALTY = 10.0


def rounded(score: float) -> float:
    return round(score * GRID) / GRID


class Counter(dict):
    """Tokens and bytes of unknown characters of a stretch of text, remembered up to ``limit`` stretches of ``longest``.

    A character that no piece of its length covers costs the least score less ``PENALTY`` and counts as its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float], limit: int = 400_000, longest: int = 64):
        super().__init__()
        scores = {p: rounded(s) for p, s in scores.items() if p}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton() if scores else None
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = rounded(min(scores.values(), default=0.0) - PENALTY)
        self.empty = not scores
        spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.cut = re.compile("(?s).+" if spans else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.limit, self.longest = limit, longest

    def viterbi(self, text: str) -> tuple[int, int]:
        n = len(text)
        best, tokens, strange = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in () if self.empty else self.automaton.iter(text):
            ends[end].append(piece)
        for i, c in enumerate(text):
            top, last, to = -math.inf, 0, i + 1
            for size, score in ends[i]:
                score += best[to - size]
                if score > top or score == top and size > last:
                    top, last = score, size
            if c not in self.single and best[i] + self.unknown > top:
                size = len(c.encode("utf-8", "surrogatepass"))
                best[to], tokens[to], strange[to] = best[i] + self.unknown, tokens[i] + size, strange[i] + size
            else:
                best[to], tokens[to], strange[to] = top, tokens[to - last] + 1, strange[to - last]
        return tokens[n], strange[n]

    def __missing__(self, text: str) -> tuple[int, int]:
        value = self.viterbi(text)
        if len(text) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[text] = value
        return value

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a whole text and how many of them are single bytes; spaces are marked and one is put in front."""
        if not text:
            return 0, 0
        found = [self[x] for x in self.cut.findall(SPACE + text.replace(" ", SPACE))]
        return sum(a for a, _ in found), sum(b for _, b in found)


def vocabulary(model_file: str) -> dict[str, float]:
    """Pieces of a public model with unigram log-probabilities by rank: the r-th of n pieces has 1 / (r (1 + ... + 1/n))."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = [model.id_to_piece(i) for i in sorted(plain, key=lambda i: (-model.get_score(i), i))]
    whole = math.log(sum(1 / r for r in range(1, len(ranked) + 1))) if ranked else 0.0
    return {p: -math.log(r) - whole for r, p in enumerate(ranked, 1)}


@lru_cache(maxsize=4)
def counter(model_file: str) -> Counter:
    return Counter(vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens) of each whole text; ``model_file`` must be readable at that path on every executor.

    Null and empty texts have no tokens. Repeated rows are each counted, other columns are ignored, an empty table gives
    an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for piece in slices(batches):
            tokens, strange = zip(*map(own.count, strings(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(strange, pa.int64())], ["doc_id", "n_tokens", "n_byte_tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id long, n_tokens long, n_byte_tokens long")
