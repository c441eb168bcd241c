"""Byte-level BPE: texts to token ids and back, by a rank file.

A text is cut by the vocabulary's pattern and each match is merged by itself. Matches already met are looked up. All
others of some texts go through one queue side by side: adjacent pairs wait in one bucket per merge rank; a bitmap of two
levels (words of ranks, and the words that hold any) finds the lowest filled bucket by find-first-set, and the bucket is
worked off from left to right. So n bytes take about n log n steps however long a match is, where scanning for the best
pair takes n squared. Buckets hold positions of a linked list; a position whose pair has changed since is stale and
skipped. Should a merge make a pair of lower rank than its own, the rest of the bucket waits until that is done.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import begin, slices, strings

WORD_BITS = 8
BIT = [1 << i for i in range(1 << WORD_BITS)]
ID = np.dtype("<i4")
#: Matches that share a queue: some MB of lists.
AT_ONCE = 20_000


class Codec:
    """Encoder and decoder for ``ranks`` (token bytes to id; the id is the merge rank) and a splitting ``pattern``.

    ``remembered`` bounds the matches looked up, which are kept in a newer and an older half; ``longest`` is the length
    from which a match is not remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 600_000, longest: int = 64):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.split = regex.compile(pattern).findall
        self.half, self.longest = remembered // 2, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.passing: list[str] = []
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def merge(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of each match. All matches share one queue: they lie one after another, and no pair reaches over a border."""
        get = self.ranks.get
        out = [ID.type(whole).tobytes() if (whole := get(m)) is not None else None for m in matches]
        open_ = [m for m, ids in zip(matches, out) if ids is None]
        data, n = b"".join(open_), sum(map(len, open_))
        border = np.cumsum([0, *map(len, open_)])
        until = np.repeat(border[1:], np.diff(border)).tolist()
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = border.tolist()
        for at in ends[:-1]:
            before[at] = -1
        codes = np.frombuffer(data, np.uint8)
        pairs = np.full(n, -1, np.int64)
        pairs[:-1] = self.byte_pairs[codes[:-1], codes[1:]] if n else 0
        pairs[border[1:] - 1] = -1
        live = pairs.tolist()
        order = np.argsort(pairs, kind="stable")
        ranks, starts = np.unique(pairs[order], return_index=True)
        buckets = {r: part.tolist() for r, part in zip(ranks.tolist(), np.split(order, starts[1:])) if r >= 0}
        words: dict[int, int] = {}
        for rank in buckets:
            words[rank >> WORD_BITS] = words.get(rank >> WORD_BITS, 0) | BIT[rank & 255]
        top = sum(map(BIT.__getitem__, words))

        while top:
            word = (top & -top).bit_length() - 1
            low = words[word] & -words[word]
            rank = word << WORD_BITS | low.bit_length() - 1
            bucket = buckets.pop(rank)
            words[word] ^= low
            if not words[word]:
                top ^= 1 << word
            bucket.sort()
            waiting = iter(bucket)
            for i in waiting:
                if live[i] != rank:
                    continue
                gone = end[i]
                end[i] = stop = end[gone]
                live[gone] = made = other = -1
                if stop < until[i]:
                    before[stop] = i
                    if (made := get(data[i : end[stop]], -1)) >= 0:
                        if (queue := buckets.get(made)) is not None:
                            queue.append(i)
                        else:
                            buckets[made] = [i]
                            words[made >> WORD_BITS] = words.get(made >> WORD_BITS, 0) | BIT[made & 255]
                            top |= 1 << (made >> WORD_BITS)
                live[i] = made
                if (left := before[i]) >= 0:
                    if (other := get(data[left:stop], -1)) >= 0:
                        if (queue := buckets.get(other)) is not None:
                            queue.append(left)
                        else:
                            buckets[other] = [left]
                            words[other >> WORD_BITS] = words.get(other >> WORD_BITS, 0) | BIT[other & 255]
                            top |= 1 << (other >> WORD_BITS)
                    live[left] = other
                if 0 <= made < rank or 0 <= other < rank:  # a lower pair goes first; the rest of this rank waits
                    if rest := [*waiting, *buckets.pop(rank, [])]:
                        buckets[rank] = rest
                        words[word] = words.get(word, 0) | low
                        top |= 1 << word
        found, counts, at = [], [], 0
        for stop in ends[1:]:
            size = len(found)
            while at < stop:
                found.append(get(data[at : end[at]]))
                at = end[at]
            counts.append(len(found) - size)
        packed = np.array(found, ID).tobytes()
        cuts = (np.cumsum([0, *counts]) * ID.itemsize).tolist()
        rest = map(packed.__getitem__, map(slice, cuts, cuts[1:]))
        return [next(rest) if x is None else x for x in out]

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The matches of each text; the ids of all of them can then be looked up in ``known``."""
        cut = [self.split(t) for t in texts]
        for m in self.passing:
            self.known.pop(m, None)
        if len(self.known) >= self.half:
            self.known, self.older = {}, self.known
        missing = set(chain.from_iterable(cut)).difference(self.known)
        fresh = []
        for m in missing:
            if (ids := self.older.get(m)) is None:
                fresh.append(m)
            else:
                self.known[m] = ids
        for at in range(0, len(fresh), AT_ONCE):
            some = fresh[at : at + AT_ONCE]
            self.known.update(zip(some, self.merge([m.encode() for m in some])))
        self.passing = [m for m in missing if len(m) > self.longest]
        return cut

    def ids(self, cut: list[str]) -> list[int]:
        return np.frombuffer(b"".join(map(self.known.__getitem__, cut)), ID).tolist()

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return map(self.ids, self.cut(texts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file (lines of base64 token and rank), read once per Python worker."""
    with open(rank_file, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids of each whole text, strings of special tokens being ordinary text.

    ``exact`` says whether the ids decode to the text's bytes again.

    ``rank_file`` must be readable at that path on every executor. A null text is encoded as an empty one and gives no
    ids. Repeated rows are each returned, other columns are ignored, an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe", codec.cache_clear)
        encoder = codec(rank_file, pattern)
        for piece in slices(batches):
            texts = strings(piece.column("text"))
            ids = list(encoder.encode(texts))
            exact = [encoder.decode(i) == t.encode() for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "exact"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode_documents(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that ``ids`` stand for; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe", codec.cache_clear)
        decoder = codec(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                data = [decoder.decode(ids or []) for ids in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, data binary")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both, text by text."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("byte_bpe", codec.cache_clear)
        own = codec(rank_file, pattern)
        for piece in slices(batches):
            rows = []
            for ids in own.encode(strings(piece.column("text"))):
                rows.append((len(ids), hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
