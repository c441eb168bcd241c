"""Removal of word windows that also start in an earlier document.

Documents are dealt into chunks. Each chunk draws a count-min sketch of its windows and sends it, cut into hash ranges
(slices), as sorted cells. A slice adds the sketches of all chunks and answers each chunk with one bit per cell: is the
merged count two or more? A window whose cells all say so is estimated repeated; since counts are only ever too high,
no repeated window is lost. The second pass sends those windows alone, with their smallest document, to be grouped
exactly, and answers with the windows that start in a smaller document elsewhere. Texts are shuffled once, for their
chunk; nothing is broadcast, and no slice or chunk grows with the corpus.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import NO_ID, WordHashes, from_planes, mixed, planes, utf8, window_hashes, word_arrays

DEPTH = 2
CELLS_PER_WINDOW = 8
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Layout:
    """Sizes of chunks, slices and sketches for a corpus of about ``windows`` windows."""

    def __init__(self, windows: int, chunk: int, piece: int):
        # Beyond some 10^10 windows both grow with the root of the corpus, so that a chunk still sends each slice a packed run.
        scale = max(1.0, math.sqrt(32 * windows / (chunk * piece)))
        self.chunks = max(1, math.ceil(windows / (chunk * scale)))
        self.slices = max(1, math.ceil(windows / (piece * scale)))
        self.width = 1 << math.ceil(math.log2(piece * scale * CELLS_PER_WINDOW))

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)) % np.uint64(self.slices)

    def cells(self, h: np.ndarray) -> np.ndarray:
        """(DEPTH, n): slice, row and cell of each window as one number."""
        base = self.slice_of(h) * np.uint64(DEPTH)
        width, salted = np.uint64(self.width), h
        rows = []
        for row in range(DEPTH):
            rows.append((base + np.uint64(row)) * width + (salted & (width - np.uint64(1))))
            salted = mixed(salted + np.uint64(FACTORS[0]))
        return np.stack(rows)


class Windows:
    """Words and windows of the documents of one chunk."""

    def __init__(self, table: pa.Table, width: int, hashes: WordHashes):
        self.ids = table.column("doc_id")
        self.order = self.ids.fill_null(NO_ID).to_numpy()
        self.words, flat, self.owner = word_arrays(utf8(table.column("text")), hashes)
        self.first, self.starts = window_hashes(flat, self.owner, width, FACTORS[0])
        self.second, _ = window_hashes(flat, self.owner, width, FACTORS[1])
        self.docs = self.order[self.owner[self.starts]]

    def groups(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the picked windows by hash, the start of each group in it, and each group's smallest document."""
        one, two, doc = self.first[pick], self.second[pick], self.docs[pick]
        order = np.argsort(one, kind="stable")
        same = one[order[1:]] == one[order[:-1]]
        if np.any(same & (two[order[1:]] != two[order[:-1]])):
            order = np.lexsort((two, one))
            same = one[order[1:]] == one[order[:-1]]
        same &= two[order[1:]] == two[order[:-1]]
        begins = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.empty(0, np.int64)
        lowest = np.minimum.reduceat(doc[order], begins) if len(order) else doc
        return order, begins, lowest


def _cut(codes: np.ndarray, layout: Layout):
    """Unique cells of a chunk by slice: (slice, from, to) of the runs in ``codes``."""
    of = codes // np.uint64(DEPTH * layout.width)
    begins = np.flatnonzero(np.diff(of, prepend=np.uint64(2**63)))
    return zip(of[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(codes)])


def remove_repeats(docs: DataFrame, width: int = 13, chunk_windows: int = 1 << 18, slice_windows: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): words left once windows that start in a smaller document are taken out.

    A window is ``width`` consecutive words of one document, judged on the input. Null texts have no words; null ids
    count as larger than any other and as equal to each other; rows of one id never remove each other's words; repeated
    rows are each returned. Texts shorter than a window keep all words. Other columns are ignored. An empty table gives
    an empty result. Windows are compared by 128 bits of hash in a chunk and 96 bits across chunks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(octets // 6, chunk_windows, slice_windows)
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.chunks))).repartition("chunk")
    hashes = WordHashes()

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        windows = Windows(table, width, hashes)
        codes, counts = np.unique(layout.cells(windows.first), return_counts=True)
        rows = []
        for of, a, b in _cut(codes, layout):
            local = (codes[a:b] - np.uint64(of * DEPTH * layout.width)).astype(np.uint32)
            rows.append((of, planes(local), np.packbits(counts[a:b] > 1).tobytes()))
        out = list(zip(*rows)) or [[], [], []]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "slice": pa.array(out[0], pa.int64()), "cells": pa.array(out[1], pa.binary()), "twice": pa.array(out[2], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(DEPTH * layout.width, np.uint8)
        cells = table.column("cells").to_pylist()
        for data, twice in zip(cells, table.column("twice").to_pylist()):
            at = from_planes(data)
            counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)), 2)
        said = [np.packbits(counts[from_planes(data)] > 1).tobytes() for data in cells]
        return pa.table({"chunk": table.column("chunk"), "slice": table.column("slice"), "said": pa.array(said, pa.binary())})

    def suspects(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(table, width, hashes)
        cells = layout.cells(windows.first)
        codes, where = np.unique(cells, return_inverse=True)
        said = dict(zip(answers.column("slice").to_pylist(), answers.column("said").to_pylist()))
        repeated = np.zeros(len(codes), bool)
        for of, a, b in _cut(codes, layout):
            repeated[a:b] = np.unpackbits(np.frombuffer(said[of], np.uint8), count=b - a)
        pick = np.flatnonzero(repeated[where.reshape(cells.shape)].all(axis=0))
        order, begins, lowest = windows.groups(pick)
        heads = pick[order[begins]]
        one, two, of = windows.first[heads], windows.second[heads].astype(np.uint32), layout.slice_of(windows.first[heads])
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[by], prepend=np.uint64(2**63))).tolist()
        parts = [by[a:b] for a, b in zip(cuts, [*cuts[1:], len(by)])]
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int64()), "slice": pa.array([int(of[p[0]]) for p in parts], pa.int64()),
            "one": pa.array([one[p].tobytes() for p in parts], pa.binary()), "two": pa.array([two[p].tobytes() for p in parts], pa.binary()),
            "lowest": pa.array([lowest[p].view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts], pa.binary()),
        })

    def settle(table: pa.Table) -> pa.Table:
        ones = [np.frombuffer(x, np.uint64) for x in table.column("one").to_pylist()]
        sizes = [len(x) for x in ones]
        one = np.concatenate(ones)
        two = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("two").to_pylist()])
        low = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for x in table.column("lowest").to_pylist()])
        order = np.lexsort((low, two, one))
        o, t = one[order], two[order]
        begins = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]))
        least = np.empty_like(low)
        least[order] = np.repeat(low[order[begins]], np.diff([*begins, len(order)]))
        late, ends = least < low, np.cumsum(sizes)
        earlier = [one[b - n : b][late[b - n : b]].tobytes() for b, n in zip(ends, sizes)]
        return pa.table({"chunk": table.column("chunk"), "earlier": pa.array(earlier, pa.binary())})

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(table, width, hashes)
        order, begins, lowest = windows.groups(np.arange(len(windows.first)))
        local = np.empty(len(order), np.int64)
        local[order] = np.repeat(lowest, np.diff([*begins, len(order)]))
        elsewhere = np.frombuffer(b"".join(answers.column("earlier").to_pylist()), np.uint64)
        gone = (windows.docs > local) | np.isin(windows.first, elsewhere)
        edges = np.zeros(len(windows.owner) + 1, np.int64)
        np.add.at(edges, windows.starts[gone], 1)
        np.add.at(edges, windows.starts[gone] + width, -1)
        keep = np.cumsum(edges[:-1]) == 0
        ends = np.cumsum([len(w) for w in windows.words])
        kept, lost = [], []
        for words, end in zip(windows.words, ends):
            mask = keep[end - len(words) : end]
            kept.append(b" ".join(compress(words, mask.tolist())))
            lost.append(len(words) - int(mask.sum()))
        return pa.table({"doc_id": windows.ids, "n_words": pa.array(map(len, windows.words), pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    sketches = chunked.groupBy("chunk").applyInArrow(sketch, "chunk long, slice long, cells binary, twice binary")
    flags = sketches.groupBy("slice").applyInArrow(merge, "chunk long, slice long, said binary")
    asked = chunked.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(suspects, "chunk long, slice long, one binary, two binary, lowest binary")
    verdicts = asked.groupBy("slice").applyInArrow(settle, "chunk long, earlier binary")
    return chunked.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
