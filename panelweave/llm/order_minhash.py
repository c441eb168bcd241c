"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of word shingles, each labelled with its occurrence. A sketch takes the few labelled shingles
that a seeded hash makes smallest and keeps them in text order, so it is shared only by texts that hold them in the same
order. Texts that share a sketch are candidates. Of few shingles the smallest are no sample, so short texts are found by
exact keys: their sequences with as many shingles left out as a partner of them may lack. Two texts are linked if a banded alignment of their shingle sequences
matches at least ``threshold`` of both together (matched / (both - matched), the order-keeping form of Jaccard).

Equal texts count as one. In each group of one sketch all members are first compared with the member that shares most
sketches; what is linked forms components. Members of other components than the group's largest are then held against
all of the group, in blocks, by an exact upper bound on the matches; pairs that could still reach the threshold are
aligned as well. So no group is cut short, none is expanded into all pairs, and links within a component are spared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WordHashes, begin, kept_table, mixed, slices, utf8, window_hashes
from panelweave.operators.rounds import components

BLOCK = 1024
GROUP = 256
#: Bytes of texts in one alignment group, shingles in one block of bounds, and values of one step of a sketch: long texts
#: make groups, blocks and steps smaller, whatever their number.
GROUP_BYTES = 4 << 20
BLOCK_SHINGLES = 1 << 19
STEP = 1 << 20
FEW = 50_000
#: Exact keys of one text at most: for threshold 0.8 texts of up to 13 shingles have them.
EXACT = 128
FACTOR = 0x9E3779B97F4A7C15


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the shingles in text order; a text of fewer words is one shingle, one without words has none."""
    words = text.split()
    flat = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return window_hashes(flat, np.zeros(len(flat), np.int8), min(width, max(1, len(flat))), FACTOR)[0]


def labelled(seq: np.ndarray) -> np.ndarray:
    """Each shingle with its number of earlier occurrences hashed in: a multiset as a set."""
    order = np.argsort(seq, kind="stable")
    ranked = seq[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(seq) else order
    occurrence = np.empty(len(seq), np.uint64)
    occurrence[order] = np.arange(len(seq)) - np.repeat(new, np.diff([*new, len(seq)]))
    return mixed(seq + occurrence * np.uint64(FACTOR))


def sketch_keys(marked: np.ndarray, minima: int, salts: np.ndarray) -> np.ndarray:
    """One key per salt: the ``minima`` smallest shingles under it, hashed in text order."""
    take = min(minima, len(marked))
    if (some := max(1, STEP // len(marked))) < len(salts):
        return np.concatenate([sketch_keys(marked, minima, salts[at : at + some]) for at in range(0, len(salts), some)])
    x = mixed(marked[None, :] ^ salts[:, None])
    least = np.sort(np.argpartition(x, take - 1, axis=1)[:, :take], axis=1) if take < len(marked) else np.broadcast_to(np.arange(take), (len(salts), take))
    keys = salts.copy()
    for k in range(take):
        keys = mixed(keys * np.uint64(FACTOR) + marked[least[:, k]])
    return keys


@lru_cache
def exact_plan(n: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """(left out, fewest left out) of the exact keys of ``n`` shingles.

    Two texts that share m shingles in order and leave out d and e of theirs are linked if d + e is at most
    m (1 - threshold) / threshold. They meet in the key of the m shingles and of the smaller of d and e; who leaves out
    just that many is a centre there, and is linked to everybody else of that key.
    """
    plan = []
    for out in range(int(n * (1 - threshold) + 1e-9) + 1):
        both = int((n - out) * (1 - threshold) / threshold + 1e-9)
        plan += [(out, least) for least in range(out + 1) if out + least <= both]
    return tuple(plan)


@lru_cache
def exact_limit(threshold: float) -> int:
    """Texts of so many shingles have exact keys: all up to the first number that would need more than ``EXACT``."""
    n = 0
    while n < 2 * EXACT and sum(comb(n + 1, out) for out, _ in exact_plan(n + 1, threshold)) <= EXACT:
        n += 1
    return n


@lru_cache
def _left_in(n: int, out: int) -> np.ndarray:
    return np.array(list(combinations(range(n), n - out)), np.int64).reshape(-1, n - out)


def exact_keys(seq: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Keys of a short text: those whose centre it is, and the others."""
    centre, others = [], []
    for out, least in exact_plan(len(seq), threshold):
        chosen = seq[_left_in(len(seq), out)]
        keys = np.full(len(chosen), least + 1, np.uint64)
        for k in range(chosen.shape[1]):
            keys = mixed(keys * np.uint64(FACTOR) + chosen[:, k])
        (centre if out == least else others).extend(keys.view(np.int64).tolist())
    return centre, others


def needed(threshold: float, n1: int | np.ndarray, n2: int | np.ndarray) -> int | np.ndarray:
    """Matches that two sequences must reach; a hair below, against rounding."""
    return threshold / (1 + threshold) * (n1 + n2) - 1e-9


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence within ``band`` diagonals of the main one, all of a row at once as bits of one number."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, window = (1 << len(a)) - 1, (1 << 2 * band + 1) - 1
    row = full
    for j, y in enumerate(b):
        if hit := places.get(y, 0):
            hit &= window << j - band if j > band else window >> band - j
            met = row & hit
            row = ((row + met) | (row - met)) & full
    return head + tail + len(a) - row.bit_count()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, minima: int = 5, sketches: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; a class is named by its smallest doc_id.

    Classes are the components of links, equal texts being linked always. Pairs of texts of up to 13 shingles are all
    found by exact keys (for threshold 0.8, see ``exact_limit``). Of other pairs, one with m of u shingles in common
    shares a sketch with probability 1 - (1 - C(m, minima) / C(u, minima))^sketches, which is about
    1 - (1 - s^minima)^sketches for long texts of similarity s: 0.9999 for 0.8 and the defaults, and 0.9994 for the least
    of them, 12 of 15. Null texts are empty; empty texts
    are equal to each other. A null id belongs to the class of its text and names it only if all its ids are null.
    Repeated rows are each returned, other columns are ignored, an empty table gives an empty result.
    """
    return near_classes(docs, width, threshold, minima, sketches, seed).select("doc_id", "class_id")


def digest(text: str) -> Column:
    """What stands for the text of a column; null is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def near_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, minima: int = 5, sketches: int = 24, seed: int = 11) -> DataFrame:
    """(doc_id, node, component, class_id) as ``near_duplicates``: ``node`` is the ``digest`` of the text, ``component``
    tells classes apart whose ``class_id`` is the same or null."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    salts = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(FACTOR) + np.uint64(seed))
    short = exact_limit(threshold)
    needs_sketch = threshold * (short + 1) - 1e-9  # below, no text without exact keys can be near enough

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("order_minhash")
        hashes = WordHashes()
        for piece in slices(batches):
            rows = []
            for text in utf8(piece.column("text")):
                plain = shingles(text, width, hashes)
                seq = labelled(plain)
                keys, others = exact_keys(plain, threshold) if 0 < len(seq) <= short else ([], [])
                if len(seq) and len(seq) >= needs_sketch:
                    keys = keys + sketch_keys(seq, minima, salts).view(np.int64).tolist()
                rows.append((hashlib.md5(text).digest(), keys, others, len(seq), len(text), np.sort((seq >> np.uint64(48)).astype("<u2")).tobytes()))
            node, keys, others, n, size, bins = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(size, pa.int64()), pa.array(bins, pa.binary())],
                ["doc_id", "node", "keys", "others", "n", "bytes", "bins"],
            )

    marks = kept_table(chosen.mapInArrow(mark, "doc_id long, node binary, keys array<long>, others array<long>, n int, bytes long, bins binary"), "marks")
    texts = chosen.select(digest("text").alias("node"), "text")
    told = lambda keys, centre: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(centre).alias("centre")))
    held = marks.select(F.explode(F.concat(told("keys", True), told("others", False))).alias("at"), "node", "n", "bytes").select("at.key", "at.centre", "node", "n", "bytes").distinct()
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("centre").alias("_led")).where("size > 1 and _led").drop("_led")
    groups = kept_table(held.join(shared, "key"), "groups")
    parts = components(kept_table(_verified(_with_lead(groups), texts, width, threshold), "links"))
    second = kept_table(_left_over(groups, parts, marks, threshold), "pairs")
    if not second.isEmpty():
        found = _verified(second, texts, width, threshold)
        parts = components(found.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    lowest = marks.groupBy("node").agg(F.min("doc_id").alias("lowest")).join(parts.withColumnRenamed("id", "node"), "node", "left")
    lowest = lowest.withColumn("component", F.coalesce("component", "node"))
    named = lowest.join(lowest.groupBy("component").agg(F.min("lowest").alias("class_id")), "component")
    return marks.select("doc_id", "node").join(named.select("node", "component", "class_id"), "node").select("doc_id", "node", "component", "class_id")


def _with_lead(groups: DataFrame) -> DataFrame:
    """(a, b, bytes): every member of a group, and its length, with the member, a centre, that has most company in all its groups."""
    company = groups.groupBy("node").agg(F.sum("size").alias("company"))
    leads = groups.join(company, "node").groupBy("key").agg(F.max(F.struct("centre", "company", "node")).alias("lead"))
    return groups.join(leads.select("key", F.col("lead.node").alias("a")), "key").where("a <> node").select("a", F.col("node").alias("b"), "bytes").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of (a, b, bytes) whose alignment reaches the threshold; texts meet at ``a``, some hundred or some megabytes to a task group."""
    pairs = kept_table(pairs, "tested")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if wanted.count() <= FEW:  # 16 bytes each: below 1 MB
        own = texts.join(F.broadcast(wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    else:
        own = texts.groupBy("node").agg(F.first("text").alias("text"))
    often = F.greatest(F.count(F.lit(1)) / GROUP, F.sum("bytes") / GROUP_BYTES)
    sides = pairs.groupBy("a").agg(F.ceil(often).alias("parts"))
    seconds = pairs.join(sides, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"))
    firsts = sides.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))

    def align(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        lead = key[0].as_py()
        nodes, data = table.column("node").to_pylist(), utf8(table.column("text"))
        one = shingles(data[nodes.index(lead)], width, hashes)
        known = np.sort(labelled(one))
        good = []
        for node, text in zip(nodes, data):
            if node == lead:
                continue
            two = shingles(text, width, hashes)
            enough = needed(threshold, len(one), len(two))
            if min(len(one), len(two)) < enough:
                continue
            other = labelled(two)
            met = known[np.minimum(np.searchsorted(known, other), len(known) - 1)] == other
            if met.sum() >= enough and aligned(one, two, int(len(one) + len(two) - 2 * enough) + 1) >= enough:
                good.append(node)
        return pa.table({"a": pa.array([lead] * len(good), pa.binary()), "b": pa.array(good, pa.binary())})

    return seconds.unionByName(firsts).join(own, "node").groupBy("a", "part").applyInArrow(align, "a binary, b binary")


def _left_over(groups: DataFrame, parts: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, bytes of b): pairs of one group but different components that could reach the threshold by an upper bound on matches.

    The bound counts 16 bits of each labelled shingle with their multiplicity, so it is never too low.
    """
    placed = groups.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_long"))
    open_ = sizes.groupBy("key").agg(
        F.sum("_n").alias("size"), F.sum("_long").alias("long"), F.count(F.lit(1)).alias("_parts"), F.max(F.struct("_n", "component", "_long")).alias("main")
    ).where("_parts > 1")
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES))
    left = blocks(F.col("size") - F.col("main._n"), F.col("long") - F.col("main._long"))
    open_ = open_.select("key", F.col("main.component").alias("main"), blocks(F.col("size"), F.col("long")).alias("n_all"), left.alias("n_left"))
    bins = marks.groupBy("node").agg(F.first("bins").alias("bins"))
    rows = placed.drop("size").join(open_, "key").join(bins, "node").withColumn("aside", F.col("component") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda asks, i, j: F.struct(F.lit(asks).alias("asks"), i.alias("i"), j.alias("j"))
    asked = F.when(F.col("aside"), F.transform(every(F.col("n_all")), lambda j: place(True, own(F.col("n_left")), j)))
    held = F.transform(every(F.col("n_left")), lambda i: place(False, i, own(F.col("n_all"))))
    places = F.concat(held, F.coalesce(asked, F.slice(held, 1, 0)))
    dealt = rows.select("key", "node", "component", "n", "bytes", "bins", "aside", F.explode(places).alias("place"))

    def bound(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, part, long = (table.column(c).to_pylist() for c in ("node", "component", "bytes"))
        aside, n = table.column("aside").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        codes = [_codes(x) for x in table.column("bins").to_pylist()]
        them = np.flatnonzero(~asks)
        if not len(them):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "bytes": pa.array([], pa.int64())})
        number = {p: k for k, p in enumerate(dict.fromkeys(part))}
        of = np.array([number[p] for p in part])
        every = np.concatenate([codes[k] for k in them])
        whose = np.repeat(np.arange(len(them)), [len(codes[k]) for k in them])
        order = np.argsort(every, kind="stable")
        every, whose = every[order], whose[order]
        left, right, size_of = [], [], []
        for q in np.flatnonzero(asks):
            a, b = np.searchsorted(every, codes[q], "left"), np.searchsorted(every, codes[q], "right")
            size = b - a
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            most = np.bincount(whose[at], minlength=len(them))
            fit = (most >= needed(threshold, n[q], n[them])) & (of[them] != of[q])
            for k in them[np.flatnonzero(fit)].tolist():
                if not aside[k] or node[q] < node[k]:
                    left.append(node[q])
                    right.append(node[k])
                    size_of.append(long[k])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary()), "bytes": pa.array(size_of, pa.int64())})

    found = dealt.select("*", "place.*").drop("place").groupBy("key", "i", "j")
    return found.applyInArrow(_hintless(bound), "a binary, b binary, bytes long").distinct()


def _hintless(fn):
    return lambda table: fn(table)


def _codes(bins: bytes) -> np.ndarray:
    """Sorted 16-bit values, each repeat made distinct by its occurrence."""
    values = np.frombuffer(bins, "<u2").astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else values
    return values + ((np.arange(len(values)) - np.repeat(new, np.diff([*new, len(values)]))) << 16)
