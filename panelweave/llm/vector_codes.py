"""Vectors as short codes: per part of a vector the number of its nearest codebook entry, exact in integers.

Distances come from matrix products in float64. Integers are broken into limbs of so few bits that every product of
limbs, summed over a part, stays below 2^53 and so is exact; the products are put together in int64 and the first
smallest distance wins. The codebooks are the only thing the driver holds: 4 x 256 entries, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import kept_table
from panelweave.llm.integer_vectors import LONG_MOST, finite, matrix, slot_sums, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
EXACT_BITS = 53
PIECE = 4096


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs, lowest first: all but the last lie in [0, 2^bits), the last carries the sign."""
    out = []
    while np.abs(values).max(initial=0) >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray, exact_bits: int = EXACT_BITS) -> np.ndarray:
    """x @ c.T of integers, exact: limb products below 2^exact_bits each, shifted and summed in int64."""
    bits = max(1, (exact_bits - int(x.shape[1]).bit_length()) // 2)
    total = np.zeros((len(x), len(c)), np.int64)
    for i, low in enumerate(limbs(x, bits)):
        for j, high in enumerate(limbs(c, bits)):
            total += (low @ high.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``c`` for each row of ``x``, the first of equals, and its squared distance."""
    reach = (c * c).sum(axis=1) - 2 * exact_products(x, c)
    best = reach.argmin(axis=1)
    return best, reach[np.arange(len(x)), best] + (x * x).sum(axis=1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            yield batch.slice(start, PIECE)


def _first_entries(rows: DataFrame, entries: int, width: int) -> np.ndarray:
    """[part, entry, position]: the parts of the vectors of smallest id; rows of one id by their integers, no id last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    ints = np.frombuffer(b"".join(bytes(r.ints) for r in first), "<i4").reshape(-1, PARTS, width // PARTS)
    return ints.transpose(1, 0, 2).astype(np.int64)


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, unused ones as before."""
    parts, entries, size = books.shape
    counted = size + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, counted), np.int64)
        for batch in _pieces(batches):
            x = matrix(batch.column("ints"), parts * size).reshape(-1, parts, size)
            for p in range(parts):
                best, _ = nearest(x[:, p], books[p])
                order = np.argsort(best, kind="stable")
                used, starts, n = np.unique(best[order], return_index=True, return_counts=True)
                if len(used):
                    total[p, used, :size] += np.add.reduceat(x[order, p], starts, axis=0)
                    total[p, used, size] += n
        flat = total.ravel()
        told = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.int64()), pa.array(flat[told], pa.int64())], names=["slot", "total"])

    found = slot_sums(rows.select("ints").mapInArrow(sums, "slot long, total long"), parts * entries * counted).reshape(parts, entries, counted)
    n = found[..., size:]
    return np.where(n > 0, found[..., :size] // np.maximum(n, 1), books)


def learn_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = _first_entries(rows, entries, width)
    for _ in range(rounds if books.size else 0):
        books = _round(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances summed over the parts."""
    parts, _, size = books.shape

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x = matrix(batch.column("ints"), parts * size).reshape(-1, parts, size)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(told, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector is there and finite.

    Vectors of unequal length, or of one that four does not divide, are filled up with zeros. Rows of one id are each
    coded; rows without id count as of the largest id. With fewer rows than entries each row is an entry; an empty table
    gives an empty result. Components beyond ``magnitude`` are held there; a label's error is held at the largest long.
    """
    good = finite(vectors)
    longest = good.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    rows = stored(good, scale, width, ("label",), "vector_ints")
    books = learn_codebooks(rows, width, entries, rounds)
    coded = kept_table(encode(rows, books), "vector_codes")
    summed = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    by_label = kept_table(summed.select("_label", F.least("_sum", F.lit(LONG_MOST)).cast("long").alias("label_error")), "label_errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
