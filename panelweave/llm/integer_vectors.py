"""Vectors as exact integers, and what codebooks and clusterings over them share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import kept_table

LONG_MOST = 2**63 - 1


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds neither nulls, NaN nor infinities."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & good)


def magnitude(width: int) -> int:
    """Largest component so that the squared distance of two vectors of ``width`` fits into a long: 2^27 for 64."""
    return min(2**31 - 1, int((2**62 / max(width, 1)) ** 0.5) // 2)


def integer_rows(vectors: DataFrame, scale: int, width: int, keep: tuple[str, ...] = (), column: str = "embedding") -> DataFrame:
    """(vec_id long, columns of ``keep``, ints binary): floor(scale * x) of every component as 32-bit integers.

    Shorter vectors are filled up with zeros to ``width``; components beyond ``magnitude(width)`` are held there, since
    their squared distances would not fit into a long. Rows come from ``finite``.
    """
    most = magnitude(width)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_vector")
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale)), -most, most).astype("<i4")
            flat = np.zeros((batch.num_rows, width), "<i4")
            flat[np.arange(width) < sizes[:, None]] = values
            ints = pa.array([row.tobytes() for row in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", *keep)], ints], names=["vec_id", *keep, "ints"])

    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.col(column).cast("array<double>").alias("_vector"))
    kinds = dict(asked.dtypes)
    return asked.mapInArrow(turned, ", ".join(["vec_id long", *[f"`{c}` {kinds[c]}" for c in keep], "ints binary"]))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Packed integers of a batch as rows of 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def slot_sums(told: DataFrame, slots: int) -> np.ndarray:
    """Totals by slot of (slot, total) rows, as many as the model has numbers."""
    out = np.zeros(slots, np.int64)
    for slot, total in told.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[slot] = total
    return out


def stored(vectors: DataFrame, scale: int, width: int, keep: tuple[str, ...], name: str) -> DataFrame:
    """``integer_rows`` written to the shared folder: each round of a fit reads it again."""
    return kept_table(integer_rows(vectors, scale, width, keep), name)
