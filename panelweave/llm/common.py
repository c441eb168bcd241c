"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import shared_folder

#: Words of the contracts: runs of anything but space and \t \n \v \f \r. ``bytes.split()`` cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_table(df: DataFrame, name: str = "kept", path: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder, or to a ``path`` there, and read it back: later steps survive lost executors."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: By step, how to forget what it remembers in this Python worker from task to task.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def begin(step: str, forget: Callable[[], None] | None = None) -> None:
    """To be called where a task of ``step`` begins in a Python worker; ``forget`` drops what the step remembers there.

    Spark hands workers on from step to step, so without this a worker would hold what every step before has remembered.
    """
    for other in [x for x in _REMEMBERED if x != step]:
        _REMEMBERED.pop(other)()
    pa.default_memory_pool().release_unused()
    if forget:
        _REMEMBERED[step] = forget


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts; null is empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece hold about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def thinned(rows: DataFrame, draw: str, known: int, most: int) -> DataFrame:
    """About ``most`` of ``known`` rows, by their hash ``draw``: what a bounded sample is then ordered from.

    Without it every partition would send its own ``limit`` rows to the driver.
    """
    return rows.where(F.pmod(F.col(draw), F.lit(max(1, known // most))) == 0)


class WordHashes(dict):
    """Two 64-bit hashes of a word, remembered; forgets all beyond ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_arrays(texts: list[bytes], hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all their hashes in one array, and the index of the text of each."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    return words, flat, np.repeat(np.arange(len(texts)), counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(flat: np.ndarray, owner: np.ndarray, width: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that stays in one text, and the index of its first word."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(factor)
        total += flat[k : k + n]
    starts = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mixed(total[starts]), starts


def planes(values: np.ndarray) -> bytes:
    """Rising uint32 values as differences, byte by byte: the high bytes are mostly zero and compress away."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64)
