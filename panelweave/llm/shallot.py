"""Exact k-means over integer vectors by Shallot search.

A vector remembers its centroid, the second-nearest one, an upper bound on the distance to the first and a lower bound
on the distance to all others. Centroids that moved widen the bounds; while the upper one stays below the lower one, or
below half the way to the next centroid, nothing is computed. Otherwise the search starts from the closer of the two
remembered centroids and walks its neighbours outwards until they lie beyond the search ball, whose radius (own distance
plus second-best distance) shrinks with each better find. Bounds are floats with a margin and only rule out what is
farther for certain; what is left is compared by integer squared distance, then by number.

Each round is one pass: it writes the vectors with their state, and beside them each task's changes of the cluster sums.
The driver holds the centroids and their sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import remove
from panelweave.llm.integer_vectors import LONG_MOST, finite, integer_rows, matrix, slot_sums
from panelweave.session import shared_folder

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 40, 5, 256, 64, 2
PIECE = 4096
#: What float rounding may add to a bound: far above 2^-52 relative, far below any difference that saves work.
SLACK = 1e-9

STATE = "vec_id long, ints binary, cluster int, second int, upper double, lower double, distance long, slot long, total long, kind int"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Search:
    """Nearest and second-nearest of ``centroids`` for vectors with bounds from before the centroids moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        self.between = np.sqrt(np.stack([squared(centroids, c) for c in centroids]).astype(np.float64))
        self.ring = np.argsort(self.between + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        others = self.between + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
        self.half = others.min(axis=1) / 2
        moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        most = np.where(np.eye(k, dtype=bool), 0.0, self.moved[None, :])
        self.others_moved = most.max(axis=1)
        self.seen = 0

    def assign(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring the four state arrays up to date, in place."""
        upper += self.moved[first]
        lower -= self.others_moved[first]
        safe = np.maximum(lower, self.half[first]) * (1 - SLACK)
        asked = np.flatnonzero(~(upper * (1 + SLACK) < safe))
        if not len(asked):
            return
        own = squared(x[asked], self.c[first[asked]])
        self.seen += len(asked)
        upper[asked] = np.sqrt(own.astype(np.float64))
        open_ = ~(upper[asked] * (1 + SLACK) < safe[asked])
        asked, own = asked[open_], own[open_]
        if len(asked):
            self._walk(x, asked, own, first, second, upper, lower)

    def _walk(self, x, asked, own, first, second, upper, lower) -> None:
        xs, a, b = x[asked], first[asked].copy(), second[asked].copy()
        if len(self.c) == 1:
            upper[asked], lower[asked] = np.sqrt(own.astype(np.float64)), np.inf
            return
        da, db = own, squared(xs, self.c[b])
        swap = (db < da) | ((db == da) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        da, db = np.where(swap, db, da), np.where(swap, da, db)
        start, known = a.copy(), b.copy()
        near = np.sqrt(da.astype(np.float64))
        live = np.arange(len(asked))
        for rank in range(1, len(self.c)):
            j = self.ring[start[live], rank]
            ball = (near[live] + np.sqrt(db[live].astype(np.float64))) * (1 + SLACK)
            inside = ~(self.between[start[live], j] * (1 - SLACK) > ball)
            live, j = live[inside], j[inside]
            if not len(live):
                break
            new = j != known[live]
            at, j = live[new], j[new]
            d = squared(xs[at], self.c[j])
            self.seen += len(at)
            first_now = (d < da[at]) | ((d == da[at]) & (j < a[at]))
            second_now = ~first_now & ((d < db[at]) | ((d == db[at]) & (j < b[at])))
            up = at[first_now]
            b[up], db[up] = a[up], da[up]
            a[up], da[up] = j[first_now], d[first_now]
            to = at[second_now]
            b[to], db[to] = j[second_now], d[second_now]
        first[asked], second[asked] = a, b
        upper[asked], lower[asked] = np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))


def _pass(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool, path: str) -> None:
    """Write every vector with its new state as kind 0; as kind 1 how the task's vectors change the sums of clusters.

    In the last pass the sums are those of the squared distances, by cluster.
    """
    k, width = centroids.shape
    counted = width + 1

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        change = np.zeros((k, counted), np.int64)
        spent = np.zeros(k, object)
        for whole in batches:
            for batch in (whole.slice(s, PIECE) for s in range(0, whole.num_rows, PIECE)):
                x = matrix(batch.column("ints"), width)
                first, second = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "second"))
                upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower"))
                was = np.where(np.isinf(upper), -1, first)
                search.assign(x, first, second, upper, lower)
                distance = np.zeros(len(x), np.int64)
                if last:
                    distance = squared(x, centroids[first])
                    for half, shift in ((distance >> 31, 31), (distance & (2**31 - 1), 0)):
                        part = np.zeros(k, np.int64)
                        np.add.at(part, first, half)
                        spent += [int(v) << shift for v in part]
                else:
                    new = was < 0
                    other = np.flatnonzero(was != first)
                    counted_x = np.concatenate([x[other], np.ones((len(other), 1), np.int64)], axis=1)
                    np.add.at(change, first[other], counted_x)
                    np.subtract.at(change, was[other][~new[other]], counted_x[~new[other]])
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("ints"), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower),
                     pa.array(distance), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))], names=NAMES,
                )
        flat = [min(v, LONG_MOST) for v in spent] if last else change.ravel()
        slots = [i for i, v in enumerate(flat) if v]
        n = len(slots)
        none = {"vec_id": pa.int64(), "ints": pa.binary(), "cluster": pa.int32(), "second": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64()}
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(n, t) for t in none.values()], pa.array(slots, pa.int64()), pa.array([int(flat[i]) for i in slots], pa.int64()), pa.array(np.ones(n, np.int32))],
            names=NAMES,
        )

    rows.mapInArrow(told, STATE).write.parquet(path)


def _first_centroids(rows: DataFrame, clusters: int, width: int, seed: int) -> np.ndarray:
    """Vectors of smallest sha256 of ``seed:id``; rows of one id by their integers, rows without id last."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("ints", draw.alias("_draw")).orderBy(F.col("_draw").asc_nulls_last(), "ints").limit(clusters).collect()
    return np.frombuffer(b"".join(bytes(r.ints) for r in first), "<i4").reshape(-1, width).astype(np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every finite vector of ``width`` components.

    Rows of one id are each clustered; a null id is drawn last as a first centroid. With fewer rows than clusters each
    row starts one; an empty table gives an empty result. Components beyond ``magnitude`` are held there, and sums of
    distances at the largest long.
    """
    spark = vectors.sparkSession
    start = shared_folder(spark, "shallot")
    integer_rows(finite(vectors).where(F.size("embedding") == width), scale, width).write.parquet(start)
    bare = spark.read.schema("vec_id long, ints binary").parquet(start)
    centroids = _first_centroids(bare, clusters, width, seed)
    if not len(centroids):
        kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kind)
    state = {"cluster": F.lit(0), "second": F.lit(min(1, len(centroids) - 1)), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}
    rows, path, before = bare.select("*", *[v.alias(c) for c, v in state.items()]), start, None
    sums = np.zeros((len(centroids), width + 1), np.int64)
    for number in range(rounds + 1):
        last = number == rounds
        to = shared_folder(spark, "shallot")
        _pass(rows, centroids, before, last, to)
        remove(spark, path)
        table = spark.read.schema(STATE).parquet(to)
        rows, path = table.where("kind = 0"), to
        told = table.where("kind = 1").select("slot", "total")
        if not last:
            sums += slot_sums(told, sums.size).reshape(sums.shape)
            n = sums[:, width:]
            before, centroids = centroids, np.where(n > 0, sums[:, :width] // np.maximum(n, 1), centroids)
    spent = [0] * len(centroids)
    for slot, total in told.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        spent[slot] = int(total)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))

    inertia = F.lit(min(sum(spent), LONG_MOST)).cast("long")
    by_cluster = of([min(s, LONG_MOST) for s in spent]).cast("long")
    return rows.select("vec_id", "cluster", "distance", by_cluster.alias("cluster_inertia"), inertia.alias("inertia"), of(hashes).alias("centroid_sha256"))
