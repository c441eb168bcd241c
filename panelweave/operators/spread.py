"""Ordered work over groups of any size, spread over many tasks.

A window over a whole group puts that group into one task.  The helpers here
cut a group into buckets along its order, solve each bucket by itself and add
what the earlier buckets contribute, which is one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelweave.session import cut_lineage

BUCKET = "_bucket"
#: Exact sums: differences of running sums of doubles would not give the sum of a span.
EXACT = "decimal(28,18)"


def bucketed(df: DataFrame, keys: Sequence[str], position: Column, size: int, tasks: int | None = None) -> DataFrame:
    """Add the bucket and lay rows out by it, so that all later steps share one shuffle, over ``tasks`` if given.

    A bucket is one value of keys and number, which is equal to itself where a key or the position is null.
    """
    numbered = df.withColumn(BUCKET, F.struct(*keys, F.floor(position / F.lit(size)).alias("_number")))
    return numbered.repartition(tasks, BUCKET) if tasks else numbered.repartition(BUCKET)


def _before(keys: Sequence[str]):
    """All earlier buckets of a group."""
    group = [F.col(BUCKET).getField(k) for k in keys]
    return Window.partitionBy(*group).orderBy(F.col(BUCKET)["_number"]).rowsBetween(Window.unboundedPreceding, -1)


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in order of keys and ``order``, cut by sampled row quantiles into parts of alike many rows.

    Adds a row's group and part as bucket, and ``_at``, which counts on within a part.  A group of any density is in as
    many parts as its rows fill.  The parts go to the checkpoint folder: cuts by a sample must not change between reads.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(ordered).withColumn(BUCKET, F.struct(*keys, F.shiftright("_at", 33).alias("_number")))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``row_number`` per group; a row's place in its part, and the rows its group has in earlier parts."""
    rows = laid_out(df, keys, order)
    counts = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = counts.select(BUCKET, (F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)) + 1 - F.col("_first")).alias("_offset"))
    numbered = rows.join(offsets, BUCKET).withColumn(name, (F.col("_at") + F.col("_offset")).cast("int"))
    return numbered.drop(BUCKET, "_at", "_offset")


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: Column,
    value: Column,
    name: str,
    size: int = 4096,
    include_current: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Largest ``value`` so far in the group's order; null where nothing precedes.

    ``value`` may be a struct, which makes this an as-of lookup.  Rows of one
    position must share a bucket, which any function of ``position`` gives.
    """
    rows = bucketed(df.withColumn("_value", value), keys, position, size, tasks)
    peaks = rows.groupBy(BUCKET).agg(F.max("_value").alias("_peak"))
    carried = peaks.select(BUCKET, F.max("_peak").over(_before(keys)).alias("_carried"))
    inside = Window.partitionBy(BUCKET).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    joined = rows.join(carried, BUCKET)
    return joined.withColumn(name, F.greatest(F.max("_value").over(inside), F.col("_carried"))).drop(BUCKET, "_value", "_carried")


def with_halo(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, size: int = 4096) -> DataFrame:
    """Copy rows near a bucket's border into all neighbour buckets within reach (``_own`` is false there).

    A frame of ``before`` rows back and ``after`` ahead then never leaves its bucket.
    """
    pos = F.col(position)
    home = F.floor(pos / F.lit(size))
    buckets = F.sequence(F.floor((pos - after) / F.lit(size)), F.floor((pos + before) / F.lit(size)))
    spread = df.withColumn("_home", home).withColumn(BUCKET, F.explode(buckets))
    return spread.withColumn("_own", F.col("_home") == F.col(BUCKET)).drop("_home")


def true_runs(df: DataFrame, keys: Sequence[str], position: str, flag: Column, size: int = 4096, tasks: int | None = None) -> DataFrame:
    """Maximal runs of consecutive positions where ``flag`` holds, as half-open [y1, y2).

    Runs are found per bucket; only pieces that touch a bucket border, at most
    two per bucket, are then stitched over the whole group.  The pieces are
    stored, so that rows are gone through once.
    """
    pos = F.col(position)
    hits = bucketed(df.where(flag).select(*keys, position), keys, pos, size, tasks)
    inside = Window.partitionBy(BUCKET).orderBy(position)
    pieces = (
        hits.withColumn("_island", pos - F.row_number().over(inside))
        .groupBy(BUCKET, *keys, "_island")
        .agg(F.min(position).alias("y1"), (F.max(position) + 1).alias("y2"))
    )
    pieces = cut_lineage(pieces)
    at_border = (F.col("y1") % size == 0) | (F.col("y2") % size == 0)
    whole = pieces.where(~at_border).select(*keys, "y1", "y2")
    order = Window.partitionBy(*keys).orderBy("y1")
    edge = pieces.where(at_border).withColumn("_new", (F.coalesce(F.lag("y2").over(order), F.lit(-1)) != F.col("y1")).cast("int"))
    edge = edge.withColumn("_run", F.sum("_new").over(order))
    stitched = edge.groupBy(*keys, "_run").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return whole.unionByName(stitched.select(*keys, "y1", "y2"))


def last_mark(
    points: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    at: Column,
    mark_at: Column,
    payload: Sequence[Column],
    name: str = "mark",
    inclusive: bool = True,
    backward: bool = True,
    size: int = 4096,
    tasks: int | None = None,
) -> DataFrame:
    """As-of lookup: the nearest mark at or before each point (after it, if not ``backward``).

    ``payload`` lists the mark's columns; its lead breaks ties between marks of
    one position, the largest wins.  Points without a mark get null.
    """
    sign = 1 if backward else -1
    side = 1 if inclusive else 0
    asked = points.select("*", (at * sign).alias("_pos"), F.lit(side).alias("_side"), F.lit(True).alias("_asked"))
    held = marks.select(
        *keys, (mark_at * sign).alias("_pos"), F.lit(1 - side).alias("_side"), F.lit(False).alias("_asked"),
        F.struct((mark_at * sign).alias("_key"), *payload).alias("_mark"),
    )
    both = asked.unionByName(held, allowMissingColumns=True)
    seen = running_max(both, keys, [F.col("_pos"), F.col("_side")], F.col("_pos"), F.col("_mark"), name, size, tasks=tasks)
    return seen.where("_asked").drop("_pos", "_side", "_asked", "_mark")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position: Column, columns: Sequence[str], size: int = 4096) -> DataFrame:
    """Replace ``columns``, of an exact type, by their sums so far in the group's order, the row itself included."""
    rows = bucketed(df, keys, position, size)
    whole = rows.groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in columns])
    carried = whole.select(BUCKET, *[F.sum(c).over(_before(keys)).alias(f"_carried_{c}") for c in columns])
    inside = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"_carried_{c}", F.lit(0)) for c in columns}
    return rows.join(carried, BUCKET).withColumns(sums).drop(BUCKET, *[f"_carried_{c}" for c in columns])


def interval_sums(spans: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], low: str = "y1", high: str = "y2", position: str = "y") -> DataFrame:
    """Add to each span [low, high) the exact sums of ``columns`` over its rows and their number ``n_rows``.

    A sum is the difference of the running sums at both ends, so wide and overlapping spans cost no more than narrow ones.
    Values that are null or not finite count as rows without a sum.
    """
    sums = [f"_{c}" for c in columns]
    held = rows.select(*keys, F.col(position).alias("_pos"), F.lit(1).alias("_side"), *[F.col(c).try_cast(EXACT).alias(s) for c, s in zip(columns, sums)], F.lit(1).cast("long").alias("_n"))
    ends = spans.select(*keys, F.explode(F.array(low, high)).alias("_pos")).distinct()
    asked = ends.select("*", F.lit(0).alias("_side"), *[F.lit(0).cast(EXACT).alias(s) for s in sums], F.lit(0).cast("long").alias("_n"))
    told = running_sums(held.unionByName(asked), keys, [F.col("_pos"), F.col("_side")], F.col("_pos"), [*sums, "_n"]).where("_side = 0")

    def at(end: str) -> DataFrame:
        return told.select(F.struct(*keys, "_pos").alias(f"_{end}_place"), F.struct(*sums, "_n").alias(f"_{end}"))

    placed = spans.withColumns({"_low_place": F.struct(*keys, F.col(low).alias("_pos")), "_high_place": F.struct(*keys, F.col(high).alias("_pos"))})
    joined = placed.join(at("low"), "_low_place").join(at("high"), "_high_place")
    wide = F.col(high) > F.col(low)

    def between(name: str) -> Column:
        return F.when(wide, F.col("_high")[name] - F.col("_low")[name]).otherwise(0)

    found = {c: between(s).cast("double").alias(c) for c, s in zip(columns, sums)}
    return joined.withColumns({**found, "n_rows": between("_n").cast("long")}).drop("_low", "_high", "_low_place", "_high_place")


def neighbours(df: DataFrame, keys: Sequence[str], position: Column, payload: Sequence[str], size: int = 4096) -> DataFrame:
    """Add ``prev`` and ``next``: the payload of the row before and after in the group, null at its ends; positions differ."""
    rows = bucketed(df.withColumns({"_pos": position, "_payload": F.struct(*payload)}), keys, F.col("_pos"), size)
    ends = rows.groupBy(BUCKET).agg(F.min_by("_payload", "_pos").alias("_head"), F.max_by("_payload", "_pos").alias("_tail"))
    group = [F.col(BUCKET).getField(k) for k in keys]
    along = Window.partitionBy(*group).orderBy(F.col(BUCKET)["_number"])
    beyond = ends.select(BUCKET, F.lag("_tail").over(along).alias("_before"), F.lead("_head").over(along).alias("_after"))
    inside = Window.partitionBy(BUCKET).orderBy("_pos")
    both = {"prev": F.coalesce(F.lag("_payload").over(inside), "_before"), "next": F.coalesce(F.lead("_payload").over(inside), "_after")}
    return rows.join(beyond, BUCKET).withColumns(both).drop(BUCKET, "_pos", "_payload", "_before", "_after")


def walked(df: DataFrame, group: Sequence[str], order: Sequence[str], schema: StructType, step: Callable[[Iterable[tuple]], Iterator[tuple]], piece: int = 4096) -> DataFrame:
    """Rows that ``step`` makes of each group's other columns, read one by one in order; only what ``step`` keeps is held.

    ``schema`` is of the group's columns and then of what ``step`` gives.
    """
    rest = [c for c in df.columns if c not in group]
    laid = df.select(*group, *rest).repartition(*group).sortWithinPartitions(*group, *order)
    shape, n = to_arrow_schema(schema), len(group)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), shape.types)], names=shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, made = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])), []
        for key, part in groupby(rows, lambda row: row[:n]):
            for out in step(row[n:] for row in part):
                made.append((*key, *out))
                if len(made) >= piece:
                    yield told(made)
                    made = []
        if made:
            yield told(made)

    return laid.mapInArrow(run, schema)
