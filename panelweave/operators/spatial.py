"""Box joins that meet in grid cells instead of pairing all rows of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.geometry import Box


def _cells(low: Column, high: Column, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(low / F.lit(cell)), F.floor(high / F.lit(cell))))


def _into_cells(df: DataFrame, box: Box, prefix: str, cell: int) -> DataFrame:
    held = df.select(
        "*",
        box.x1.alias(f"_{prefix}x1"), box.y1.alias(f"_{prefix}y1"),
        F.greatest(box.x2, box.x1).alias(f"_{prefix}x2"), F.greatest(box.y2, box.y1).alias(f"_{prefix}y2"),
    )
    across = held.withColumn("_cx", _cells(F.col(f"_{prefix}x1"), F.col(f"_{prefix}x2"), cell))
    return across.withColumn("_cy", _cells(F.col(f"_{prefix}y1"), F.col(f"_{prefix}y2"), cell))


def touching(a: Box, b: Box) -> Column:
    """Whether two closed boxes touch; a box whose edges are reversed ends where it starts, one without a low corner touches none."""
    meet = [
        F.greatest(low, o_low) <= F.least(F.greatest(high, low), F.greatest(o_high, o_low))
        for low, high, o_low, o_high in ((a.x1, a.x2, b.x1, b.x2), (a.y1, a.y2, b.y1, b.y2))
    ]
    return meet[0] & meet[1] & a.x1.isNotNull() & a.y1.isNotNull() & b.x1.isNotNull() & b.y1.isNotNull()


def touching_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_box: Box, right_box: Box, cell: int = 256, also: Column | None = None
) -> DataFrame:
    """Rows of both sides whose closed boxes touch, each pair once.

    Both sides are spread over the cells they cover, so that one page full of
    boxes is shared by many tasks.  A pair that shares several cells is kept in
    the one that holds the low corner of its overlap.  ``also`` narrows the
    join; the two sides must not share column names besides ``keys``.  Spark's
    estimate of a side does not count the cells it is spread over, so the join
    asks for a merge: a side that seems small must not go through the driver.
    """
    a, b = _into_cells(left, left_box, "l", cell), _into_cells(right, right_box, "r", cell)
    joined = a.join(b.hint("merge"), [*keys, "_cx", "_cy"])
    low_x, low_y = F.greatest("_lx1", "_rx1"), F.greatest("_ly1", "_ry1")
    kept = (
        (low_x <= F.least("_lx2", "_rx2"))
        & (low_y <= F.least("_ly2", "_ry2"))
        & (F.floor(low_x / F.lit(cell)) == F.col("_cx"))
        & (F.floor(low_y / F.lit(cell)) == F.col("_cy"))
    )
    if also is not None:
        kept = kept & also
    helpers = ["_cx", "_cy", *(f"_{s}{c}" for s in "lr" for c in ("x1", "y1", "x2", "y2"))]
    return joined.where(kept).drop(*helpers)


def nearest_by_center(
    points: DataFrame, targets: DataFrame, keys: Sequence[str], point: tuple[Column, Column], target: tuple[Column, Column],
    point_id: Sequence[str], rank: Sequence[Column], payload: Sequence[str], cell: int = 256,
) -> DataFrame:
    """For every point the first target by ``rank``, whose lead is the squared centre distance.

    Level n of the grid has cells of side cell * 2**n.  The finest level whose
    3 x 3 neighbourhood holds any target bounds the distance to the nearest one
    by 2 * sqrt(2) cells, so that two levels up the neighbourhood must hold it.
    Only those cells are joined, by merging as in ``touching_pairs``.  ``rank`` and ``payload`` may use ``_px, _py, _tx, _ty``.
    """
    p = points.withColumns({"_px": point[0], "_py": point[1]})
    t = targets.withColumns({"_tx": target[0], "_ty": target[1]})
    span_p = p.groupBy(*keys).agg(F.min(F.least("_px", "_py")).alias("_lo"), F.max(F.greatest("_px", "_py")).alias("_hi"))
    span_t = t.groupBy(*keys).agg(F.min(F.least("_tx", "_ty")).alias("_tlo"), F.max(F.greatest("_tx", "_ty")).alias("_thi"))
    extent = F.greatest("_hi", "_thi") - F.least("_lo", "_tlo")
    top = F.greatest(F.ceil(F.log2(F.greatest(extent / F.lit(float(cell)), F.lit(1.0)))), F.lit(0)).cast("int")
    levels = span_p.join(span_t, [*keys]).select(*keys, F.explode(F.sequence(F.lit(0), top)).alias("_level"))

    def at_level(column: str, level: Column) -> Column:
        return F.floor(F.col(column) / (F.lit(float(cell)) * F.pow(F.lit(2.0), level)))

    level = F.col("_level")
    around = F.sequence(F.lit(-1), F.lit(1))
    taken = t.join(levels.hint("merge"), [*keys]).select(*keys, "_level", at_level("_tx", level).alias("_cx"), at_level("_ty", level).alias("_cy")).distinct()
    asked = p.select(*keys, "_px", "_py").distinct().join(levels.hint("merge"), [*keys])
    asked = asked.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    asked = asked.select(
        *keys, "_px", "_py", "_level", (at_level("_px", level) + F.col("_dx")).alias("_cx"), (at_level("_py", level) + F.col("_dy")).alias("_cy")
    )
    found = asked.join(taken.hint("merge"), [*keys, "_level", "_cx", "_cy"]).groupBy(*keys, "_px", "_py").agg((F.min("_level") + 2).alias("_level"))
    placed = p.join(found.hint("merge"), [*keys, "_px", "_py"]).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    placed = placed.withColumns({"_cx": at_level("_px", level) + F.col("_dx"), "_cy": at_level("_py", level) + F.col("_dy")})
    wanted = levels.select(*keys, (level + 2).alias("_level"))
    offered = t.join(wanted.hint("merge"), [*keys]).withColumns({"_cx": at_level("_tx", level), "_cy": at_level("_ty", level)})
    pairs = placed.join(offered.hint("merge"), [*keys, "_level", "_cx", "_cy"])
    best = F.min(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *[F.col(c) for c in payload])).alias("_best")
    return pairs.groupBy(*keys, *point_id).agg(best).select(*keys, *point_id, *[F.col(f"_best.{c}").alias(c) for c in payload])
