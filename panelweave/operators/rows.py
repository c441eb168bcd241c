"""Row profiles of page images: smoothing, gutters, bars and ruled lines.

Row tables hold one line per image row: keys, ``y``, ``white_ratio``,
``dark_ratio``, ``edge_density`` and ``gray_mean``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.geometry import clip
from panelweave.operators.spread import BUCKET, interval_sums, last_mark, true_runs, with_halo
from panelweave.session import cut_lineage, tasks_for

CUT_COLUMNS = ("y", "strength", "kind", "span_y1", "span_y2", "meta_e")


def moving_average(rows: DataFrame, keys: Sequence[str], columns: dict[str, str], k: int = 21) -> DataFrame:
    """Box filter along ``y``; missing rows beyond the ends count as zero.

    ``columns`` maps source to result names.  Even ``k`` is raised by one.
    """
    if k <= 1:
        return rows.withColumns({new: F.col(old) for old, new in columns.items()})
    k |= 1
    half = k // 2
    frame = Window.partitionBy(*keys, BUCKET).orderBy("y").rangeBetween(-half, half)
    smooth = {new: F.sum(old).over(frame) / F.lit(float(k)) for old, new in columns.items()}
    return with_halo(rows, keys, "y", half, half).withColumns(smooth).where("_own").drop(BUCKET, "_own")


def _cuts(rows, keys, flag, min_height, kind, strength, meta_e):
    runs = true_runs(rows, keys, "y", flag).where(F.col("y2") - F.col("y1") >= min_height)
    runs = runs.withColumn("y", F.floor((F.col("y1") + F.col("y2")) / F.lit(2)).cast("int"))
    thick = clip((F.col("y2") - F.col("y1")) / F.lit(float(max(min_height * 2, 1))), 0.0, 1.0)
    return runs.join(rows, [*keys, "y"]).select(
        *keys, "y", strength(thick).alias("strength"), F.lit(kind).alias("kind"),
        F.col("y1").alias("span_y1"), F.col("y2").alias("span_y2"), meta_e.alias("meta_e"),
    )


def detect_gutters(rows: DataFrame, keys: Sequence[str], min_height: int = 18, white: float = 0.985, edge: float = 0.006) -> DataFrame:
    """Cuts at runs of white rows without edges."""
    w = clip(F.col("white_ratio"), 0.0, 1.0)
    e = clip(F.lit(1.0) - F.col("edge_density") / F.lit(max(edge, 1e-6)), 0.0, 1.0)
    flag = (F.col("white_ratio") >= white) & (F.col("edge_density") <= edge)
    return _cuts(rows, keys, flag, min_height, "gutter", lambda thick: 0.5 * w + 0.3 * e + 0.2 * thick, e)


def detect_black_bars(rows: DataFrame, keys: Sequence[str], min_height: int = 24, dark: float = 0.90, edge: float = 0.03) -> DataFrame:
    """Cuts at runs of dark rows."""
    d, e = clip(F.col("dark_ratio"), 0.0, 1.0), clip(F.col("edge_density"), 0.0, 1.0)
    flag = (F.col("dark_ratio") >= dark) & (F.col("edge_density") <= edge)
    return _cuts(rows, keys, flag, min_height, "black_bar", lambda thick: 0.7 * d + 0.3 * thick, e)


def long_segments(segments: DataFrame, width: int, angle_bins: int = 18, min_ratio: float = 0.35) -> DataFrame:
    """Segments (``sx1, sy1, sx2, sy2``) long enough to count, with angle bin and mid height."""
    dx, dy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    theta = F.atan2(dy.cast("double"), dx.cast("double"))
    theta = F.when(theta < 0, theta + F.lit(math.pi)).otherwise(theta)
    kept = segments.withColumn("length", F.hypot(dx.cast("double"), dy.cast("double"))).where(F.col("length") >= max(30.0, min_ratio * width))
    angle = F.least(F.floor(theta / F.lit(math.pi) * F.lit(angle_bins)), F.lit(angle_bins - 1)).cast("int")
    return kept.withColumns({"angle_bin": angle, "mid_y": (F.col("sy1") + F.col("sy2")) * F.lit(0.5)})


def orientation_stats(lines: DataFrame, keys: Sequence[str], width: int, height: int, y_bin: int = 24,
                      dominance_thr: float = 0.45, concentration_thr: float = 0.22, long_ratio: float = 0.60) -> DataFrame:
    """Per image: share of the fullest angle and height bins, and whether the image passes the gate."""
    bins = max(1, math.ceil(height / max(y_bin, 1)))
    inside = (F.col("mid_y") >= 0) & (F.col("mid_y") <= height)
    y_of = F.when(inside, F.least(F.floor(F.col("mid_y") * F.lit(bins) / F.lit(float(height))), F.lit(bins - 1)).cast("int"))
    cells = lines.withColumn("y_bin", y_of).groupBy(*keys, "angle_bin", "y_bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("max_len")
    )
    angles = cells.groupBy(*keys, "angle_bin").agg(F.sum("n").alias("n"), F.max("max_len").alias("max_len"))
    angles = angles.groupBy(*keys).agg(
        F.max(F.struct(F.col("n"), -F.col("angle_bin"))).alias("top"), F.sum("n").alias("total"), F.max("max_len").alias("max_len")
    )
    heights = cells.where("y_bin IS NOT NULL").groupBy(*keys, "y_bin").agg(F.sum("n").alias("n"))
    heights = heights.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("concentration"))
    stats = angles.join(heights, [*keys], "left").select(
        *keys, (F.col("top.n") / F.col("total")).alias("dominance"), (-F.col("top.col2")).alias("dominant_bin"),
        F.coalesce("concentration", F.lit(0.0)).alias("concentration"), "max_len",
    )
    by_angle, by_height = F.col("dominance") >= dominance_thr, F.col("concentration") >= concentration_thr
    return stats.withColumn(
        "passes", F.when(F.col("max_len") >= long_ratio * width, by_angle | by_height).otherwise(by_angle & by_height)
    )


def laid_lines(segments: DataFrame, keys: Sequence[str], width: int) -> tuple[DataFrame, int]:
    """What later steps read of the ``long_segments``, stored by image in parts of bounded size, and the number of parts."""
    tasks = tasks_for(segments)
    lines = long_segments(segments, width).select(*keys, "sy1", "sy2", "length", "angle_bin", "mid_y")
    return cut_lineage(lines.repartition(tasks, *keys)), tasks


def line_density(lines: DataFrame, keys: Sequence[str], width: int, height: int, tasks: int | None = None) -> DataFrame:
    """Line length per row over the width; a segment counts once per row it covers."""
    low, high = F.least("sy1", "sy2"), F.greatest("sy1", "sy2")
    share = F.col("length") / (high - low + 1)
    rows = F.explode(F.sequence(clip(low, 0, height - 1), clip(high, 0, height - 1)))
    lines = lines.select(*keys, "length", "sy1", "sy2").repartition(tasks, *keys) if tasks else lines
    spread = lines.select(*keys, share.alias("share"), rows.alias("y"))
    return spread.groupBy(*keys, "y").agg((F.sum("share") / F.lit(max(float(width), 1.0))).alias("density"))


def segments_in_runs(lines: DataFrame, runs: DataFrame, stats: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Lines by the run [y1, y2] their middle lies in; only dominant-angle lines, where a run has any."""
    placed = last_mark(
        lines.select(*keys, "mid_y", "length", "angle_bin"), runs, keys, F.col("mid_y"), F.col("y1").cast("double"),
        [F.col("y1"), F.col("y2")], name="run", tasks=tasks,
    )
    inside = placed.where(F.col("mid_y") <= F.col("run.y2")).select(*keys, "run.y1", "run.y2", "mid_y", "length", "angle_bin")
    marked = inside.join(stats.select(*keys, "dominant_bin"), [*keys]).withColumn("is_dom", F.col("angle_bin") == F.col("dominant_bin"))
    heights = marked.groupBy(*keys, "y1", "y2", "mid_y", "is_dom").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"))
    heights = cut_lineage(heights)
    has_dom = heights.groupBy(*keys, "y1", "y2").agg(F.bool_or("is_dom").alias("has_dom"))
    return heights.join(has_dom, [*keys, "y1", "y2"]).where("is_dom OR NOT has_dom").drop("is_dom", "has_dom")


def weighted_median(weights: DataFrame, keys: Sequence[str], value: str = "mid_y", weight: str = "length", tasks: int | None = None) -> DataFrame:
    """First value whose running weight reaches half the group's weight."""
    weights = weights.select(*keys, value, weight).repartition(tasks, *keys) if tasks else weights
    per_value = weights.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*keys).orderBy(value)
    summed = per_value.withColumns({"_sofar": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                    "_all": F.sum("w").over(Window.partitionBy(*keys))})
    return summed.where(F.col("_sofar") >= F.col("_all") * 0.5).groupBy(*keys).agg(F.min(value).alias("median"))


def detect_hard_lines(segments: DataFrame, keys: Sequence[str], width: int, height: int, density_thr: float = 0.12,
                      min_run: int = 10, half_span: int = 9) -> DataFrame:
    """Cuts at runs of rows crossed by many ruled lines, in images whose lines agree."""
    lines, tasks = laid_lines(segments, keys, width)
    stats = cut_lineage(orientation_stats(lines, keys, width, height).where("passes"))
    lines = lines.join(stats.select(*keys), [*keys], "left_semi")
    density = cut_lineage(line_density(lines, keys, width, height, tasks))
    runs = true_runs(density, keys, "y", F.col("density") >= density_thr, tasks=tasks).where(F.col("y2") - F.col("y1") >= min_run)
    runs = cut_lineage(runs)
    near = weighted_median(segments_in_runs(lines, runs, stats, keys, tasks), [*keys, "y1", "y2"])
    overall = weighted_median(lines, keys, tasks=tasks).withColumnRenamed("median", "_overall")
    centred = runs.join(near, [*keys, "y1", "y2"], "left").join(overall, [*keys], "left")
    centred = centred.withColumn("y", clip(F.coalesce("median", "_overall").cast("int"), 0, height - 1))
    at_row = density.select(*keys, "y", "density")
    s1, s2 = clip(F.col("y") - half_span, 0, height), clip(F.col("y") + half_span, 0, height)
    strength = clip(
        0.6 * clip(F.coalesce("density", F.lit(0.0)) / F.lit(max(density_thr, 1e-6)), 0.0, 1.0)
        + 0.2 * F.col("dominance") + 0.2 * F.col("concentration"), 0.0, 1.0,
    )
    scored = centred.join(at_row, [*keys, "y"], "left").join(stats, [*keys])
    return scored.select(
        *keys, "y", strength.alias("strength"), F.lit("hard_line").alias("kind"),
        F.when(s2 > s1, s1).otherwise(F.col("y1")).alias("span_y1"), F.when(s2 > s1, s2).otherwise(F.col("y2")).alias("span_y2"),
        F.lit(None).cast("double").alias("meta_e"),
    )


def content_difference(cuts: DataFrame, rows: DataFrame, keys: Sequence[str], window: int = 64, gray_thr: float = 0.02,
                       edge_thr: float = 0.002, floor: float = 0.4) -> DataFrame:
    """Weaken cuts with alike rows above and below.  Adds ``gray_diff`` and ``edge_diff``.

    A side's mean comes from running sums at its two ends, not from its rows.
    """
    at = cuts.select(*keys, "y").distinct()
    sides = at.select(*keys, F.explode(F.array(F.struct((F.col("y") - window).alias("y1"), F.col("y").alias("y2")), F.struct(F.col("y").alias("y1"), (F.col("y") + window).alias("y2")))).alias("s"))
    sums = cut_lineage(interval_sums(sides.select(*keys, "s.*").distinct(), rows, keys, ["gray_mean", "edge_density"]))

    def side(name: str, end: str) -> DataFrame:
        means = [F.coalesce(F.try_divide(F.col(c), F.col("n_rows")), F.lit(0.0)).alias(c) for c in ("gray_mean", "edge_density")]
        return sums.select(F.struct(*keys, F.col(end).alias("y")).alias("_at"), F.col("y2" if end == "y1" else "y1").alias("_other"), F.struct(*means).alias(name))

    above = side("_above", "y2").where(F.col("_at.y") - F.col("_other") == window).drop("_other")
    below = side("_below", "y1").where(F.col("_other") - F.col("_at.y") == window).drop("_other")
    joined = cuts.withColumn("_at", F.struct(*keys, "y")).join(above, "_at").join(below, "_at").drop("_at")
    diff = {"gray_diff": F.abs(F.col("_above.gray_mean") - F.col("_below.gray_mean")) / 255.0, "edge_diff": F.abs(F.col("_above.edge_density") - F.col("_below.edge_density"))}
    joined = joined.withColumns(diff).drop("_above", "_below")
    scale = clip(F.lit(floor) + F.col("gray_diff") / F.lit(max(gray_thr, 1e-6)) * F.lit(1.0 - floor), floor, 1.0)
    alike = (F.col("gray_diff") < gray_thr) & (F.col("edge_diff") < edge_thr)
    return joined.withColumn("strength", F.when(alike, clip(F.col("strength") * scale, 0.0, 1.0)).otherwise(F.col("strength")))
