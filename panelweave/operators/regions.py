"""Choosing panel regions: dropping children, merging fragments, de-duplicating.

Region tables hold keys, ``region_id``, a box, ``score`` and ``area_ratio``.
Ids are of any ordered type and unique within their keys; ties follow ``region_id``, or box order and id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import geometry as G
from panelweave.functions.geometry import Box
from panelweave.operators.rounds import suppressed
from panelweave.operators.spatial import touching_pairs
from panelweave.operators.spread import row_numbers, running_max
from panelweave.session import cut_lineage, dealt


def _drop_conflicts(regions: DataFrame, keys: Sequence[str], rank: Sequence[Column], drops, cell: int = 256) -> DataFrame:
    """Ordered pass per group: keep a region unless an earlier kept one drops it.

    Copies of one box fall to their first, so that only distinct boxes are paired.
    """
    boxes = ["x1", "y1", "x2", "y2"]
    ranked = cut_lineage(regions.withColumn("_rank", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)])))
    hollow = ranked.where(G.area(Box.named()) <= 0)
    solid = ranked.where(G.area(Box.named()) > 0)
    firsts = solid.groupBy(*keys, *boxes).agg(F.min(F.struct("_rank", "region_id", "score")).alias("f"))
    own = F.struct(*keys, F.col("f.region_id").alias("region_id"))
    firsts = firsts.select(*keys, *boxes, F.col("f._rank").alias("rank"), own.alias("id"), F.col("f.score").alias("s"))
    other = firsts.select(*keys, *(F.col(c).alias(f"o_{c}") for c in [*boxes, "rank", "id", "s"]))
    pairs = touching_pairs(firsts, other, keys, Box.named(), Box.named("o_"), cell, also=F.col("rank") < F.col("o_rank"))
    conflicts = pairs.where(drops(Box.named("o_"), F.col("o_s"), Box.named(), F.col("s"))).select(F.col("id").alias("hi"), F.col("o_id").alias("lo"))
    lost = suppressed(conflicts)
    kept = firsts.join(lost, "id", "left_anti").select(F.col("id").alias("_id"))
    return solid.withColumn("_id", F.struct(*keys, "region_id")).join(kept, "_id", "left_semi").drop("_id").unionByName(hollow).drop("_rank")


def select_primary(regions: DataFrame, keys: Sequence[str], min_area_ratio: float = 0.04, containment: float = 0.88, iou: float = 0.75) -> DataFrame:
    """Keep the major regions of each band and drop those inside or alike them."""
    def drops(small: Box, small_score: Column, big: Box, big_score: Column) -> Column:
        return (G.containment(small, big) >= containment) | ((G.iou(small, big) >= iou) & (small_score <= big_score))

    large = regions.where(F.col("area_ratio") >= min_area_ratio)
    return _drop_conflicts(large, keys, [-G.area(Box.named()), -F.col("score"), F.col("region_id")], drops)


def dedup_regions(regions: DataFrame, keys: Sequence[str], iou: float = 0.60, containment: float = 0.90) -> DataFrame:
    """Non-maximum suppression over a page, best score first, then the larger box."""
    def drops(weak: Box, _weak_score: Column, strong: Box, _strong_score: Column) -> Column:
        return (G.iou(weak, strong) >= iou) | (G.containment(weak, strong) >= containment)

    rank = [-F.col("score"), -G.area(Box.named()), F.col("y1"), F.col("x1"), F.col("region_id")]
    return _drop_conflicts(regions, keys, rank, drops)


class _Fragments:
    """Regions of a stretch in list order, which merging keeps sorted by upper edge: the earlier of two stays.

    ``part`` may hold many stretches one after the other, each in list order; ``starts`` then tells their first rows.
    """

    STEP = 64

    def __init__(self, part: pd.DataFrame, limits: dict, starts: np.ndarray | None = None):
        self.limits = limits
        self.part = part.sort_values(["y1_in", "x1_in", "region_id"], kind="stable").reset_index(drop=True) if starts is None else part
        ends = [len(part)] if starts is None else [*starts[1:], len(part)]
        sizes = np.diff([0, *ends])
        self.start, self.end = np.repeat(np.subtract(ends, sizes), sizes).tolist(), np.repeat(ends, sizes).tolist()
        self.x1, self.y1, self.x2, self.y2 = (self.part[c].to_numpy(dtype=float, copy=True) for c in ("x1", "y1", "x2", "y2"))
        self.ratio = self.part["area_ratio"].to_numpy(dtype=float, copy=True)
        self.score = self.part["score"].to_numpy(dtype=float, copy=True)
        self.alive = np.ones(len(self.part), bool)
        self.ids: dict[int, set] = {}
        self.deep = np.maximum.reduceat(self.y2, np.arange(0, len(self.part), self.STEP))

    def first(self, i: int, others: np.ndarray) -> int:
        """The first of ``others`` that merges with i, or -1."""
        others = others[self.alive[others]]
        if not len(others):
            return -1
        wide = np.minimum(self.x2[i], self.x2[others]) - np.maximum(self.x1[i], self.x1[others])
        high = np.minimum(self.y2[i], self.y2[others]) - np.maximum(self.y1[i], self.y1[others])
        shared = np.maximum(wide, 0) * np.maximum(high, 0)
        own, theirs = self._area(i), self._area(others)
        narrow = np.maximum(1, np.minimum(self.x2[i] - self.x1[i], self.x2[others] - self.x1[others]))
        gap = np.maximum(np.maximum(self.y1[others] - self.y2[i], self.y1[i] - self.y2[others]), 0)
        alike = (shared > 0) & (shared / np.maximum(own + theirs - shared, 1.0) >= self.limits["iou"])
        held = shared / np.maximum(np.minimum(own, theirs), 1.0) >= self.limits["containment"]
        stacked = (np.minimum(self.ratio[i], self.ratio[others]) <= self.limits["fragment"]) & (np.maximum(wide, 0) / narrow >= self.limits["x_overlap"])
        found = np.flatnonzero(alike | held | (stacked & (gap <= self.limits["gap"])))
        return int(others[found[0]]) if len(found) else -1

    def _area(self, i):
        return np.maximum(self.x2[i] - self.x1[i], 0) * np.maximum(self.y2[i] - self.y1[i], 0)

    def later(self, i: int) -> np.ndarray:
        return np.arange(i + 1, i + 1 + np.searchsorted(self.y1[i + 1 : self.end[i]], max(self.y1[i], self.y2[i]) + self.limits["gap"], "right"))

    def earlier(self, i: int) -> np.ndarray:
        start = self.start[i]
        steps = start // self.STEP + np.flatnonzero(self.deep[start // self.STEP : i // self.STEP + 1] >= self.y1[i] - self.limits["gap"])
        spots = (steps[:, None] * self.STEP + np.arange(self.STEP)).ravel()
        return spots[(spots >= start) & (spots < i)]

    def join(self, i: int, j: int) -> None:
        self.x1[i], self.x2[i] = min(self.x1[i], self.x1[j]), max(self.x2[i], self.x2[j])
        self.y1[i], self.y2[i] = min(self.y1[i], self.y1[j]), max(self.y2[i], self.y2[j])
        self.score[i] = max(self.score[i], self.score[j])
        self.ratio[i] = min(max(self.ratio[i] + self.ratio[j], 0.0), 1.0)
        self.ids[i] = self._members(i) | self._members(j)
        self.ids.pop(j, None)
        self.alive[j] = False
        self.deep[i // self.STEP] = max(self.deep[i // self.STEP], self.y2[i])

    def _members(self, i: int) -> set:
        return self.ids[i] if i in self.ids else set(self.part.at[i, "node_ids"])

    def fused(self) -> pd.DataFrame:
        """Merge the first pair in list order again and again.

        Once a row has no partner after it, only a change of a later row can give it one; so after each merge the rows
        before the changed one are asked first, and those in between need not be asked again.
        """
        for i in range(len(self.part)):
            at = i
            while self.alive[at] and (j := self.first(at, self.later(at))) >= 0:
                self.join(at, j)
                while (e := self.first(at, self.earlier(at))) >= 0:
                    self.join(e, at)
                    at = e
        out = self.part.copy()
        for name, values in (("x1", self.x1), ("y1", self.y1), ("x2", self.x2), ("y2", self.y2), ("score", self.score), ("area_ratio", self.ratio)):
            out[name] = values.astype(self.part[name].dtype)
        out["node_ids"] = [sorted(self.ids[i]) if i in self.ids else ids for i, ids in enumerate(self.part["node_ids"])]
        return out[self.alive]


def _whole_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some thousand rows at a time, cut where a stretch begins (``_turn`` 1)."""
    held = []
    for batch in batches:
        firsts = np.flatnonzero(batch.column("_turn").to_numpy() == 1)
        if len(firsts) and (held or firsts[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, firsts[-1])])
            held, batch = [], batch.slice(firsts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def merge_fragments(regions: DataFrame, keys: Sequence[str], iou: float = 0.45, x_overlap: float = 0.82, gap: int = 20,
                    containment: float = 0.78, fragment: float = 0.12) -> DataFrame:
    """Merge regions of a band that overlap, or small ones stacked closely, until none is left to merge.

    Merged boxes never leave their stretch of rows, and merging bridges at most
    ``gap`` rows.  Stretches further apart are therefore merged by themselves,
    many of them in one Arrow batch, and a lone region skips Python.  A region
    without a box stays as it is.
    """
    if containment <= 0:
        raise ValueError("containment must be positive")
    limits = {"iou": iou, "x_overlap": x_overlap, "gap": gap, "containment": containment, "fragment": fragment}
    regions = cut_lineage(regions.withColumns({"y1_in": F.col("y1"), "x1_in": F.col("x1")}))
    order = [F.col("y1"), F.col("x1"), F.col("region_id")]
    reach = running_max(regions, keys, order, F.col("y1"), F.greatest("y1", "y2"), "_reach", include_current=False)
    first = F.when(F.coalesce(F.col("y1") > F.col("_reach") + gap, F.lit(True)), F.col("y1"))
    named = cut_lineage(running_max(reach, keys, order, F.col("y1"), first, "_stretch").drop("_reach"))
    sized = named.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_stretch")))
    several = (F.col("_n") > 1) & F.greatest("x1", "y1", "x2", "y2", "score", "area_ratio").isNotNull() & ~F.exists(F.array("x1", "y1", "x2", "y2"), F.isnull)
    crowded = sized.where(several).drop("_n")
    turn = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("y1_in", "x1_in", F.asc_nulls_last("region_id")))
    listed = dealt(crowded, *keys, "_stretch").withColumn("_turn", turn).sortWithinPartitions(*keys, "_stretch", "_turn")
    numbers = ["x1", "y1", "x2", "y2", "score", "area_ratio"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_stretches(batches):
            part = table.select(numbers).to_pandas().assign(node_ids=table.column("node_ids").to_pylist())
            merged = _Fragments(part, limits, np.flatnonzero(table.column("_turn").to_numpy() == 1)).fused()
            out = table.drop_columns("_turn").take(merged.index.to_numpy())
            for name in [*numbers, "node_ids"]:
                at = out.schema.get_field_index(name)
                out = out.set_column(at, out.schema.field(at), pa.array(merged[name].tolist(), out.schema.field(at).type))
            yield from out.to_batches()

    fused = listed.mapInArrow(fuse, crowded.schema)
    return fused.unionByName(sized.where(~several).drop("_n")).drop("_stretch", "y1_in", "x1_in")


def number_panels(regions: DataFrame, keys: Sequence[str], width: int, height: int, score: float = 0.12, pad: int = 6) -> DataFrame:
    """Panels ``panel_001`` ... of good regions, padded and clipped to the page; empty ones are not numbered."""
    padded = G.pad_to_page(Box.named(), pad, F.lit(width), F.lit(height))
    good = regions.where(F.col("score") >= score).where(~padded.empty).withColumns({"_y": F.col("y1"), "_x": F.col("x1")})
    good = good.withColumns(dict(zip(("x1", "y1", "x2", "y2"), padded)))
    numbered = row_numbers(good, keys, [F.col("_y"), F.col("_x"), F.col("region_id")], name="_no")
    return numbered.withColumn("panel_id", F.format_string("panel_%03d", "_no")).drop("_no", "_x", "_y")


def band_panels(bands: DataFrame, keys: Sequence[str], width: int, height: int, pad: int = 6) -> DataFrame:
    """One full-width panel per band; an empty band leaves a gap in the numbers."""
    numbered = row_numbers(bands, keys, [F.col("y1"), F.col("y2")], name="_no")
    y1, y2 = F.greatest(F.col("y1") - pad, F.lit(0)), F.least(F.col("y2") + pad, F.lit(height))
    return numbered.where(y2 > y1).select(
        *keys, F.format_string("panel_%03d", "_no").alias("panel_id"), F.lit(-1).alias("region_id"), (F.col("_no") - 1).alias("band_index"),
        "score", F.lit(0).alias("x1"), y1.alias("y1"), F.lit(width).alias("x2"), y2.alias("y2"),
    )


@dataclass(frozen=True)
class ExportLimits:
    """Thresholds of the steps from regions to panels; a manifest states them under these names."""

    score_thr: float = 0.12
    pad: int = 6
    min_area_ratio: float = 0.04
    containment_thr: float = 0.88
    iou_thr: float = 0.75
    merge_iou_thr: float = 0.45
    merge_x_overlap_thr: float = 0.82
    merge_gap_px: int = 20
    merge_containment_thr: float = 0.78
    merge_fragment_max_area_ratio: float = 0.12
    nms_iou_thr: float = 0.60
    nms_containment_thr: float = 0.90


def panel_manifest(regions: DataFrame, page_keys: Sequence[str], band_keys: Sequence[str], width: int, height: int,
                   limits: ExportLimits = ExportLimits()) -> tuple[DataFrame, DataFrame]:
    """(manifest per page: the count after every step and the thresholds, exported panels as rows)."""
    primary = cut_lineage(select_primary(regions, band_keys, limits.min_area_ratio, limits.containment_thr, limits.iou_thr))
    merged = cut_lineage(merge_fragments(
        primary, band_keys, limits.merge_iou_thr, limits.merge_x_overlap_thr, limits.merge_gap_px, limits.merge_containment_thr, limits.merge_fragment_max_area_ratio
    ))
    deduped = cut_lineage(dedup_regions(merged, page_keys, limits.nms_iou_thr, limits.nms_containment_thr))
    panels = cut_lineage(number_panels(deduped, page_keys, width, height, limits.score_thr, limits.pad))
    steps = {"source": regions, "primary": primary, "merged": merged, "dedup": deduped, "panel": panels}
    tagged = None
    for name, df in steps.items():
        part = df.select(*page_keys, F.lit(name).alias("step"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy(*page_keys).agg(*(F.count_if(F.col("step") == name).alias(f"{name}_count") for name in steps))
    return counts.withColumns({name: F.lit(value) for name, value in asdict(limits).items()}), panels
