"""Pixels and patches: row shares, gradients, patch graph and region growth.

Pixel tables hold keys, ``y, x, b, g, r``; patch labels enter as a column.
Patches of one band are few (a graph has at most some hundred nodes).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.geometry import region_score
from panelweave.functions.vectors import l2_normalize


def gray() -> Column:
    """Luma of the pixel, rounded half up (weights in thousandths)."""
    return F.floor((F.col("b") * 114 + F.col("g") * 587 + F.col("r") * 299 + 500) / F.lit(1000)).cast("int")


def sobel(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal and vertical 3 x 3 derivatives of ``gray``, borders mirrored.

    One pass along rows, one along columns; no window holds a whole image.
    """
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")

    def around(name: str, window) -> tuple[Column, Column]:
        before, after = F.lag(name).over(window), F.lead(name).over(window)
        return F.coalesce(before, after, F.col(name)), F.coalesce(after, before, F.col(name))

    grays = pixels.withColumn("gray", gray())
    left, right = around("gray", row)
    lined = grays.withColumns({"_dx": right - left, "_sx": left + 2 * F.col("gray") + right})
    (dx_up, dx_down), (sx_up, sx_down) = around("_dx", column), around("_sx", column)
    return lined.withColumns({"gx": dx_up + 2 * F.col("_dx") + dx_down, "gy": sx_down - sx_up}).drop("_dx", "_sx")


def magnitude() -> Column:
    return F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))


def gradient_map(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gradient size over its 99th percentile of the image, at most 1, as ``grad``."""
    sized = sobel(pixels, keys).withColumn("mag", magnitude())
    scale = sized.groupBy(*keys).agg(F.percentile("mag", 0.99).alias("_p"))
    unit = F.when(F.col("_p") < 1e-6, F.lit(1.0)).otherwise(F.col("_p"))
    return sized.join(scale, [*keys]).withColumn("grad", F.least(F.col("mag") / unit, F.lit(1.0))).drop("_p")


def row_stats(pixels: DataFrame, keys: Sequence[str], white: int = 245, dark: int = 40, edge: int = 120) -> DataFrame:
    """White, dark and edge shares of every image row.

    A pixel is an edge where its two derivatives add up to ``edge`` or more;
    this stands in for an edge detector with hysteresis.
    """
    def share(flag: Column) -> Column:
        return F.avg(flag.cast("double"))

    return sobel(pixels, keys).groupBy(*keys, "y").agg(
        F.avg("gray").alias("gray_mean"), share(F.col("gray") > white).alias("white_raw"), share(F.col("gray") < dark).alias("dark_raw"),
        share(F.abs("gx") + F.abs("gy") >= edge).alias("edge_raw"),
    )


def patch_stats(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per label: box, area, centre, mean colour, gradient and non-white share."""
    per_label = graded.groupBy(*keys, "label").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("area"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), *(F.avg(c).alias(f"mean_{c}") for c in "bgr"), F.avg("grad").alias("edge_mean"),
        F.avg((F.col("gray") < 245).cast("double")).alias("non_white_ratio"),
    )
    order = Window.partitionBy(*keys).orderBy("label")
    return per_label.withColumn("node_id", F.row_number().over(order) - 1)


def label_borders(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring pixels with different labels: the label pair and both gradients' sum."""
    parts = []
    for line, along in (("y", "x"), ("x", "y")):
        window = Window.partitionBy(*keys, line).orderBy(along)
        ahead = F.lead(F.struct(along, "label", "grad")).over(window)
        pairs = graded.select(*keys, along, "label", "grad", ahead.alias("n")).where((F.col("n.label") != F.col("label")) & (F.col(f"n.{along}") == F.col(along) + 1))
        low, high = F.least(F.col("label"), F.col("n.label")), F.greatest(F.col("label"), F.col("n.label"))
        parts.append(pairs.select(*keys, low.alias("a"), high.alias("b"), (F.col("grad") + F.col("n.grad")).alias("both")))
    return parts[0].unionByName(parts[1])


def boundary_costs(borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean gradient along the border of each label pair."""
    return borders.groupBy(*keys, "a", "b").agg((F.sum("both") / (2 * F.count(F.lit(1)))).alias("boundary_cost"), F.count(F.lit(1)).alias("border"))


def neighbor_sets(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = edges.select(*keys, F.col("a").alias("node_id"), F.col("b").alias("n")).unionByName(edges.select(*keys, F.col("b").alias("node_id"), F.col("a").alias("n")))
    return both.groupBy(*keys, "node_id").agg(F.array_sort(F.collect_set("n")).alias("neighbors"))


def patch_crops(pixels: DataFrame, nodes: DataFrame, keys: Sequence[str], pad: int = 2) -> DataFrame:
    """Pixels of each node's box grown by ``pad`` (other labels' pixels included)."""
    spots = nodes.select(
        *keys, "node_id", F.explode(F.sequence(F.greatest(F.col("x1") - pad, F.lit(0)), F.col("x2") + pad - 1)).alias("x"), "y1", "y2"
    ).withColumn("y", F.explode(F.sequence(F.greatest(F.col("y1") - pad, F.lit(0)), F.col("y2") + pad - 1)))
    return spots.select(*keys, "node_id", "x", "y").join(pixels.select(*keys, "y", "x", "b", "g", "r"), [*keys, "y", "x"])


def histogram_embedding(crops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """32 values per crop: 8-bin shares of each channel and of the gradient size, at unit length."""
    sized = sobel(crops, keys).withColumn("m", F.floor(F.least(magnitude(), F.lit(255.0))))
    shares = [F.count_if(F.floor(F.col(c) / F.lit(32)) == i) / F.count(F.lit(1)) for c in ("b", "g", "r", "m") for i in range(8)]
    counted = sized.groupBy(*keys).agg(F.array(*shares).alias("v"))
    return counted.select(*keys, l2_normalize(F.col("v")).alias("embedding"))


def content_keys(crops: DataFrame, keys: Sequence[str], salt: str) -> DataFrame:
    """SHA-1 of the salt, the crop's shape and its bytes in row order.

    A crop is a patch with its border, never a whole page, so that its pixels fit one row.
    """
    pixel = F.struct("y", "x", F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in "bgr")).alias("h"))
    packed = crops.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(pixel)), lambda p: p["h"]), "").alias("hexes"),
        (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"),
    )
    shape = F.format_string("(%d, %d, 3)", "h", "w")
    return packed.select(*keys, F.sha1(F.concat(F.encode(F.concat(F.lit(salt), shape), "utf-8"), F.unhex("hexes"))).alias("content_key"))


def seed_rank(nodes: DataFrame, keys: Sequence[str], top: int = 8) -> DataFrame:
    """The most structured patches of each band, best first."""
    total = F.sum("area").over(Window.partitionBy(*keys))
    salience = 0.45 * F.col("edge_mean") + 0.45 * F.col("non_white_ratio") + 0.10 * F.least(F.col("area") / F.greatest(total, F.lit(1)) * 10.0, F.lit(1.0))
    scored = nodes.withColumn("salience", salience)
    order = Window.partitionBy(*keys).orderBy(F.desc("salience"), "node_id")
    return scored.withColumn("seed_no", F.row_number().over(order)).where(F.col("seed_no") <= top)


def mean_embedding(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the members' vectors at unit length; 32 zeros for a group without any vector."""
    spots = members.select(*keys, F.posexplode_outer("embedding").alias("pos", "value"))
    means = spots.groupBy(*keys, "pos").agg(F.avg(F.col("value").cast("double")).alias("m"))
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "m")))).alias("ms"))
    vector = F.transform("ms", lambda p: p["m"])
    return lists.select(*keys, F.when(F.size("ms") == 0, F.array_repeat(F.lit(0.0), 32)).otherwise(l2_normalize(vector)).alias("embedding"))


def region_summary(members: DataFrame, nodes: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box on the page, area share and score of each region (``members``: keys, region_id, node_id)."""
    joined = members.join(nodes, [*keys, "node_id"]).groupBy(*keys, "region_id").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("_y1"), F.max("x2").alias("x2"), F.max("y2").alias("_y2"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("node_count")
    )
    ratio = F.col("area") / F.greatest(F.col("band_area"), F.lit(1))
    placed = joined.join(bands.select(*keys, "band_y1", "band_area"), [*keys]).withColumn("area_ratio", ratio)
    return placed.select(
        *keys, "region_id", "x1", (F.col("_y1") + F.col("band_y1")).cast("int").alias("y1"), "x2", (F.col("_y2") + F.col("band_y1")).cast("int").alias("y2"),
        "node_count", "area_ratio", region_score(F.col("area_ratio"), F.col("node_count")).alias("score"),
    )


@dataclass(frozen=True)
class GrowLimits:
    seeds: int = 8
    semantic: float = 0.50
    visual: float = 0.58
    boundary: float = 0.46
    frontier: int = 24
    min_share: float = 0.03
    max_share: float = 0.72
    merge_semantic: float = 0.78
    merge_boundary: float = 0.30
    min_nodes: int = 3
    min_node_share: float = 0.015


class _Graph:
    """One band's patches; positions follow ascending node id, borders lie in one dict per node."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        nodes = nodes.sort_values("node_id")
        self.ids = nodes["node_id"].to_numpy()
        self.area = nodes["area"].to_numpy(dtype=float)
        self.vectors = np.array(nodes["embedding"].tolist(), dtype=float)
        self.colors = nodes[["mean_b", "mean_g", "mean_r"]].to_numpy(dtype=float)
        self.seeds = nodes["seed_no"].to_numpy(dtype=float)
        spot = {n: i for i, n in enumerate(self.ids)}
        self.near: list[dict[int, float]] = [{} for _ in self.ids]
        for a, b, cost in zip(edges["a"], edges["b"], np.fmin(edges["boundary_cost"].to_numpy(dtype=float), 1.0).tolist()):
            i, j = spot.get(a), spot.get(b)
            if i is not None and j is not None and i != j:
                self.near[i][j] = self.near[j][i] = min(cost, self.near[i].get(j, 1.0))


def _grown(graph: _Graph, seed: int, owner: np.ndarray, limits: GrowLimits) -> list[int]:
    """Extend a seed over its free neighbours, best first, up to the area limit.

    Free neighbours wait with their lowest border and least colour distance, which only newly added nodes can change.
    """
    room = max(1.0, limits.max_share * graph.area.sum())
    region, fresh, area = [seed], [seed], graph.area[seed]
    inside, waiting, total = {seed}, {}, graph.vectors[seed].copy()
    while True:
        for m in fresh:
            waiting.pop(m, None)
            for n, cost in graph.near[m].items():
                if owner[n] < 0 and n not in inside:
                    apart = float(np.linalg.norm(graph.colors[m] - graph.colors[n]))
                    known = waiting.get(n, (cost, apart))
                    waiting[n] = min(known[0], cost), min(known[1], apart)
        if not waiting:
            return region
        free = np.fromiter(waiting, int, len(waiting))
        cost, apart = np.array(list(waiting.values())).T
        visual = np.clip(1.0 - apart / (255.0 * np.sqrt(3.0)), 0.0, 1.0)
        semantic = _cosines(graph.vectors[free], total)
        good = np.flatnonzero((cost <= limits.boundary) & ((semantic >= limits.semantic) | (visual >= limits.visual)))
        score = (0.55 * semantic + 0.30 * visual - 0.35 * cost)[good]
        fresh = []
        for n in free[good[np.lexsort((free[good], score))[::-1][: limits.frontier]]].tolist():
            if area + graph.area[n] <= room:
                fresh.append(n)
                area += graph.area[n]
                total += graph.vectors[n]
        if not fresh:
            return region
        region += fresh
        inside.update(fresh)


def _cosines(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosine of each row with a vector; 0 where either has next to no length."""
    sizes, size = np.linalg.norm(rows, axis=1), float(np.linalg.norm(other))
    flat = (sizes < 1e-8) | (size < 1e-8)
    return np.where(flat, 0.0, (rows @ other) / np.where(flat, 1.0, sizes * size))


class _Regions:
    """Regions in order, with their areas, summed vectors and lowest borders to the regions they touch."""

    def __init__(self, graph: _Graph, members: list[list[int]], owner: np.ndarray):
        self.members = members
        self.area = [float(graph.area[m].sum()) for m in members]
        self.total = [graph.vectors[m].sum(axis=0) for m in members]
        self.border: list[dict[int, float]] = [{} for _ in members]
        for n, near in enumerate(graph.near):
            mine = self.border[owner[n]]
            for m, cost in near.items():
                if (other := int(owner[m])) != owner[n]:
                    mine[other] = min(cost, mine.get(other, cost))

    def join(self, into: int, gone: int) -> None:
        self.members[into] += self.members[gone]
        self.area[into] += self.area[gone]
        self.total[into] = self.total[into] + self.total[gone]
        for other, cost in self.border[gone].items():
            del self.border[other][gone]
            if other != into:
                self.border[into][other] = self.border[other][into] = min(cost, self.border[into].get(other, cost))
        self.members[gone], self.border[gone] = [], {}

    def merge_alike(self, limits: GrowLimits) -> None:
        """Alike regions without a strong border merge, in passes; a vector stays as it was when its turn began."""
        changed = True
        while changed:
            changed = False
            for i in range(len(self.members)):
                own = self.total[i] / max(1, len(self.members[i]))
                todo = sorted(j for j in self.border[i] if j > i)
                while todo:
                    j = heappop(todo)
                    if self.border[i][j] <= limits.merge_boundary and _cosines((self.total[j] / len(self.members[j]))[None], own)[0] >= limits.merge_semantic:
                        for further in self.border[j]:
                            if further > j and further not in self.border[i]:
                                heappush(todo, further)
                        self.join(i, j)
                        changed = True

    def absorb_tiny(self, limits: GrowLimits) -> None:
        """The first tiny region joins the neighbour behind its lowest border, until none can.

        A tiny region whose borders are all of cost 1 never gets another, so each is looked at once.
        """
        least = max(1.0, sum(self.area) * limits.min_node_share)
        tiny = lambda r: self.members[r] and (len(self.members[r]) < limits.min_nodes or self.area[r] < least)
        for r in range(len(self.members)):
            if tiny(r):
                cost, best = min(((c, j) for j, c in self.border[r].items()), default=(1.0, r))
                if cost < 1.0:
                    self.join(best, r)


STAGES = ("grow", "orphans", "merge", "absorb")


def _regions_of(graph: _Graph, limits: GrowLimits, stage: str) -> list[list[int]]:
    total = float(graph.area.sum())
    owner = np.full(len(graph.ids), -1)
    regions: list[list[int]] = []
    for seed in sorted(np.flatnonzero(~np.isnan(graph.seeds)).tolist(), key=lambda n: graph.seeds[n]):
        if owner[seed] < 0:
            region = _grown(graph, seed, owner, limits)
            if graph.area[region].sum() >= max(1.0, limits.min_share * total):
                owner[region] = len(regions)
                regions.append(region)
    if stage == "grow":
        return regions

    # Left-over nodes join the region behind their lowest border, or start one.
    for n in np.flatnonzero(owner < 0).tolist():
        cost, best = min(((c, int(owner[m])) for m, c in graph.near[n].items() if owner[m] >= 0), default=(1.0, 0))
        if cost >= 1.0 or cost > limits.boundary:
            best = len(regions)
            regions.append([])
        owner[n] = best
        regions[best].append(n)
    if stage == "orphans":
        return regions

    found = _Regions(graph, regions, owner)
    found.merge_alike(limits)
    if stage == "absorb":
        found.absorb_tiny(limits)
    return [r for r in found.members if r]


def grow_regions(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], limits: GrowLimits = GrowLimits(), stage: str = "absorb") -> DataFrame:
    """Partition each band's patches into regions: (keys, region_id, node_id).

    ``stage`` stops after growing from seeds, attaching left-over nodes, merging alike
    regions, or, the default, absorbing tiny ones.  A null border cost counts as 1, of several
    borders of a pair the lowest counts.  Each band is one pandas call whose memory and time
    follow its nodes and edges.
    """
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    seeds = seed_rank(nodes, keys, limits.seeds).select(*keys, "node_id", "seed_no")
    picked = nodes.join(seeds, [*keys, "node_id"], "left").select(
        *keys, "node_id", "area", "mean_b", "mean_g", "mean_r", "embedding", F.col("seed_no").cast("double").alias("seed_no")
    )
    schema = picked.select(*keys, F.lit(0).alias("region_id"), "node_id").schema

    def solve(group_nodes: pd.DataFrame, group_edges: pd.DataFrame) -> pd.DataFrame:
        if group_nodes.empty:
            return pd.DataFrame(columns=schema.names)
        graph = _Graph(group_nodes, group_edges)
        rows = [(rid, graph.ids[n]) for rid, region in enumerate(_regions_of(graph, limits, stage)) for n in region]
        out = pd.DataFrame(rows, columns=["region_id", "node_id"])
        for key in keys:
            out[key] = group_nodes[key].iloc[0]
        return out[schema.names]

    slim = edges.select(*keys, "a", "b", "boundary_cost").toDF(*keys, "a", "b", "boundary_cost")
    return picked.groupBy(*keys).cogroup(slim.groupBy(*keys)).applyInPandas(solve, schema)
