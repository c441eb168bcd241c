"""Box and point arithmetic as Column expressions.

A box is half-open, in pixels, held in four integer columns.  Integers are cut
toward zero where a quad is not explicitly floored and ceiled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> "Box":
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))

    def aliased(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}{suffix}") for c, n in zip(self, ("x1", "y1", "x2", "y2"))]

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def empty(self) -> Column:
        return (self.x2 <= self.x1) | (self.y2 <= self.y1)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) * F.lit(0.5), (self.y1 + self.y2) * F.lit(0.5)

    @property
    def diagonal(self) -> Column:
        return F.hypot(self.width.cast("double"), self.height.cast("double"))


def clip(value: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(value, low), high)


def or_zero(box: Box, bad: Column) -> Box:
    return Box(*(F.when(bad, F.lit(0)).otherwise(c) for c in box))


def clamp(box: Box, width: Column, height: Column) -> Box:
    inside = Box(clip(box.x1, 0, width), clip(box.y1, 0, height), clip(box.x2, 0, width), clip(box.y2, 0, height))
    return or_zero(inside, inside.empty)


def area(box: Box) -> Column:
    return F.greatest(box.width, F.lit(0)).cast("double") * F.greatest(box.height, F.lit(0)).cast("double")


def intersects(a: Box, b: Box) -> Column:
    return (F.greatest(a.x1, b.x1) < F.least(a.x2, b.x2)) & (F.greatest(a.y1, b.y1) < F.least(a.y2, b.y2))


def intersection(a: Box, b: Box) -> Column:
    return area(Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)))


def iou(a: Box, b: Box, floor_union: bool = True) -> Column:
    """Overlap over union; ``floor_union`` keeps the union at one pixel or more."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    ratio = inter / F.greatest(union, F.lit(1.0)) if floor_union else F.when(union > 0, inter / union)
    return F.when(inter > 0, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    return intersection(inner, outer) / F.greatest(area(inner), F.lit(1.0))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def x_overlap_ratio(a: Box, b: Box) -> Column:
    shared = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0)).cast("double")
    return shared / F.greatest(F.least(a.width, b.width), F.lit(1))


def y_gap(a: Box, b: Box) -> Column:
    return F.greatest(b.y1 - a.y2, a.y1 - b.y2, F.lit(0))


def center_distance(a: Box, b: Box) -> Column:
    """Distance of the centres over the smaller diagonal."""
    (ax, ay), (bx, by) = a.center, b.center
    return F.hypot(ax - bx, ay - by) / F.greatest(F.least(a.diagonal, b.diagonal), F.lit(1.0))


def normalize(box: Box, width: Column, height: Column) -> Box:
    bad = (width <= 0) | (height <= 0)

    def part(value: Column, size: Column) -> Column:
        return F.when(bad, F.lit(0.0)).otherwise(clip(value / F.when(~bad, size), 0.0, 1.0))

    return Box(part(box.x1, width), part(box.y1, height), part(box.x2, width), part(box.y2, height))


def from_quad(quad: Column, stored: Box, mode: str = "outward") -> Box:
    """Bounds of a four-point quad, else the stored box.

    ``outward`` floors the low and ceils the high corner; ``truncate`` cuts both toward zero.
    """
    if mode not in ("outward", "truncate"):
        raise ValueError("mode must be outward or truncate")
    xs = F.transform(quad, lambda p: F.element_at(p, 1))
    ys = F.transform(quad, lambda p: F.element_at(p, 2))
    lows, highs = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    if mode == "outward":
        lows, highs = tuple(F.floor(v) for v in lows), tuple(F.ceil(v) for v in highs)
    bounds = Box(*(v.cast("int") for v in (*lows, *highs)))
    good = quad.isNotNull() & (F.size(quad) == 4)
    return Box(*(F.when(good, q).otherwise(s) for q, s in zip(bounds, stored)))


def to_quad(box: Box) -> Column:
    """Corners clockwise from the top left."""
    x1, y1, x2, y2 = (c.cast("double") for c in box)
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def resolve(quad: Column, stored: Box, source: Column, width: Column, height: Column) -> tuple[Box, Box, Column]:
    """(box, box in canvas shares, geometry source): the quad wins over the stored box."""
    good = quad.isNotNull() & (F.size(quad) == 4)
    box = from_quad(quad, or_zero(stored, area(stored) <= 0))
    named = F.when(F.coalesce(source, F.lit("")) != "", source)
    return box, normalize(box, width, height), F.coalesce(named, F.when(good, F.lit("quad")).otherwise(F.lit("bbox")))


def relative_to_panel(box: Box, panel: Box) -> Box:
    w, h = F.greatest(panel.width, F.lit(0)), F.greatest(panel.height, F.lit(0))
    moved = Box(
        clip(box.x1 - panel.x1, 0, w), clip(box.y1 - panel.y1, 0, h), clip(box.x2 - panel.x1, 0, w), clip(box.y2 - panel.y1, 0, h)
    )
    return or_zero(moved, moved.empty)


def expand(box: Box, scale: float, width: Column, height: Column) -> Box:
    """Scale about the centre, sides at least one pixel, clipped to the canvas."""
    cx, cy = box.center
    half_w = F.greatest(box.width, F.lit(1)) * F.lit(0.5 * scale)
    half_h = F.greatest(box.height, F.lit(1)) * F.lit(0.5 * scale)
    return Box(
        clip(F.floor(cx - half_w).cast("int"), 0, width),
        clip(F.floor(cy - half_h).cast("int"), 0, height),
        clip(F.ceil(cx + half_w).cast("int"), 0, width),
        clip(F.ceil(cy + half_h).cast("int"), 0, height),
    )


def pad_to_page(box: Box, pad: int, width: Column, height: Column, full_width: bool = False) -> Box:
    x1 = F.lit(0) if full_width else F.greatest(box.x1 - pad, F.lit(0))
    x2 = width if full_width else F.least(box.x2 + pad, width)
    return Box(x1, F.greatest(box.y1 - pad, F.lit(0)), x2, F.least(box.y2 + pad, height))


def gap_connected(a: Box, b: Box, gap_x: Column, gap_y: Column) -> Column:
    """True when the boxes touch after one of them grows by the gaps, borders included."""
    return (
        (a.x2 + gap_x >= b.x1) & (b.x2 + gap_x >= a.x1) & (a.y2 + gap_y >= b.y1) & (b.y2 + gap_y >= a.y1)
    )


def text_panel_score(text: Box, panel: Box) -> tuple[Column, Column, Column]:
    """(score, overlap share of the text, normalised centre distance)."""
    overlap = containment(text, panel)
    distance = center_distance(text, panel)
    score = clip(F.lit(0.7) * overlap + F.lit(0.3) * clip(F.lit(1.0) - distance, 0.0, 1.0), 0.0, 1.0)
    return score, overlap, distance


def region_score(area_ratio: Column, node_count: Column) -> Column:
    return clip(F.lit(0.65) * area_ratio + F.lit(0.35) * F.least(node_count / F.lit(8.0), F.lit(1.0)), 0.0, 1.0)


def band_content_score(white_mean: Column, edge_mean: Column, edge_ref: float = 0.02) -> Column:
    non_white = clip(F.lit(1.0) - white_mean, 0.0, 1.0)
    edges = clip(clip(edge_mean, 0.0, 1.0) / F.lit(max(edge_ref, 1e-6)), 0.0, 1.0)
    return clip(F.lit(0.6) * non_white + F.lit(0.4) * edges, 0.0, 1.0)


def fit_within(width: Column, height: Column, long_edge: int, short_edge: int) -> tuple[Column, Column, Column]:
    """(scale, width, height) so that neither edge exceeds its limit; never enlarges, and leaves an image without area as it is."""
    scale = F.when(F.least(width, height) > 0, F.least(
        F.lit(1.0), F.lit(float(long_edge)) / F.greatest(width, height), F.lit(float(short_edge)) / F.least(width, height)
    )).otherwise(1.0)

    def sized(edge: Column) -> Column:
        scaled = F.greatest(F.bround(edge * scale, 0).cast("int"), F.lit(1))
        return F.when(scale >= 0.9999, edge).otherwise(scaled)

    return scale, sized(width), sized(height)


def rescale_quad(quad: Column, scale_x: Column, scale_y: Column) -> Column:
    return F.transform(quad, lambda p: F.array(F.element_at(p, 1) * scale_x, F.element_at(p, 2) * scale_y))
