"""Layers of a page: texts, paths, and which layers hold text or bubbles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import geometry as G
from panelweave.functions.geometry import Box
from panelweave.functions.text import strip
from panelweave.operators.spread import row_numbers
from panelweave.session import cut_lineage

# Layer kinds that carry text of their own.
TEXT_KINDS = ("type", "text")


def layer_texts(layers: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Texts of text layers, numbered in layer order after the empty ones are gone."""
    box = G.clamp(Box.named(), F.lit(width), F.lit(height))
    text = strip(F.replace(F.coalesce("layer_text", F.lit("")), F.lit("\r"), F.lit("\n")))
    kept = layers.where(F.col("kind").isin(*TEXT_KINDS)).select(*keys, "layer_id", text.alias("text"), *box.aliased())
    kept = kept.where((G.area(Box.named()) > 0) & (F.col("text") != ""))
    numbered = row_numbers(kept, keys, [F.col("layer_id")], name="_no")
    return numbered.withColumns({"text_id": F.format_string("psd_%03d", "_no"), "conf": F.lit(1.0)}).drop("_no")


def layer_paths(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path ``name#id/...`` from the root and running number of every layer.

    Each round doubles how far up a path reaches, so that a tree of depth d takes log2(d) joins.  A round that finishes
    no path means that the rest lie in or below a circle, which is an error.
    """
    numbered = row_numbers(tree, keys, [F.col("pos")], name="number")
    paths = cut_lineage(numbered.select(*keys, "layer_id", "number", F.col("above").alias("_up"), F.concat("name", F.lit("#"), "layer_id").alias("path")))
    before = None
    while open_ := paths.where("_up IS NOT NULL").count():
        if open_ == before:
            raise ValueError("layers are nested in a circle")
        before = open_
        upper = paths.select(*keys, F.col("layer_id").alias("_up"), F.col("path").alias("_head"), F.col("_up").alias("_next"))
        joined = paths.join(upper, [*keys, "_up"], "left")
        paths = cut_lineage(joined.select(*keys, "layer_id", "number", F.col("_next").alias("_up"), F.concat_ws("/", "_head", "path").alias("path")))
    return paths.drop("_up")


def overlap_ratio() -> Column:
    return G.clip(F.col("overlap_pixels") / F.greatest(F.col("layer_pixels"), F.lit(1)).cast("double"), 0.0, 1.0)


def raster_text_layers(layers: DataFrame, unions: DataFrame, keys: Sequence[str], width: int, height: int, least: float = 0.85, min_pixels: int = 20) -> DataFrame:
    """Why each layer is or is not drawn text: its pixels lie in the text areas (``unions``: keys, u_ box).

    Pages without text areas have no such layers and give no rows.
    """
    box = G.clamp(Box.named(), F.lit(width), F.lit(height))
    reason = (
        F.when(F.col("is_excluded"), "excluded").when(~F.col("visible"), "not_visible").when(F.col("kind") == "group", "group_skip")
        .when(G.area(box) <= 0, "empty_bbox").when(~G.intersects(box, Box.named("u_")), "bbox_no_intersect")
        .when(F.col("layer_pixels") < min_pixels, "min_pixels").when(F.col("overlap_ratio") >= least, "ratio_pass").otherwise("ratio_below_thr")
    )
    return layers.join(unions, [*keys]).withColumn("overlap_ratio", overlap_ratio()).withColumn("reason", reason)


def bubble_layers(layers: DataFrame, canvas_area: float, least: float = 0.35, min_pixels: int = 20) -> DataFrame:
    """Why each layer is or is not a speech bubble; groups may be."""
    reason = (
        F.when(F.col("is_excluded"), "excluded").when(~F.col("visible"), "not_visible").when(F.col("layer_pixels") < min_pixels, "min_pixels")
        .when(F.col("overlap_ratio") < least, "rejected_below_thr").otherwise("ratio_pass")
    )
    scored = layers.withColumns({"overlap_ratio": overlap_ratio(), "bubble_area_ratio": F.col("layer_pixels") / F.lit(max(canvas_area, 1.0))})
    return scored.withColumn("reason", reason)


def accepted_in_order(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted layers by overlap, then the smaller area, then layer order."""
    passed = judged.where("reason = 'ratio_pass'")
    area = [F.col("bubble_area_ratio")] if "bubble_area_ratio" in judged.columns else []
    return row_numbers(passed, keys, [F.desc("overlap_ratio"), *area, F.col("layer_id")], name="place")


def slowest(judged: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` slowest evaluated layers of each page."""
    seen = judged.where(~F.col("reason").isin("excluded", "not_visible"))
    order = Window.partitionBy(*keys).orderBy(F.desc("rgba_elapsed_ms"), "layer_id")
    return seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def decode_stats(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    seen = ~F.col("reason").isin("excluded", "not_visible")
    spent = F.when(seen, F.col("rgba_elapsed_ms"))
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("layers_total"), F.count_if(seen).alias("layers_evaluated"), F.count_if(F.col("reason") == "ratio_pass").alias("layers_accepted"),
        F.coalesce(F.sum(spent), F.lit(0)).alias("sum_ms"), (F.coalesce(F.sum(spent), F.lit(0)) / F.greatest(F.count(spent), F.lit(1))).alias("avg_ms"),
        F.coalesce(F.max(spent), F.lit(0)).alias("max_ms"),
    )


def pixel_overlap(pixels: DataFrame, rects: DataFrame, keys: Sequence[str], layer: str = "layer_id", alpha: int = 10, cell: int = 64) -> DataFrame:
    """Opaque pixels per layer and how many of them lie in any rectangle of the page."""
    opaque = pixels.where(F.col("alpha") > alpha).withColumns({"_cx": F.floor(F.col("x") / F.lit(cell)), "_cy": F.floor(F.col("y") / F.lit(cell))})
    tiles = rects.where("x2 > x1 AND y2 > y1").select(*keys, "x1", "y1", "x2", "y2").distinct()
    for low, high, name in (("x1", "x2", "_cx"), ("y1", "y2", "_cy")):
        tiles = tiles.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / F.lit(cell)), F.floor((F.col(high) - 1) / F.lit(cell)))))
    same = [F.col(f"p.{k}") == F.col(f"t.{k}") for k in [*keys, "_cx", "_cy"]]
    within = (F.col("p.x") >= F.col("t.x1")) & (F.col("p.x") < F.col("t.x2")) & (F.col("p.y") >= F.col("t.y1")) & (F.col("p.y") < F.col("t.y2"))
    inside = opaque.alias("p").join(tiles.alias("t"), [*same, within], "left_semi").groupBy(*keys, layer).agg(F.count(F.lit(1)).alias("overlap_pixels"))
    total = opaque.groupBy(*keys, layer).agg(F.count(F.lit(1)).alias("layer_pixels"))
    counted = total.join(inside, [*keys, layer], "left").fillna(0, ["overlap_pixels"])
    return counted.withColumn("overlap_ratio", overlap_ratio())


def removed_layers(keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Distinct layers of all parts."""
    out = parts[0].select(*keys, "layer_id")
    for part in parts[1:]:
        out = out.unionByName(part.select(*keys, "layer_id"))
    return out.distinct()


def exclusion_split(generic: DataFrame, text: DataFrame, raster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each excluded layer with the strongest cause: text, raster, else generic."""
    ranks = [(text, 0), (raster, 1), (generic, 2)]
    tagged = [df.select(*keys, "layer_id", F.lit(rank).alias("_rank")) for df, rank in ranks]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    cause = F.element_at(F.array(F.lit("text"), F.lit("raster"), F.lit("generic")), F.min("_rank") + 1)
    return both.groupBy(*keys, "layer_id").agg(cause.alias("cause"))
