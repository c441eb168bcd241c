"""Dialogue texts on pages: matching two sources, grouping boxes, finding panels.

Text ids are unique across pages and ascend in list order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import geometry as G
from panelweave.functions.geometry import Box
from panelweave.functions.text import SIMILARITIES, normalize_text, reachable
from panelweave.operators.rounds import components, matched
from panelweave.operators.spatial import nearest_by_center, touching, touching_pairs
from panelweave.operators.spread import row_numbers
from panelweave.session import cut_lineage, dealt, free_files


def _reach(box: Box, factor: float) -> Box:
    """The box and the square of half side ``factor`` diagonals about its centre."""
    far = F.greatest(box.diagonal, F.lit(1.0)) * F.lit(factor)
    cx, cy = box.center
    return Box(
        F.least(box.x1, F.floor(cx - far)), F.least(box.y1, F.floor(cy - far)),
        F.greatest(box.x2, F.ceil(cx + far)), F.greatest(box.y2, F.ceil(cy + far)),
    )


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


def panel_candidates(texts: DataFrame, panels: DataFrame, keys: Sequence[str], min_score: float = 0.15, cell: int = 256) -> DataFrame:
    """Text and panel pairs of a page scoring at least ``min_score``.

    A pair scores only by overlap or by a centre distance under one text
    diagonal, so that far panels are never paired.
    """
    if min_score <= 0:
        raise ValueError("min_score must be positive, or every pair would qualify")
    box, panel = Box.named(), Box.named("p_")
    pairs = touching_pairs(
        texts.select(*keys, "text_id", "x1", "y1", "x2", "y2"),
        _renamed(panels.select(*keys, "panel_id", "x1", "y1", "x2", "y2"), keys, "p_"),
        keys, _reach(box, max(0.0, 1.0 - min_score / 0.3)), panel, cell,
    )
    score, overlap, distance = G.text_panel_score(box, panel)
    scored = pairs.select(*keys, "text_id", F.col("p_panel_id").alias("panel_id"), score.alias("score"),
                          overlap.alias("overlap_ratio"), distance.alias("center_distance_norm"))
    return scored.where(F.col("score") >= min_score)


def best_candidates(candidates: DataFrame, keys: Sequence[str], top: int = 3) -> DataFrame:
    """Best panels per text: score, then overlap, then panel order."""
    order = Window.partitionBy(*keys, "text_id").orderBy(F.desc("score"), F.desc("overlap_ratio"), "panel_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, top))


def assign_panels(texts: DataFrame, panels: DataFrame, keys: Sequence[str], top: int = 3, min_score: float = 0.15) -> DataFrame:
    """One row per text with its first panel, score and candidate list."""
    best = best_candidates(panel_candidates(texts, panels, keys, min_score), keys, top)
    item = F.struct("rank", "panel_id", "score", "overlap_ratio", "center_distance_norm")
    lists = best.groupBy(*keys, "text_id").agg(F.array_sort(F.collect_list(item)).alias("candidate_panels"))
    return texts.select(*keys, "text_id").join(lists, [*keys, "text_id"], "left").select(
        *keys, "text_id", F.col("candidate_panels")[0]["panel_id"].alias("primary_panel_id"),
        F.coalesce(F.col("candidate_panels")[0]["score"], F.lit(0.0)).alias("assignment_score"), "candidate_panels",
        F.lit("overlap+center").alias("method"),
    )


def nearest_panels(texts: DataFrame, panels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Panel with the nearest centre; ties go to the larger overlap, then the earlier panel."""
    panels = panels.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("panel_id").alias("panel_id"))
    panel, box = Box.named("p_"), Box.named()
    squared = (F.col("_px") - F.col("_tx")) * (F.col("_px") - F.col("_tx")) + (F.col("_py") - F.col("_ty")) * (F.col("_py") - F.col("_ty"))
    found = nearest_by_center(
        texts.select(*keys, "text_id", "x1", "y1", "x2", "y2"), _renamed(panels, keys, "p_"), keys, box.center, panel.center,
        ["text_id"], [squared, -G.containment(box, panel), F.col("p_panel_id")], ["p_panel_id"],
    )
    joined = texts.select(*keys, "text_id").join(found, [*keys, "text_id"], "left")
    return joined.select(*keys, "text_id", F.col("p_panel_id").alias("panel_id"), F.lit("nearest_center").alias("method"))


def unify(texts: DataFrame, mapping: DataFrame, panels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts with their panel's box and their place in it; the last mapping and panel row of an id count.

    ``candidate_panels`` are those of the mapping, an empty list where it has none.
    """
    kind = dict(mapping.dtypes).get("candidate_panels", "array<struct<rank:int,panel_id:bigint,score:double>>")
    told = mapping.withColumn("candidate_panels", _optional(mapping, "candidate_panels", kind))
    last = told.groupBy(*keys, "text_id").agg(F.max_by(F.struct("primary_panel_id", "assignment_score", "candidate_panels"), "ord").alias("m"))
    boxes = panels.groupBy(*keys, F.col("panel_id").alias("primary_panel_id")).agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), "ord").alias("p"))
    joined = texts.join(last, [*keys, "text_id"], "left").withColumn("primary_panel_id", F.col("m.primary_panel_id"))
    # Panels grow with the texts: merged, so that their boxes need not go through the driver.
    joined = joined.join(boxes.hint("merge"), [*keys, "primary_panel_id"], "left")
    known = F.col("p").isNotNull()
    panel = Box(*(F.col(f"p.{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = G.relative_to_panel(Box.named(), panel)
    return joined.select(
        *keys, "text_id", "text", *Box.named().aliased(), F.when(known, F.col("primary_panel_id")).alias("primary_panel_id"),
        *panel.aliased("panel_"), *(F.when(known, c).alias(f"rel_{n}") for c, n in zip(inside, ("x1", "y1", "x2", "y2"))),
        F.coalesce("m.assignment_score", F.lit(0.0)).alias("assignment_score"), F.coalesce("m.candidate_panels", F.array().cast(kind)).alias("candidate_panels"),
        F.when(known, F.lit("assigned")).otherwise(F.lit("unassigned")).alias("status"),
    )


def reading_order(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the assigned texts of each panel from top to bottom, then left to right."""
    assigned = items.where("status = 'assigned'")
    return row_numbers(assigned, [*keys, "primary_panel_id"], [F.col("rel_y1"), F.col("rel_x1"), F.col("text_id")], name="reading_no")


def match_edges(
    layer_texts: DataFrame, ocr_texts: DataFrame, keys: Sequence[str], similarity: str = "edit", cell: int = 128, crowd: int = 1024
) -> DataFrame:
    """Pairs of a layer text and an OCR text that may be one: near, and alike.

    Geometry narrows the pairs first, then the texts' lengths; texts are compared only then.  Texts are normalised
    before they are paired, once each.  They move once, to the task of their page, where they are paired and compared.
    Only on pages of more than ``crowd`` boxes do they meet in grid cells, and their pairs are dealt out evenly, since
    comparing is the costly part.
    """
    box, other, reach = Box.named(), Box.named("o_"), Box.named("_reach_")
    boxes = layer_texts.select(*keys).unionByName(ocr_texts.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    crowded = cut_lineage(boxes.where(F.col("_n") > crowd).select(*keys))
    any_crowded = not crowded.isEmpty()

    def sides(how: str) -> tuple[DataFrame, DataFrame]:
        """Texts of crowded pages or of the others, whose keys are at most one for every ``crowd`` boxes."""
        one, two = (df.join(F.broadcast(crowded), [*keys], how) if any_crowded else df for df in (layer_texts, ocr_texts))
        pick = [*keys, "text_id", normalize_text(F.col("text")).alias("text"), "x1", "y1", "x2", "y2"]
        return one.select(*pick, *_reach(box, 0.25).aliased("_reach_")), _renamed(two.select(*pick), keys, "o_")

    def near(pairs: DataFrame) -> DataFrame:
        found = pairs.withColumns({"iou": G.iou(box, other, floor_union=False), "distance": G.center_distance(box, other)}).where("iou >= 0.35 OR distance <= 0.25")
        found = found.withColumn("geom_score", F.greatest(F.col("iou"), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance"))))
        found = found.withColumn("_need", F.when(F.col("geom_score") >= 0.70, F.lit(0.65)).otherwise(F.lit(0.999)))
        found = found.where(reachable(similarity, F.col("text"), F.col("o_text"), F.col("_need")))
        return found.select(*keys, "text_id", "o_text_id", "text", "o_text", "geom_score", "_need")

    layer, ocr = sides("left_anti")
    pairs = near(dealt(layer, *keys).join(dealt(ocr, *keys).hint("merge"), [*keys]).where(touching(reach, other)))
    if any_crowded:
        pairs = pairs.unionByName(dealt(near(touching_pairs(*sides("left_semi"), keys, reach, other, cell)), *keys, "text_id", "o_text_id"))
    score = SIMILARITIES[similarity](F.col("text"), F.col("o_text"), F.col("_need"), normalized=True)
    # Kept as the elements of a list of one: a filter by a column would be worked out below the dealing, and the column once more.
    alike = pairs.withColumn("text_score", F.explode(F.filter(F.array(score), lambda s: s >= F.col("_need"))))
    return alike.select(
        *keys, F.col("text_id").alias("layer_text_id"), F.col("o_text_id").alias("ocr_text_id"), "geom_score", "text_score",
        (0.7 * F.col("geom_score") + 0.3 * F.col("text_score")).alias("weight"),
    )


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _copies(df: DataFrame, keys: Sequence[str], text_id: str, order: Sequence[str]) -> DataFrame:
    """Add ``_key``, which is equal to itself where a key is null, and ``_copy``, which tells rows of one key apart."""
    keyed = df.withColumn("_key", F.struct(*keys, F.col(text_id).alias("_id"))).drop(*keys, text_id)
    return keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))


def _with_key(df: DataFrame, side: DataFrame, prefix: str, how: str = "inner") -> DataFrame:
    """Rows of ``df`` with the row of ``side`` that their ``<prefix>key`` and ``<prefix>copy`` name; any copy if ``df`` has no copies."""
    side = side.withColumnsRenamed({"_key": f"{prefix}key", "_copy": f"{prefix}copy" if f"{prefix}copy" not in df.columns else "_of"})
    if "_of" not in side.columns:
        return df.join(side.hint("merge"), f"{prefix}key", how)
    # The copies are no key of the join, so that it meets rows as the copies' window has laid them out.
    same = (df[f"{prefix}key"] == side[f"{prefix}key"]) & (F.col(f"{prefix}copy") - F.col("_of") == 0)
    return df.join(side.hint("merge"), same, how).drop(side[f"{prefix}key"], "_of")


def merge_sources(layer_texts: DataFrame, ocr_texts: DataFrame, keys: Sequence[str], similarity: str = "edit") -> DataFrame:
    """Match both sources one to one, keep what is unmatched, and renumber per page.

    A match takes its text and layer from the layer side.  Its place is the OCR quad, else the layer's quad, else the
    layer's box; a quad gives the box that holds it.  Where OCR texts have no column ``quad``, their boxes are their
    quads.  Matches of a page are groups ``m_001`` ... by weight.  Layers may have ``quad``, ``layer_id``, ``layer_path``
    and ``geom_source``.  Ids are of any ordered type, unique within ``keys``.

    Rows are matched and numbered by ids and places only; texts and quads are joined to them at the end.
    """
    spark = layer_texts.sparkSession
    edges = cut_lineage(match_edges(layer_texts, ocr_texts, keys, similarity).select(*keys, "layer_text_id", "ocr_text_id", "weight"))
    free_files(spark)
    pairs = matched(edges, "layer_text_id", "ocr_text_id", "weight", within=keys)
    pairs = cut_lineage(row_numbers(pairs, keys, [F.desc("weight"), F.col("layer_text_id"), F.col("ocr_text_id")], name="_group"))
    quads = "array<array<double>>"
    own = [_optional(layer_texts, c, kind).alias(c) for c, kind in (("layer_id", "long"), ("layer_path", "string"))]
    layer = layer_texts.select(*keys, "text_id", F.col("text").alias("l_text"), *Box.named().aliased("l_"), _optional(layer_texts, "quad", quads).alias("l_quad"), _optional(layer_texts, "geom_source", "string").alias("l_geom"), *own)
    ocr_quad = F.col("quad") if "quad" in ocr_texts.columns else G.to_quad(Box.named())
    ocr = ocr_texts.select(*keys, "text_id", F.col("text").alias("o_text"), *Box.named().aliased("o_"), "conf", ocr_quad.alias("o_quad"), _optional(ocr_texts, "geom_source", "string").alias("o_geom"))

    def there(quad: str) -> Column:
        return F.when(F.size(quad) > 0, F.col(quad))

    def placed(df: DataFrame, side: str) -> DataFrame:
        """With the place that a text has by itself, by which its copies are told apart, and what its quad can say of another's."""
        box = G.from_quad(there(f"{side}quad"), Box.named(side))
        at = {f"{side}y": box.y1, f"{side}x": box.x1, f"{side}there": F.size(f"{side}quad") > 0, f"{side}good": F.size(f"{side}quad") == 4}
        return _copies(df.withColumns(at), keys, "text_id", [*at, f"{side}y1", f"{side}x1"])

    layer, ocr = placed(layer, "l_"), placed(ocr, "o_")
    ends = [F.struct(*keys, F.col(c).alias("_id")).alias(f"{side}key") for side, c in (("l_", "layer_text_id"), ("o_", "ocr_text_id"))]
    met = pairs.select(*ends, (-F.col("weight")).alias("_place"), "_group")

    def place(axis: str) -> Column:
        return F.when(F.col("o_there"), F.when(F.col("o_good"), F.col(f"o_{axis}")).otherwise(F.col(f"l_{axis}1"))).otherwise(F.col(f"l_{axis}")).alias(f"{axis}1")

    def listed(df: DataFrame, rank: int, y: Column, x: Column) -> DataFrame:
        key, other = ("o_", "l_") if rank == 1 else ("l_", "o_")
        return df.select(
            *(F.col(f"{key}key.{c}").alias(c) for c in keys), y, x, F.lit(rank).alias("_rank"), F.lit(0.0).alias("_place") if rank else F.col("_place"), F.col(f"{key}key._id").alias("_id"), F.col(f"{key}copy").alias("_copy"),
            (F.lit(None).cast(df.schema[f"{key}key"].dataType["_id"].dataType) if rank else F.col(f"{other}key._id")).alias("_other"), (F.lit(None).cast("int") if rank else F.col(f"{other}copy")).alias("_other_copy"),
            (F.lit(None).cast("int") if rank else F.col("_group")).alias("_group"),
        )

    slim_layer, slim_ocr = layer.select("_key", "_copy", "l_y", "l_x", "l_y1", "l_x1"), ocr.select("_key", "_copy", "o_y", "o_x", "o_there", "o_good")
    rows = listed(_with_key(_with_key(met, slim_layer, "l_"), slim_ocr, "o_"), 0, place("y"), place("x"))
    for rank, side, prefix in ((1, slim_ocr, "o_"), (2, slim_layer, "l_")):
        alone = side.withColumnsRenamed({"_key": f"{prefix}key", "_copy": f"{prefix}copy"}).join(met.select(f"{prefix}key").hint("merge"), f"{prefix}key", "left_anti")
        rows = rows.unionByName(listed(alone, rank, F.col(f"{prefix}y").alias("y1"), F.col(f"{prefix}x").alias("x1")))
    numbered = renumber(rows, keys, [F.col("_rank"), F.col("_place"), F.col("_id")])
    del edges, pairs, met, rows, alone
    free_files(spark)

    def refer(df: DataFrame, prefix: str, text_id: str, copy: str) -> DataFrame:
        key = F.struct(*keys, F.col(text_id).alias("_id"))
        return df.withColumns({f"{prefix}key": F.when(F.col(copy).isNotNull(), key), f"{prefix}copy": F.col(copy)})

    def out(df: DataFrame, status: Column, quad: Column, named: str, geometry: Column, conf: Column, source: str) -> DataFrame:
        layered = [F.col(c) for c in ("layer_id", "layer_path") if c in df.columns]
        return df.withColumn("quad", quad).select(
            *keys, F.col(f"{named}text").alias("text"), *G.from_quad(F.col("quad"), Box.named(named)).aliased(), conf.alias("conf"), status.alias("merge_status"), F.lit(source).alias("text_source"),
            "quad", *layered, F.when(F.col("_group").isNotNull(), F.format_string("m_%03d", "_group")).alias("merge_group_id"), geometry.alias("geom_source"), "text_id",
        )

    of_layer = refer(refer(numbered.where("_rank <> 1"), "l_", "_id", "_copy"), "o_", "_other", "_other_copy")
    of_layer = _with_key(_with_key(of_layer, ocr.select("_key", "_copy", "o_quad", "conf"), "o_", "left"), layer, "l_")
    is_met = F.col("_rank") == 0
    geometry = F.when(is_met, F.when(F.size("o_quad") > 0, "ocr_quad").otherwise("psd_bbox")).otherwise(F.coalesce("l_geom", F.lit("psd_bbox")))
    told = out(of_layer, F.when(is_met, "matched").otherwise("unmatched_psd"), F.coalesce(there("o_quad"), there("l_quad")), "l_", geometry, F.greatest(F.lit(1.0), F.when(is_met, F.col("conf"))), "psd")
    of_ocr = _with_key(refer(numbered.where("_rank = 1"), "o_", "_id", "_copy"), ocr, "o_")
    return told.unionByName(out(of_ocr, F.lit("unmatched_ocr"), there("o_quad"), "o_", F.coalesce("o_geom", F.lit("ocr_quad")), F.col("conf"), "ocr"), allowMissingColumns=True)


def renumber(texts: DataFrame, keys: Sequence[str], ties: Sequence[Column], name: str = "text_id", label: str = "text") -> DataFrame:
    """New ids ``text_001`` ... per page, from top to bottom, then left to right."""
    numbered = row_numbers(texts, keys, [F.col("y1"), F.col("x1"), *ties], name="_no")
    return numbered.withColumn(name, F.format_string(f"{label}_%03d", "_no")).drop("_no")


def gap_params(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal and vertical gap per page from the median text height."""
    height = F.greatest(F.col("y2") - F.col("y1"), F.lit(1))
    median = boxes.groupBy(*keys).agg(F.percentile(height, 0.5).alias("median_h"))

    def gap(share: float, top: int) -> Column:
        return G.clip(F.bround(F.col("median_h") * share, 0).cast("int"), 2, top)

    return median.select(*keys, "median_h", gap(0.40, 72).alias("gap_x"), gap(0.60, 96).alias("gap_y"))


def clipped_boxes(texts: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    box = Box.named()
    inside = Box(G.clip(box.x1, 0, width), G.clip(box.y1, 0, height), G.clip(box.x2, 0, width), G.clip(box.y2, 0, height))
    return texts.select(*keys, "text_id", *inside.aliased()).where("x2 > x1 AND y2 > y1")


def gap_links(boxes: DataFrame, keys: Sequence[str], cell: int = 256) -> DataFrame:
    """Pairs (a < b) of boxes of a page that touch once grown by the page's gaps."""
    grown = boxes.join(gap_params(boxes, keys), [*keys])
    box = Box.named()
    wide = Box(box.x1 - F.col("gap_x"), box.y1 - F.col("gap_y"), box.x2 + F.col("gap_x"), box.y2 + F.col("gap_y"))
    pairs = touching_pairs(grown, _renamed(boxes, keys, "o_"), keys, wide, Box.named("o_"), cell, also=F.col("text_id") < F.col("o_text_id"))
    return pairs.select(*keys, F.col("text_id").alias("a"), F.col("o_text_id").alias("b"))


def _linking(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (a, b) of gap links that connect the same boxes as all of them, in number near that of the cells covered.

    ``boxes`` hold ``gap_x`` and ``gap_y``, the sides of a grid cell. Boxes that share a cell are linked, so a star about
    the cell's smallest id says it all. Links between cells side by side follow from the cells' outermost edges. Across a
    corner only boxes that end there matter, and of those the furthest at each place.
    """
    def at(column: str, gap: str) -> Column:
        return F.floor(F.col(column) / F.col(gap))

    spread = boxes.withColumn("_cx", F.explode(F.sequence(at("x1", "gap_x"), at("x2", "gap_x"))))
    spread = spread.withColumn("_cy", F.explode(F.sequence(at("y1", "gap_y"), at("y2", "gap_y"))))
    cells = spread.groupBy(*keys, "_cx", "_cy").agg(
        F.min("text_id").alias("a"), F.max("text_id").alias("_last"), *(F.max(c).alias(c) for c in ("x2", "y2", "gap_x", "gap_y")), *(F.min(c).alias(c) for c in ("x1", "y1"))
    )
    cells = cut_lineage(cells)
    shared = cells.where("a <> _last").select(*keys, "_cx", "_cy", "a")
    links = spread.join(shared, [*keys, "_cx", "_cy"]).select(*keys, "a", F.col("text_id").alias("b"))
    for cell, edge, low, gap in (("_cx", "x2", "x1", "gap_x"), ("_cy", "y2", "y1", "gap_y")):
        # A box that goes on into the next cell links both already.
        ahead = cells.where(at(low, gap) == F.col(cell)).select(*keys, *((F.col(c) - int(c == cell)).alias(c) for c in ("_cx", "_cy")), F.col("a").alias("b"), F.col(low).alias("_low"))
        beside = cells.where(at(edge, gap) == F.col(cell)).join(ahead, [*keys, "_cx", "_cy"]).where(F.col(edge) + F.col(gap) >= F.col("_low"))
        links = links.unionByName(beside.select(*keys, "a", "b"))
    for end, start, down in (("y2", "y1", 1), ("y1", "y2", -1)):
        place = [*keys, "_cx", "_cy"]
        here = boxes.withColumns({"_cx": at("x2", "gap_x"), "_cy": at(end, "gap_y")}).groupBy(*place, "x2", "gap_x", "gap_y")
        here = here.agg(F.max(F.struct((F.col(end) * down).alias("y"), "text_id")).alias("_here"))
        there = boxes.withColumns({"_cx": at("x1", "gap_x") - 1, "_cy": at(start, "gap_y") - down}).groupBy(*place, "x1")
        there = there.agg(F.min(F.struct((F.col(start) * down).alias("y"), "text_id")).alias("_there"))
        near = (F.col("x2") + F.col("gap_x") >= F.col("x1")) & (F.col("_here.y") + F.col("gap_y") >= F.col("_there.y"))
        across = here.join(there, place).where(near).groupBy(*place).agg(F.min(F.struct("_here.text_id", F.col("_there.text_id").alias("b"))).alias("_pair"))
        links = links.unionByName(across.select(*keys, F.col("_pair.text_id").alias("a"), F.col("_pair.b").alias("b")))
    return links.where("a <> b").distinct()


def box_groups(boxes: DataFrame, keys: Sequence[str], crowd: int = 128, cell: int = 256) -> DataFrame:
    """Component of each box over the gap links; equal boxes are linked once. A box whose edges are reversed is alone.

    Pages with more than ``crowd`` boxes to a cell are linked by ``_linking``, whose cost follows the boxes, others by
    their pairs, which are then few; both give the same components.
    """
    places = cut_lineage(boxes.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("text_id").alias("text_id")))
    # Gaps come from all boxes, copies included.
    gaps = gap_params(boxes.select(*keys, "x1", "y1", "x2", "y2"), keys)
    corner = [F.floor(F.col(c) / F.lit(cell)) for c in ("x1", "y1")]
    crowds = places.groupBy(*keys, *corner).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg((F.max("_n") > crowd).alias("_crowded"))
    grown = cut_lineage(places.where("x2 >= x1 AND y2 >= y1").join(gaps.join(crowds, [*keys]), [*keys]))
    box = Box.named()
    wide = Box(box.x1 - F.col("gap_x"), box.y1 - F.col("gap_y"), box.x2 + F.col("gap_x"), box.y2 + F.col("gap_y"))
    loose = grown.where(~F.col("_crowded")).drop("_crowded")
    pairs = touching_pairs(loose, _renamed(loose.drop("gap_x", "gap_y"), keys, "o_"), keys, wide, Box.named("o_"), cell, also=F.col("text_id") < F.col("o_text_id"))
    links = pairs.select(*keys, F.col("text_id").alias("a"), F.col("o_text_id").alias("b"))
    dense = grown.where("_crowded")
    if not dense.isEmpty():
        links = links.unionByName(_linking(dense, keys))
    ends = [F.struct(*keys, F.col(c).alias("text_id")).alias(c) for c in ("a", "b")]
    named = components(links.select(*ends)).withColumnRenamed("id", "_id")
    placed = places.withColumn("_id", F.struct(*keys, "text_id")).join(named, "_id", "left")
    placed = placed.select(*keys, "x1", "y1", "x2", "y2", F.coalesce("component.text_id", "text_id").alias("component"))
    return boxes.join(placed, [*keys, "x1", "y1", "x2", "y2"])


def union_boxes(groups: DataFrame, keys: Sequence[str], width: int, height: int, scale: float = 1.5) -> DataFrame:
    """Bounds of each group of boxes, scaled about their centre and clipped to the canvas."""
    bounds = groups.groupBy(*keys, "component").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("members")
    )
    grown = G.expand(Box.named(), scale, F.lit(width), F.lit(height))
    return bounds.select(*keys, "component", "members", *grown.aliased()).where("x2 > x1 AND y2 > y1")
