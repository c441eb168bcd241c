"""Layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import layers as L
from panelweave.plans.registry import query

PAGE = ["page_id"]
W, H = 800, 1900


def r6(name):
    return F.round(name, 6).alias(name)


def _c(col, top):
    return f"least(greatest({col},0),{top})"


CLAMPED = f"clamped AS (SELECT *, CASE WHEN bad THEN 0 ELSE a END AS cx1, CASE WHEN bad THEN 0 ELSE b END AS cy1, CASE WHEN bad THEN 0 ELSE c END AS cx2, CASE WHEN bad THEN 0 ELSE d END AS cy2 FROM (SELECT *, c<=a OR d<=b AS bad FROM (SELECT *, {_c('x1', W)} AS a, {_c('y1', H)} AS b, {_c('x2', W)} AS c, {_c('y2', H)} AS d FROM layers) q) r)"
TEXTS = rf"""ltexts AS (SELECT page_id, layer_id, text, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM (SELECT *, regexp_replace(replace(coalesce(layer_text,''), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM clamped) s WHERE kind IN ('type','text') AND cx2>cx1 AND cy2>cy1 AND text<>'')"""


@query("layer_text_extract", f"WITH {CLAMPED}, {TEXTS} SELECT page_id, layer_id, text, x1, y1, x2, y2, printf('psd_%03d', row_number() OVER (PARTITION BY page_id ORDER BY layer_id)) AS text_id, 1e0 AS conf FROM ltexts")
def _(t):
    return L.layer_texts(t("layers"), PAGE, W, H)


@query(
    "layer_paths",
    """WITH RECURSIVE up AS (SELECT page_id, layer_id, above, concat(name,'#',CAST(layer_id AS VARCHAR)) AS path FROM layer_tree WHERE above IS NULL
       UNION ALL SELECT c.page_id, c.layer_id, c.above, concat(u.path,'/',c.name,'#',CAST(c.layer_id AS VARCHAR)) FROM up u JOIN layer_tree c ON c.page_id=u.page_id AND c.above=u.layer_id)
       SELECT u.page_id, u.layer_id, CAST(t.pos AS INT) AS number, u.path FROM up u JOIN layer_tree t ON t.page_id=u.page_id AND t.layer_id=u.layer_id""",
)
def _(t):
    return L.layer_paths(t("layer_tree"), PAGE)


UNIONS = "unions AS (SELECT page_id, min(x1) AS u_x1, min(y1) AS u_y1, max(x2) AS u_x2, max(y2) AS u_y2 FROM texts GROUP BY 1)"
RATIO = "least(greatest(overlap_pixels/CAST(greatest(layer_pixels,1) AS DOUBLE),0e0),1e0)"
RASTER = f"""raster AS (SELECT page_id, layer_id, rgba_elapsed_ms, o AS overlap_ratio, CASE WHEN is_excluded THEN 'excluded' WHEN NOT visible THEN 'not_visible' WHEN kind='group' THEN 'group_skip' WHEN cx2<=cx1 OR cy2<=cy1 THEN 'empty_bbox'
 WHEN NOT (greatest(cx1,u_x1)<least(cx2,u_x2) AND greatest(cy1,u_y1)<least(cy2,u_y2)) THEN 'bbox_no_intersect' WHEN layer_pixels<20 THEN 'min_pixels' WHEN o>=0.85e0 THEN 'ratio_pass' ELSE 'ratio_below_thr' END AS reason
 FROM (SELECT c.*, u.u_x1, u.u_y1, u.u_x2, u.u_y2, {RATIO} AS o FROM clamped c JOIN unions u ON u.page_id=c.page_id) s)"""
BUBBLE = f"""bubble AS (SELECT page_id, layer_id, kind, rgba_elapsed_ms, o AS overlap_ratio, layer_pixels/1520000e0 AS bubble_area_ratio, CASE WHEN is_excluded THEN 'excluded' WHEN NOT visible THEN 'not_visible' WHEN layer_pixels<20 THEN 'min_pixels' WHEN o<0.35e0 THEN 'rejected_below_thr' ELSE 'ratio_pass' END AS reason
 FROM (SELECT *, {RATIO} AS o FROM layers) s)"""


def raster(t):
    boxes = t("texts").groupBy("page_id").agg(F.min("x1").alias("u_x1"), F.min("y1").alias("u_y1"), F.max("x2").alias("u_x2"), F.max("y2").alias("u_y2"))
    return L.raster_text_layers(t("layers"), boxes, PAGE, W, H)


def bubble(t):
    return L.bubble_layers(t("layers"), float(W * H))


@query("layer_eligibility", f"WITH {CLAMPED}, {UNIONS}, {RASTER} SELECT page_id, layer_id, round(overlap_ratio,6) AS overlap_ratio, reason FROM raster")
def _(t):
    return raster(t).select("page_id", "layer_id", r6("overlap_ratio"), "reason")


@query("bubble_eligibility", f"WITH {BUBBLE} SELECT page_id, layer_id, round(overlap_ratio,6) AS overlap_ratio, round(bubble_area_ratio,9) AS bubble_area_ratio, reason FROM bubble")
def _(t):
    return bubble(t).select("page_id", "layer_id", r6("overlap_ratio"), F.round("bubble_area_ratio", 9).alias("bubble_area_ratio"), "reason")


@query("raster_order", f"WITH {CLAMPED}, {UNIONS}, {RASTER} SELECT page_id, layer_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY overlap_ratio DESC, layer_id) AS INT) AS place FROM raster WHERE reason='ratio_pass'")
def _(t):
    return L.accepted_in_order(raster(t), PAGE).select("page_id", "layer_id", "place")


@query("bubble_order", f"WITH {BUBBLE} SELECT page_id, layer_id, kind, CAST(row_number() OVER (PARTITION BY page_id ORDER BY overlap_ratio DESC, bubble_area_ratio, layer_id) AS INT) AS place FROM bubble WHERE reason='ratio_pass'")
def _(t):
    return L.accepted_in_order(bubble(t), PAGE).select("page_id", "layer_id", "kind", "place")


@query("slowest_layers", f"WITH {BUBBLE} SELECT * FROM (SELECT page_id, layer_id, rgba_elapsed_ms, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rgba_elapsed_ms DESC, layer_id) AS INT) AS place FROM bubble WHERE reason NOT IN ('excluded','not_visible')) s WHERE place<=10")
def _(t):
    return L.slowest(bubble(t), PAGE).select("page_id", "layer_id", "rgba_elapsed_ms", "place")


@query(
    "layer_timing",
    f"""WITH {BUBBLE} SELECT page_id, CAST(count(*) AS BIGINT) AS layers_total, CAST(count(*) FILTER (WHERE seen) AS BIGINT) AS layers_evaluated, CAST(count(*) FILTER (WHERE reason='ratio_pass') AS BIGINT) AS layers_accepted,
        CAST(coalesce(sum(rgba_elapsed_ms) FILTER (WHERE seen),0) AS BIGINT) AS sum_ms, round(coalesce(sum(rgba_elapsed_ms) FILTER (WHERE seen),0)/CAST(greatest(count(*) FILTER (WHERE seen),1) AS DOUBLE),6) AS avg_ms, CAST(coalesce(max(rgba_elapsed_ms) FILTER (WHERE seen),0) AS INT) AS max_ms
        FROM (SELECT *, reason NOT IN ('excluded','not_visible') AS seen FROM bubble) s GROUP BY 1""",
)
def _(t):
    return L.decode_stats(bubble(t), PAGE).withColumn("avg_ms", r6("avg_ms"))


@query(
    "removed_layers",
    f"""WITH {CLAMPED}, {UNIONS}, {RASTER}, {BUBBLE}, {TEXTS} SELECT page_id, layer_id FROM ltexts UNION SELECT page_id, layer_id FROM raster WHERE reason='ratio_pass' UNION
        SELECT page_id, layer_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overlap_ratio DESC, bubble_area_ratio, layer_id) AS p FROM bubble WHERE reason='ratio_pass') b WHERE p=1""",
)
def _(t):
    chosen = L.accepted_in_order(bubble(t), PAGE).where("place = 1")
    return L.removed_layers(PAGE, L.layer_texts(t("layers"), PAGE, W, H), raster(t).where("reason = 'ratio_pass'"), chosen)


@query(
    "exclusion_split",
    f"""WITH {CLAMPED}, {UNIONS}, {RASTER}, {TEXTS} SELECT page_id, layer_id, CASE min(k) WHEN 0 THEN 'text' WHEN 1 THEN 'raster' ELSE 'generic' END AS cause FROM (SELECT page_id, layer_id, 0 AS k FROM ltexts
        UNION ALL SELECT page_id, layer_id, 1 FROM raster WHERE reason='ratio_pass' UNION ALL SELECT page_id, layer_id, 2 FROM layers WHERE is_excluded) s GROUP BY 1,2""",
)
def _(t):
    return L.exclusion_split(t("layers").where("is_excluded"), L.layer_texts(t("layers"), PAGE, W, H), raster(t).where("reason = 'ratio_pass'"), PAGE)


RECTS = "rects AS (SELECT image_id, CAST(min(x)+label%3 AS INT) AS x1, CAST(min(y)+1 AS INT) AS y1, CAST(max(x)-label%2+label%5 AS INT) AS x2, CAST(max(y) AS INT) AS y2 FROM pixels GROUP BY image_id, label)"


@query(
    "layer_text_overlap",
    f"""WITH {RECTS}, opaque AS (SELECT image_id, r%4 AS layer_id, y, x FROM pixels WHERE b>10) SELECT image_id, layer_id, n AS layer_pixels, k AS overlap_pixels, round(k/CAST(n AS DOUBLE),6) AS overlap_ratio FROM (SELECT image_id, layer_id, CAST(count(*) AS BIGINT) AS n,
        CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM rects q WHERE q.image_id=o.image_id AND o.x>=q.x1 AND o.x<q.x2 AND o.y>=q.y1 AND o.y<q.y2)) AS BIGINT) AS k FROM opaque o GROUP BY 1,2) s""",
)
def _(t):
    label = F.col("label")
    rects = t("pixels").groupBy("image_id", "label").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    rects = rects.select("image_id", (F.col("a") + label % 3).alias("x1"), (F.col("b") + 1).alias("y1"), (F.col("c") - label % 2 + label % 5).alias("x2"), F.col("d").alias("y2"))
    layered = t("pixels").select("image_id", (F.col("r") % 4).alias("layer_id"), "y", "x", F.col("b").alias("alpha"))
    return L.pixel_overlap(layered, rects, ["image_id"]).withColumn("overlap_ratio", r6("overlap_ratio"))
