"""Scalar geometry and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import geometry as G
from panelweave.functions import vectors as V
from panelweave.functions.geometry import Box
from panelweave.plans.registry import query



def A():
    return Box.named("a")


def B():
    return Box.named("b")


AW, AH = "greatest(ax2-ax1,0)", "greatest(ay2-ay1,0)"
AREA_A = f"CAST({AW} AS DOUBLE)*{AH}"
AREA_B = "CAST(greatest(bx2-bx1,0) AS DOUBLE)*greatest(by2-by1,0)"
INTER = "CAST(greatest(least(ax2,bx2)-greatest(ax1,bx1),0) AS DOUBLE)*greatest(least(ay2,by2)-greatest(ay1,by1),0)"
DIST = (
    "sqrt(power((ax1+ax2)*0.5e0-(bx1+bx2)*0.5e0,2)+power((ay1+ay2)*0.5e0-(by1+by2)*0.5e0,2))"
    "/greatest(1e0,least(sqrt(power(ax2-ax1,2)+power(ay2-ay1,2)),sqrt(power(bx2-bx1,2)+power(by2-by1,2))))"
)
QLOW = "least(q0x,q1x,q2x,q3x) AS lx, least(q0y,q1y,q2y,q3y) AS ly, greatest(q0x,q1x,q2x,q3x) AS hx, greatest(q0y,q1y,q2y,q3y) AS hy"


def _points():
    return F.array(*(F.array(F.col(f"q{i}x"), F.col(f"q{i}y")) for i in range(4)))


def _quad():
    return F.when(F.col("has_quad"), _points())


def _canvas():
    return F.col("canvas_w"), F.col("canvas_h")


def r6(column):
    return F.round(column, 6)


def _pairs(t, *columns):
    return t("box_pairs").select("pair_id", *columns)


def _scalar(key, name, build, sql):
    query(key, f"SELECT pair_id, {sql} AS {name} FROM box_pairs")(lambda t: _pairs(t, build(A(), B()).alias(name)))


def _clamped(col, top):
    return f"least(greatest({col},0),{top})"


@query(
    "bbox_clamp",
    f"""SELECT pair_id, CASE WHEN bad THEN 0 ELSE cx1 END AS x1, CASE WHEN bad THEN 0 ELSE cy1 END AS y1,
        CASE WHEN bad THEN 0 ELSE cx2 END AS x2, CASE WHEN bad THEN 0 ELSE cy2 END AS y2
        FROM (SELECT *, cx2<=cx1 OR cy2<=cy1 AS bad FROM (SELECT pair_id, {_clamped('ax1','canvas_w')} AS cx1, {_clamped('ay1','canvas_h')} AS cy1,
        {_clamped('ax2','canvas_w')} AS cx2, {_clamped('ay2','canvas_h')} AS cy2 FROM box_pairs) c) d""",
)
def _(t):
    return _pairs(t, *G.clamp(A(), *_canvas()).aliased())


_scalar("bbox_area", "area", lambda a, b: G.area(a), AREA_A)
_scalar("bbox_intersects", "hit", lambda a, b: G.intersects(a, b), "greatest(ax1,bx1)<least(ax2,bx2) AND greatest(ay1,by1)<least(ay2,by2)")
_scalar("bbox_intersection", "overlap", lambda a, b: G.intersection(a, b), INTER)


@query(
    "bbox_iou",
    f"""SELECT pair_id, round(CASE WHEN i>0 THEN i/greatest(u,1e0) ELSE 0e0 END,6) AS iou_floored,
        round(CASE WHEN i>0 AND u>0 THEN i/u ELSE 0e0 END,6) AS iou_exact
        FROM (SELECT pair_id, {INTER} AS i, {AREA_A}+{AREA_B}-{INTER} AS u FROM box_pairs) s""",
)
def _(t):
    return _pairs(t, r6(G.iou(A(), B())).alias("iou_floored"), r6(G.iou(A(), B(), floor_union=False)).alias("iou_exact"))


_scalar("bbox_containment", "share", lambda a, b: r6(G.containment(a, b)), f"round(({INTER})/greatest({AREA_A},1e0),6)")
query(
    "bbox_union",
    "SELECT pair_id, least(ax1,bx1) AS x1, least(ay1,by1) AS y1, greatest(ax2,bx2) AS x2, greatest(ay2,by2) AS y2 FROM box_pairs",
)(lambda t: _pairs(t, *G.union(A(), B()).aliased()))
_scalar(
    "x_overlap_ratio", "ratio", lambda a, b: r6(G.x_overlap_ratio(a, b)),
    "round(CAST(greatest(least(ax2,bx2)-greatest(ax1,bx1),0) AS DOUBLE)/greatest(1,least(ax2-ax1,bx2-bx1)),6)",
)
_scalar("y_gap", "gap", lambda a, b: G.y_gap(a, b), "CASE WHEN ay2<by1 THEN by1-ay2 WHEN by2<ay1 THEN ay1-by2 ELSE 0 END")
_scalar("center_distance_norm", "distance", lambda a, b: r6(G.center_distance(a, b)), f"round({DIST},6)")


def _share(col, size):
    return f"round(CASE WHEN canvas_w<=0 OR canvas_h<=0 THEN 0e0 ELSE least(greatest({col}*1e0/nullif({size},0),0e0),1e0) END,6)"


@query(
    "bbox_normalize",
    f"SELECT pair_id, {_share('ax1','canvas_w')} AS x1, {_share('ay1','canvas_h')} AS y1, {_share('ax2','canvas_w')} AS x2, {_share('ay2','canvas_h')} AS y2 FROM box_pairs",
)
def _(t):
    return _pairs(t, *Box(*map(r6, G.normalize(A(), *_canvas()))).aliased())


@query(
    "bbox_from_quad",
    f"""SELECT pair_id, CASE WHEN has_quad THEN CAST(floor(lx) AS INT) ELSE ax1 END AS x1, CASE WHEN has_quad THEN CAST(floor(ly) AS INT) ELSE ay1 END AS y1,
        CASE WHEN has_quad THEN CAST(ceil(hx) AS INT) ELSE ax2 END AS x2, CASE WHEN has_quad THEN CAST(ceil(hy) AS INT) ELSE ay2 END AS y2,
        CASE WHEN has_quad THEN CAST(trunc(lx) AS INT) ELSE ax1 END AS x1_cut, CASE WHEN has_quad THEN CAST(trunc(ly) AS INT) ELSE ay1 END AS y1_cut,
        CASE WHEN has_quad THEN CAST(trunc(hx) AS INT) ELSE ax2 END AS x2_cut, CASE WHEN has_quad THEN CAST(trunc(hy) AS INT) ELSE ay2 END AS y2_cut
        FROM (SELECT *, {QLOW} FROM box_pairs) s""",
)
def _(t):
    return _pairs(t, *G.from_quad(_quad(), A()).aliased(), *G.from_quad(_quad(), A(), mode="truncate").aliased(suffix="_cut"))


@query(
    "quad_from_bbox",
    """SELECT pair_id, CAST(ax1 AS DOUBLE) AS p0x, CAST(ay1 AS DOUBLE) AS p0y, CAST(ax2 AS DOUBLE) AS p1x, CAST(ay1 AS DOUBLE) AS p1y,
       CAST(ax2 AS DOUBLE) AS p2x, CAST(ay2 AS DOUBLE) AS p2y, CAST(ax1 AS DOUBLE) AS p3x, CAST(ay2 AS DOUBLE) AS p3y FROM box_pairs""",
)
def _(t):
    quad = t("box_pairs").select("pair_id", G.to_quad(A()).alias("q"))
    return quad.select("pair_id", *(F.col("q")[i][j].alias(f"p{i}{'xy'[j]}") for i in range(4) for j in range(2)))


@query(
    "resolve_geometry",
    f"""SELECT pair_id, x1, y1, x2, y2, CASE WHEN has_quad THEN 'quad' ELSE 'bbox' END AS geom_source,
        {_share('x1','canvas_w')} AS nx1, {_share('y1','canvas_h')} AS ny1, {_share('x2','canvas_w')} AS nx2, {_share('y2','canvas_h')} AS ny2
        FROM (SELECT pair_id, has_quad, canvas_w, canvas_h,
          CASE WHEN has_quad THEN CAST(floor(lx) AS INT) WHEN {AREA_A}<=0 THEN 0 ELSE ax1 END AS x1, CASE WHEN has_quad THEN CAST(floor(ly) AS INT) WHEN {AREA_A}<=0 THEN 0 ELSE ay1 END AS y1,
          CASE WHEN has_quad THEN CAST(ceil(hx) AS INT) WHEN {AREA_A}<=0 THEN 0 ELSE ax2 END AS x2, CASE WHEN has_quad THEN CAST(ceil(hy) AS INT) WHEN {AREA_A}<=0 THEN 0 ELSE ay2 END AS y2
          FROM (SELECT *, {QLOW} FROM box_pairs) s) r""",
)
def _(t):
    box, share, source = G.resolve(_quad(), A(), F.lit(""), *_canvas())
    return _pairs(t, *box.aliased(), source.alias("geom_source"), *Box(*map(r6, share)).aliased("n"))


@query(
    "panel_rel_bbox",
    """SELECT pair_id, CASE WHEN bad THEN 0 ELSE rx1 END AS x1, CASE WHEN bad THEN 0 ELSE ry1 END AS y1,
       CASE WHEN bad THEN 0 ELSE rx2 END AS x2, CASE WHEN bad THEN 0 ELSE ry2 END AS y2
       FROM (SELECT *, rx2<=rx1 OR ry2<=ry1 AS bad FROM (SELECT pair_id,
         greatest(0,least(greatest(bx2-bx1,0),ax1-bx1)) AS rx1, greatest(0,least(greatest(by2-by1,0),ay1-by1)) AS ry1,
         greatest(0,least(greatest(bx2-bx1,0),ax2-bx1)) AS rx2, greatest(0,least(greatest(by2-by1,0),ay2-by1)) AS ry2 FROM box_pairs) s) q""",
)
def _(t):
    return _pairs(t, *G.relative_to_panel(A(), B()).aliased())


@query(
    "bbox_expand",
    """SELECT pair_id, least(greatest(CAST(floor(cx-0.75e0*w) AS INT),0),canvas_w) AS x1, least(greatest(CAST(floor(cy-0.75e0*h) AS INT),0),canvas_h) AS y1,
       least(greatest(CAST(ceil(cx+0.75e0*w) AS INT),0),canvas_w) AS x2, least(greatest(CAST(ceil(cy+0.75e0*h) AS INT),0),canvas_h) AS y2
       FROM (SELECT *, 0.5e0*(ax1+ax2) AS cx, 0.5e0*(ay1+ay2) AS cy, greatest(1,ax2-ax1) AS w, greatest(1,ay2-ay1) AS h FROM box_pairs) s""",
)
def _(t):
    return _pairs(t, *G.expand(A(), 1.5, *_canvas()).aliased())


_scalar(
    "gap_connected", "linked", lambda a, b: G.gap_connected(a, b, F.lit(6), F.lit(9)),
    "NOT (ax2+6<bx1 OR bx2+6<ax1 OR ay2+9<by1 OR by2+9<ay1)",
)


@query(
    "text_panel_score",
    f"""SELECT pair_id, round(least(greatest(0.7e0*o+0.3e0*least(greatest(1e0-d,0e0),1e0),0e0),1e0),6) AS score, round(o,6) AS overlap_ratio, round(d,6) AS center_distance_norm
        FROM (SELECT pair_id, ({INTER})/greatest({AREA_A},1e0) AS o, {DIST} AS d FROM box_pairs) s""",
)
def _(t):
    names = ("score", "overlap_ratio", "center_distance_norm")
    return _pairs(t, *(r6(c).alias(n) for c, n in zip(G.text_panel_score(A(), B()), names)))


@query(
    "color_similarity",
    """SELECT e.band_index, e.a, e.b, round(least(greatest(1e0-sqrt(power(p.mean_b-q.mean_b,2)+power(p.mean_g-q.mean_g,2)+power(p.mean_r-q.mean_r,2))/(255e0*sqrt(3e0)),0e0),1e0),6) AS similarity
       FROM patch_edges e JOIN patch_nodes p ON p.node_id=e.a JOIN patch_nodes q ON q.node_id=e.b""",
)
def _(t):
    return _edge_ends(t).select(
        "band_index", "a", "b",
        r6(V.color_similarity(tuple(F.col(f"p.mean_{c}") for c in "bgr"), tuple(F.col(f"q.mean_{c}") for c in "bgr"))).alias("similarity"),
    )


def _edge_ends(t):
    edges, nodes = t("patch_edges"), t("patch_nodes").drop("band_index")
    return edges.join(nodes.alias("p"), F.col("a") == F.col("p.node_id")).join(nodes.alias("q"), F.col("b") == F.col("q.node_id"))


@query(
    "cosine_similarity",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN na<1e-8 OR nb<1e-8 THEN 0e0 ELSE d/(na*nb) END,5) AS cosine FROM (
       SELECT a.vec_id, b.vec_id AS bid, sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)*x))) AS na, sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)*x))) AS nb,
       list_sum(list_transform(range(1,65), lambda i: CAST(a.embedding[i] AS DOUBLE)*b.embedding[i])) AS d
       FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1) a JOIN embeddings b ON b.vec_id=a.bid""",
)
def _(t):
    left = t("embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("u"))
    right = t("embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    joined = left.join(right, F.col("b") == F.col("a") + 1)
    return joined.select("a", "b", F.round(V.cosine(F.col("u"), F.col("v")), 5).alias("cosine"))


@query(
    "l2_normalize",
    """SELECT vec_id, CAST(i AS INT) AS pos, round(CASE WHEN n<1e-8 THEN e ELSE e/n END,6) AS value FROM (
       SELECT vec_id, unnest(range(0,len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*x))) AS n FROM embeddings) s""",
)
def _(t):
    unit = t("embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "resize_plan",
    """SELECT pair_id, round(s,6) AS scale, CASE WHEN s>=0.9999e0 THEN w ELSE greatest(1,CAST(round_even(w*s,0) AS INT)) END AS width,
       CASE WHEN s>=0.9999e0 THEN h ELSE greatest(1,CAST(round_even(h*s,0) AS INT)) END AS height
       FROM (SELECT *, least(1e0, 1600e0/greatest(w,h), 1024e0/least(w,h)) AS s FROM (SELECT pair_id, (bx2-bx1)*17+40 AS w, (by2-by1)*41+30 AS h FROM box_pairs) q) r""",
)
def _(t):
    w, h = F.col("w"), F.col("h")
    sized = _pairs(t, (B().width * 17 + 40).alias("w"), (B().height * 41 + 30).alias("h"))
    scale, width, height = G.fit_within(w, h, 1600, 1024)
    return sized.select("pair_id", r6(scale).alias("scale"), width.alias("width"), height.alias("height"))


@query(
    "quad_rescale",
    "SELECT pair_id, " + ", ".join(f"round(q{i}x*(800e0/640e0),6) AS p{i}x, round(q{i}y*(1900e0/1280e0),6) AS p{i}y" for i in range(4)) + " FROM box_pairs",
)
def _(t):
    quad = _points()
    scaled = t("box_pairs").select("pair_id", G.rescale_quad(quad, F.lit(800.0 / 640.0), F.lit(1900.0 / 1280.0)).alias("q"))
    return scaled.select("pair_id", *(r6(F.col("q")[i][j]).alias(f"p{i}{'xy'[j]}") for i in range(4) for j in range(2)))


@query(
    "region_score",
    "SELECT page_id, region_id, round(least(greatest(0.65e0*area_ratio+0.35e0*least((1+region_id%11)/8e0,1e0),0e0),1e0),6) AS region_score FROM regions",
)
def _(t):
    nodes = F.lit(1) + F.col("region_id") % 11
    return t("regions").select("page_id", "region_id", r6(G.region_score(F.col("area_ratio"), nodes)).alias("region_score"))


@query(
    "panel_pad",
    """SELECT page_id, region_id, greatest(0,x1-6) AS x1, greatest(0,y1-6) AS y1, least(600,x2+6) AS x2, least(9000,y2+6) AS y2, 0 AS band_x1, 600 AS band_x2
       FROM regions WHERE least(600,x2+6)>greatest(0,x1-6) AND least(9000,y2+6)>greatest(0,y1-6)""",
)
def _(t):
    width, height = F.lit(600), F.lit(9000)
    padded = G.pad_to_page(Box.named(), 6, width, height)
    wide = G.pad_to_page(Box.named(), 6, width, height, full_width=True)
    kept = t("regions").where(~padded.empty)
    return kept.select("page_id", "region_id", *padded.aliased(), wide.x1.alias("band_x1"), wide.x2.alias("band_x2"))
