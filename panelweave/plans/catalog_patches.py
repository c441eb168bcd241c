"""Pixel, patch graph and region growth queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import patches as P
from panelweave.plans.registry import query

IMAGE, BAND = ["image_id"], ["band_index"]
GRAY = "grays AS (SELECT *, CAST((b*114+g*587+r*299+500)//1000 AS INT) AS gray FROM pixels)"


def _sobel(source, keys, name):
    """CTEs of the 3 x 3 stencil by self joins on mirrored coordinates."""
    k = " AND ".join(f"n.{c}=p.{c}" for c in keys.split(", "))
    return f"""{name}_e AS (SELECT {keys}, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM {source} GROUP BY {keys}),
 {name}_n AS (SELECT p.{', p.'.join(keys.split(', '))}, p.y, p.x, d.dx, d.dy, n.gray FROM {source} p CROSS JOIN (SELECT a.v AS dx, b.v AS dy FROM (SELECT unnest([-1,0,1]) AS v) a CROSS JOIN (SELECT unnest([-1,0,1]) AS v) b) d
   JOIN {source} n ON {k} AND n.x=CASE WHEN EXISTS (SELECT 1 FROM {source} q WHERE {k.replace('n.', 'q.')} AND q.y=p.y AND q.x=p.x+d.dx) THEN p.x+d.dx ELSE p.x-d.dx END AND n.y=CASE WHEN EXISTS (SELECT 1 FROM {source} q WHERE {k.replace('n.', 'q.')} AND q.x=p.x AND q.y=p.y+d.dy) THEN p.y+d.dy ELSE p.y-d.dy END),
 {name} AS (SELECT {keys}, y, x, CAST(sum(gray*dx*(2-abs(dy))) AS INT) AS gx, CAST(sum(gray*dy*(2-abs(dx))) AS INT) AS gy FROM {name}_n GROUP BY {keys}, y, x)"""


SOBEL = f"{GRAY}, {_sobel('grays', 'image_id', 'sob')}"
MAGS = "mags AS (SELECT s.image_id, s.y, s.x, s.gx, s.gy, sqrt(CAST(s.gx*s.gx+s.gy*s.gy AS DOUBLE)) AS mag FROM sob s)"
GRAD = f"{SOBEL}, {MAGS}, graded AS (SELECT m.*, p.gray, p.label, p.b, p.g, p.r, least(m.mag/CASE WHEN q.p<1e-6 THEN 1e0 ELSE q.p END,1e0) AS grad FROM mags m JOIN grays p ON p.image_id=m.image_id AND p.y=m.y AND p.x=m.x JOIN (SELECT image_id, quantile_cont(mag,0.99) AS p FROM mags GROUP BY 1) q ON q.image_id=m.image_id)"


def r6(name, out=None):
    return F.round(name, 6).alias(out or name)


def graded(t):
    return P.gradient_map(t("pixels"), IMAGE)


@query("sobel_stencil", f"WITH {SOBEL} SELECT image_id, y, x, gx, gy FROM sob")
def _(t):
    return P.sobel(t("pixels"), IMAGE).select("image_id", "y", "x", "gx", "gy")


@query("gradient_map", f"WITH {GRAD} SELECT image_id, y, x, round(grad,6) AS grad FROM graded")
def _(t):
    return graded(t).select("image_id", "y", "x", r6("grad"))


@query(
    "row_stats",
    f"""WITH {SOBEL} SELECT s.image_id, s.y, round(avg(p.gray),6) AS gray_mean, round(avg(CASE WHEN p.gray>245 THEN 1e0 ELSE 0e0 END),6) AS white_raw, round(avg(CASE WHEN p.gray<40 THEN 1e0 ELSE 0e0 END),6) AS dark_raw,
        round(avg(CASE WHEN abs(gx)+abs(gy)>=120 THEN 1e0 ELSE 0e0 END),6) AS edge_raw FROM sob s JOIN grays p ON p.image_id=s.image_id AND p.y=s.y AND p.x=s.x GROUP BY 1,2""",
)
def _(t):
    return P.row_stats(t("pixels"), IMAGE).select("image_id", "y", r6("gray_mean"), r6("white_raw"), r6("dark_raw"), r6("edge_raw"))


STATS_OUT = "round(cx,6) AS cx, round(cy,6) AS cy, round(mean_b,6) AS mean_b, round(mean_g,6) AS mean_g, round(mean_r,6) AS mean_r, round(edge_mean,6) AS edge_mean, round(non_white_ratio,6) AS non_white_ratio"


@query(
    "patch_stats",
    f"""WITH {GRAD} SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label)-1 AS INT) AS node_id, x1, y1, x2, y2, area, {STATS_OUT} FROM (SELECT image_id, label, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2, CAST(count(*) AS BIGINT) AS area,
        avg(x) AS cx, avg(y) AS cy, avg(b) AS mean_b, avg(g) AS mean_g, avg(r) AS mean_r, avg(grad) AS edge_mean, avg(CASE WHEN gray<245 THEN 1e0 ELSE 0e0 END) AS non_white_ratio FROM graded GROUP BY 1,2) s""",
)
def _(t):
    stats = P.patch_stats(graded(t), IMAGE)
    return stats.select("image_id", "label", "node_id", "x1", "y1", "x2", "y2", "area", *(r6(c) for c in ("cx", "cy", "mean_b", "mean_g", "mean_r", "edge_mean", "non_white_ratio")))


BORDERS = """borders AS (SELECT p.image_id, least(p.label,n.label) AS a, greatest(p.label,n.label) AS b, p.grad+n.grad AS both_ FROM graded p JOIN graded n ON n.image_id=p.image_id AND n.label<>p.label AND ((n.y=p.y AND n.x=p.x+1) OR (n.x=p.x AND n.y=p.y+1)))"""


@query("patch_adjacency", f"WITH {GRAD}, {BORDERS} SELECT DISTINCT image_id, a, b FROM borders")
def _(t):
    return P.label_borders(graded(t), IMAGE).select("image_id", "a", "b").distinct()


@query("boundary_costs", f"WITH {GRAD}, {BORDERS} SELECT image_id, a, b, round(sum(both_)/(2*count(*)),6) AS boundary_cost, CAST(count(*) AS BIGINT) AS border FROM borders GROUP BY 1,2,3")
def _(t):
    return P.boundary_costs(P.label_borders(graded(t), IMAGE), IMAGE).select("image_id", "a", "b", r6("boundary_cost"), "border")


@query("neighbor_sets", "SELECT band_index, node_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS neighbors FROM (SELECT band_index, a AS node_id, b AS n FROM patch_edges UNION SELECT band_index, b, a FROM patch_edges) s GROUP BY 1,2")
def _(t):
    return P.neighbor_sets(t("patch_edges"), BAND).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


def _boxes(t):
    return t("pixels").groupBy("image_id", F.col("label").alias("node_id")).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2")
    )


def crops(t):
    return P.patch_crops(t("pixels"), _boxes(t), IMAGE)


CROPS = "node_boxes AS (SELECT image_id, label AS node_id, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2 FROM pixels GROUP BY 1,2), crops AS (SELECT n.image_id, n.node_id, p.y, p.x, p.b, p.g, p.r, p.gray FROM node_boxes n JOIN grays p ON p.image_id=n.image_id AND p.x>=n.x1-2 AND p.x<n.x2+2 AND p.y>=n.y1-2 AND p.y<n.y2+2)"


@query(
    "patch_embedding",
    f"""WITH {GRAY}, {CROPS}, {_sobel('crops', 'image_id, node_id', 'sob')}, vals AS (SELECT c.image_id, c.node_id, c.b, c.g, c.r, CAST(floor(least(sqrt(CAST(gx*gx+gy*gy AS DOUBLE)),255e0)) AS INT) AS m FROM crops c JOIN sob s ON s.image_id=c.image_id AND s.node_id=c.node_id AND s.y=c.y AND s.x=c.x),
    hist AS (SELECT image_id, node_id, [{', '.join(f"count(*) FILTER (WHERE {c}//32={i})/CAST(count(*) AS DOUBLE)" for c in 'bgrm' for i in range(8))}] AS v FROM vals GROUP BY 1,2)
    SELECT image_id, node_id, CAST(pos AS INT) AS pos, round(v/sqrt(s),6) AS value FROM (SELECT image_id, node_id, unnest(range(0,32)) AS pos, unnest(v) AS v, list_sum(list_transform(v, lambda x: x*x)) AS s FROM hist) q""",
)
def _(t):
    vectors = P.histogram_embedding(crops(t), ["image_id", "node_id"])
    return vectors.select("image_id", "node_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "content_key",
    f"""WITH {GRAY}, {CROPS} SELECT image_id, node_id, sha1(unhex(concat(hex(concat('local:', printf('(%d, %d, 3)', max(y)-min(y)+1, max(x)-min(x)+1))), string_agg(concat(lpad(printf('%X', b),2,'0'), lpad(printf('%X', g),2,'0'), lpad(printf('%X', r),2,'0')), '' ORDER BY y, x)))) AS content_key FROM crops GROUP BY 1,2""",
)
def _(t):
    return P.content_keys(crops(t), ["image_id", "node_id"], "local:")


SEEDS = """seeds AS (SELECT * FROM (SELECT band_index, node_id, salience, row_number() OVER (PARTITION BY band_index ORDER BY salience DESC, node_id) AS seed_no FROM (SELECT band_index, node_id, 0.45e0*edge_mean+0.45e0*non_white_ratio+0.1e0*least(area/CAST(greatest(sum(area) OVER (PARTITION BY band_index),1) AS DOUBLE)*10e0,1e0) AS salience FROM patch_nodes) s) q WHERE seed_no<=8)"""


@query("seed_rank", f"WITH {SEEDS} SELECT band_index, node_id, round(salience,6) AS salience, CAST(seed_no AS INT) AS seed_no FROM seeds")
def _(t):
    return P.seed_rank(t("patch_nodes"), BAND).select("band_index", "node_id", r6("salience"), "seed_no")


def nodes(t):
    return t("patch_nodes").withColumn("embedding", F.array("e0", "e1", "e2"))


@query(
    "region_embedding",
    """SELECT band_index, region_id, round(m0/n,6) AS e0, round(m1/n,6) AS e1, round(m2/n,6) AS e2 FROM (SELECT *, sqrt(m0*m0+m1*m1+m2*m2) AS n FROM (SELECT band_index, node_id%6 AS region_id, avg(e0) AS m0, avg(e1) AS m1, avg(e2) AS m2 FROM patch_nodes GROUP BY 1,2) s) q""",
)
def _(t):
    members = nodes(t).withColumn("region_id", F.col("node_id") % 6)
    vectors = P.mean_embedding(members, ["band_index", "region_id"])
    return vectors.select("band_index", "region_id", *(F.round(F.col("embedding")[i], 6).alias(f"e{i}") for i in range(3)))


@query(
    "region_summary",
    """SELECT band_index, region_id, x1, CAST(y1+band_index*500 AS INT) AS y1, x2, CAST(y2+band_index*500 AS INT) AS y2, n AS node_count, round(area/360000e0,6) AS area_ratio, round(least(greatest(0.65e0*(area/360000e0)+0.35e0*least(n/8e0,1e0),0e0),1e0),6) AS score
       FROM (SELECT band_index, node_id%6 AS region_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS BIGINT) AS n, sum(area) AS area FROM patch_nodes GROUP BY 1,2) s""",
)
def _(t):
    members = t("patch_nodes").select("band_index", (F.col("node_id") % 6).alias("region_id"), "node_id")
    bands = t("patch_nodes").select("band_index").distinct().withColumns({"band_y1": F.col("band_index") * 500, "band_area": F.lit(360000)})
    summary = P.region_summary(members, t("patch_nodes"), bands, BAND)
    return summary.withColumns({"area_ratio": r6("area_ratio"), "score": r6("score")})


def _stage(key, stage):
    query(key)(lambda t: P.grow_regions(nodes(t), t("patch_edges"), BAND, stage=stage))


_stage("grow_regions", "grow")
_stage("attach_orphans", "orphans")
_stage("merge_regions", "merge")
_stage("absorb_tiny", "absorb")


@query("seed_regions")
def _(t):
    """Box, area share and score of what grew from each seed."""
    members = P.grow_regions(nodes(t), t("patch_edges"), BAND, stage="grow")
    bands = t("patch_nodes").select("band_index").distinct().withColumns({"band_y1": F.col("band_index") * 500, "band_area": F.lit(360000)})
    summary = P.region_summary(members, t("patch_nodes"), bands, BAND)
    return summary.withColumns({"area_ratio": r6("area_ratio"), "score": r6("score")})
