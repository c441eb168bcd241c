"""Text matching, grouping and panel assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.text import block_similarity, edit_similarity, normalize_text
from panelweave.operators import texts as X
from panelweave.plans.registry import query
from panelweave.session import dealt

KEYS = ["page_id"]


def r6(name):
    return F.round(name, 6).alias(name)


def _dist(a, b):
    return (
        f"sqrt(power(({a}x1+{a}x2)*0.5e0-({b}x1+{b}x2)*0.5e0,2)+power(({a}y1+{a}y2)*0.5e0-({b}y1+{b}y2)*0.5e0,2))"
        f"/greatest(1e0,least(sqrt(power({a}x2-{a}x1,2)+power({a}y2-{a}y1,2)),sqrt(power({b}x2-{b}x1,2)+power({b}y2-{b}y1,2))))"
    )


def _inter(a, b):
    return f"CAST(greatest(least({a}x2,{b}x2)-greatest({a}x1,{b}x1),0) AS DOUBLE)*greatest(least({a}y2,{b}y2)-greatest({a}y1,{b}y1),0)"


def _area(a):
    return f"CAST(greatest({a}x2-{a}x1,0) AS DOUBLE)*greatest({a}y2-{a}y1,0)"


CAND = f"""cand AS (SELECT page_id, text_id, panel_id, least(greatest(0.7e0*o+0.3e0*least(greatest(1e0-d,0e0),1e0),0e0),1e0) AS score, o AS overlap_ratio, d AS center_distance_norm
 FROM (SELECT t.page_id, t.text_id, p.panel_id, ({_inter('t.', 'p.')})/greatest({_area('t.')},1e0) AS o, {_dist('t.', 'p.')} AS d FROM texts t JOIN panels p ON p.page_id=t.page_id) s
 WHERE least(greatest(0.7e0*o+0.3e0*least(greatest(1e0-d,0e0),1e0),0e0),1e0) >= 0.15e0)"""
TOP3 = "top3 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, text_id ORDER BY score DESC, overlap_ratio DESC, panel_id) AS INT) AS rank FROM cand) r WHERE rank<=3)"
CAND_OUT = "page_id, text_id, panel_id, round(score,6) AS score, round(overlap_ratio,6) AS overlap_ratio, round(center_distance_norm,6) AS center_distance_norm"


def candidates(t):
    return X.panel_candidates(t("texts"), t("panels"), KEYS)


def _cand_out(df, *more):
    return df.select("page_id", "text_id", "panel_id", r6("score"), r6("overlap_ratio"), r6("center_distance_norm"), *more)


@query("text_panel_candidates", f"WITH {CAND} SELECT {CAND_OUT} FROM cand")
def _(t):
    return _cand_out(candidates(t))


@query("text_panel_top3", f"WITH {CAND}, {TOP3} SELECT {CAND_OUT}, rank FROM top3")
def _(t):
    return _cand_out(X.best_candidates(candidates(t), KEYS), "rank")


@query(
    "text_panel_map",
    f"""WITH {CAND}, {TOP3} SELECT t.page_id, t.text_id, m.panel_id AS primary_panel_id, round(coalesce(m.score,0e0),6) AS assignment_score, CAST(coalesce(n.n,0) AS INT) AS candidate_count, 'overlap+center' AS method
        FROM texts t LEFT JOIN (SELECT * FROM top3 WHERE rank=1) m ON m.text_id=t.text_id LEFT JOIN (SELECT text_id, count(*) AS n FROM top3 GROUP BY 1) n ON n.text_id=t.text_id""",
)
def _(t):
    mapped = X.assign_panels(t("texts"), t("panels"), KEYS)
    size = F.when(F.col("candidate_panels").isNull(), 0).otherwise(F.size("candidate_panels"))
    return mapped.select("page_id", "text_id", "primary_panel_id", r6("assignment_score"), size.alias("candidate_count"), "method")


@query(
    "text_panel_nearest",
    f"""SELECT t.page_id, t.text_id, b.panel_id, 'nearest_center' AS method FROM texts t LEFT JOIN (SELECT page_id, text_id, panel_id FROM (SELECT t.page_id, t.text_id, p.panel_id, row_number() OVER (PARTITION BY t.page_id, t.text_id
        ORDER BY power((t.x1+t.x2)*0.5e0-(p.x1+p.x2)*0.5e0,2)+power((t.y1+t.y2)*0.5e0-(p.y1+p.y2)*0.5e0,2), -({_inter('t.', 'p.')})/greatest({_area('t.')},1e0), p.panel_id) AS r
        FROM texts t JOIN panels p ON p.page_id=t.page_id) s WHERE r=1) b ON b.page_id=t.page_id AND b.text_id=t.text_id""",
)
def _(t):
    return X.nearest_panels(t("texts"), t("panels"), KEYS)


# Mapping rows of the fixture: some texts map to a panel that does not exist, some are mapped twice.
MAPPING = """mapping AS (SELECT page_id, text_id, CASE WHEN text_id%17=0 THEN panel_id+90000000 ELSE panel_id END AS primary_panel_id, score AS assignment_score, 0 AS ord FROM top3 WHERE rank=1
 UNION ALL SELECT page_id, text_id, panel_id, score, 1 FROM top3 WHERE rank=2)"""
UNIFIED = f"""unified AS (SELECT t.page_id, t.text_id, t.text, t.x1, t.y1, t.x2, t.y2, p.panel_id AS primary_panel_id, p.x1 AS panel_x1, p.y1 AS panel_y1, p.x2 AS panel_x2, p.y2 AS panel_y2,
 least(greatest(t.x1-p.x1,0),p.x2-p.x1) AS cx1, least(greatest(t.y1-p.y1,0),p.y2-p.y1) AS cy1, least(greatest(t.x2-p.x1,0),p.x2-p.x1) AS cx2, least(greatest(t.y2-p.y1,0),p.y2-p.y1) AS cy2,
 coalesce(m.assignment_score,0e0) AS assignment_score, CASE WHEN p.panel_id IS NULL THEN 'unassigned' ELSE 'assigned' END AS status
 FROM texts t LEFT JOIN (SELECT page_id, text_id, arg_max(primary_panel_id, ord) AS primary_panel_id, arg_max(assignment_score, ord) AS assignment_score FROM mapping GROUP BY 1,2) m ON m.page_id=t.page_id AND m.text_id=t.text_id
 LEFT JOIN panels p ON p.page_id=m.page_id AND p.panel_id=m.primary_panel_id),
 items AS (SELECT *, CASE WHEN status='unassigned' THEN NULL WHEN cx2<=cx1 OR cy2<=cy1 THEN 0 ELSE cx1 END AS rel_x1, CASE WHEN status='unassigned' THEN NULL WHEN cx2<=cx1 OR cy2<=cy1 THEN 0 ELSE cy1 END AS rel_y1,
  CASE WHEN status='unassigned' THEN NULL WHEN cx2<=cx1 OR cy2<=cy1 THEN 0 ELSE cx2 END AS rel_x2, CASE WHEN status='unassigned' THEN NULL WHEN cx2<=cx1 OR cy2<=cy1 THEN 0 ELSE cy2 END AS rel_y2 FROM unified)"""
ITEMS = f"{CAND}, {TOP3}, {MAPPING}, {UNIFIED}"


def items(t):
    best = X.best_candidates(candidates(t), KEYS)
    lists = best.groupBy(*KEYS, "text_id").agg(F.array_sort(F.collect_list(F.struct("rank", "panel_id", "score"))).alias("candidate_panels"))
    best = best.where("rank <= 2").join(lists, [*KEYS, "text_id"])
    unknown = F.when((F.col("rank") == 1) & (F.col("text_id") % 17 == 0), F.col("panel_id") + 90000000).otherwise(F.col("panel_id"))
    mapping = best.select("page_id", "text_id", unknown.alias("primary_panel_id"), F.col("score").alias("assignment_score"), (F.col("rank") - 1).alias("ord"), "candidate_panels")
    return X.unify(t("texts"), mapping, t("panels").withColumn("ord", F.lit(0)), KEYS)


@query(
    "unified_text_map",
    f"WITH {ITEMS} SELECT page_id, text_id, text, x1, y1, x2, y2, primary_panel_id, panel_x1, panel_y1, panel_x2, panel_y2, rel_x1, rel_y1, rel_x2, rel_y2, round(assignment_score,6) AS assignment_score, status, coalesce(c.candidate_panels,'') AS candidate_panels FROM items"
    " LEFT JOIN (SELECT page_id, text_id, string_agg(concat(CAST(rank AS VARCHAR),':',CAST(panel_id AS VARCHAR)), ',' ORDER BY rank) AS candidate_panels FROM top3 GROUP BY 1,2) c USING (page_id, text_id)",
)
def _(t):
    told = F.array_join(F.transform("candidate_panels", lambda c: F.concat_ws(":", c.rank, c.panel_id)), ",")
    return items(t).withColumns({"assignment_score": r6("assignment_score"), "candidate_panels": told})


@query(
    "reading_order",
    f"WITH {ITEMS} SELECT page_id, primary_panel_id, text_id, CAST(row_number() OVER (PARTITION BY page_id, primary_panel_id ORDER BY rel_y1, rel_x1, text_id) AS INT) AS reading_no FROM items WHERE status='assigned'",
)
def _(t):
    return X.reading_order(items(t), KEYS).select("page_id", "primary_panel_id", "text_id", "reading_no")


@query(
    "panel_text_manifest",
    f"""WITH {ITEMS} SELECT p.page_id, p.panel_id, concat('panels/', CAST(p.page_id AS VARCHAR), '/', CAST(p.panel_id AS VARCHAR), '.png') AS image_path, CAST(coalesce(n.n,0) AS BIGINT) AS text_count, p.x1, p.y1, p.x2, p.y2
        FROM panels p LEFT JOIN (SELECT page_id, primary_panel_id, count(*) AS n FROM items WHERE status='assigned' GROUP BY 1,2) n ON n.page_id=p.page_id AND n.primary_panel_id=p.panel_id""",
)
def _(t):
    from panelweave.operators.packaging import panel_text_manifest

    panels = t("panels").withColumn("image_path", F.concat(F.lit("panels/"), F.col("page_id"), F.lit("/"), F.col("panel_id"), F.lit(".png")))
    return panel_text_manifest(panels, items(t), KEYS).select("page_id", "panel_id", "image_path", "text_count", "x1", "y1", "x2", "y2")


@query(
    "texts_by_panel",
    f"""WITH {ITEMS} SELECT page_id, panel, text_id, CAST(row_number() OVER (PARTITION BY page_id, panel ORDER BY text_id) AS INT) AS place FROM (SELECT page_id, coalesce(CAST(primary_panel_id AS VARCHAR),'unassigned') AS panel, text_id FROM items) s""",
)
def _(t):
    from panelweave.operators.packaging import texts_by_panel

    return texts_by_panel(items(t), KEYS)


@query("texts_order", "SELECT page_id, text_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, text_id) AS INT) AS place FROM texts")
def _(t):
    return X.row_numbers(t("texts"), KEYS, [F.col("y1"), F.col("x1"), F.col("text_id")], name="place").select("page_id", "text_id", "place")


@query("renumber_texts", "SELECT page_id, text_id AS old_id, printf('text_%03d', row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, text_id)) AS text_id FROM texts")
def _(t):
    old = t("texts").withColumnRenamed("text_id", "old_id")
    return X.renumber(old, KEYS, [F.col("old_id")]).select("page_id", "old_id", "text_id")


@query("normalize_text", r"SELECT page_id, text_id, lower(regexp_replace(text, '\s', '', 'g')) AS normalized FROM texts")
def _(t):
    return t("texts").select("page_id", "text_id", normalize_text(F.col("text")).alias("normalized"))


# DuckDB measures edits in bytes, so that the check maps each accented letter to one unused byte.
ACCENTS = "translate({}, 'èéêçößäüóíñ', concat(" + ",".join(f"chr({i})" for i in range(1, 9)) + ",chr(14),chr(15),chr(16)))"
NEAR = f"""near AS (SELECT *, greatest(iou, greatest(0e0, 1e0-d)) AS geom FROM (SELECT page_id, l, o, lt, ot, CASE WHEN i>0 THEN i/u ELSE 0e0 END AS iou, d FROM (
  SELECT t.page_id, t.text_id AS l, c.text_id AS o, t.text AS lt, c.text AS ot, {_inter('t.', 'c.')} AS i, {_area('t.')}+{_area('c.')}-{_inter('t.', 'c.')} AS u, {_dist('t.', 'c.')} AS d
  FROM texts t JOIN ocr_texts c ON c.page_id=t.page_id) s) q WHERE iou>=0.35e0 OR d<=0.25e0),
 normed AS (SELECT *, lower(regexp_replace(lt, '\\s', '', 'g')) AS na, lower(regexp_replace(ot, '\\s', '', 'g')) AS nb FROM near),
 alike AS (SELECT *, CASE WHEN na='' AND nb='' THEN 1e0 WHEN na='' OR nb='' THEN 0e0 WHEN na=nb THEN 1e0 WHEN abs(length(na)-length(nb))>0.35e0*greatest(length(na),length(nb)) THEN 0e0
   ELSE 1e0-levenshtein({ACCENTS.format('na')}, {ACCENTS.format('nb')})/CAST(greatest(length(na),length(nb)) AS DOUBLE) END AS sim FROM normed),
 edges AS (SELECT page_id, l, o, geom, sim, 0.7e0*geom+0.3e0*sim AS w FROM alike WHERE sim>=0.999e0 OR (sim>=0.65e0 AND geom>=0.7e0))"""


@query("text_match_edges", f"WITH {NEAR} SELECT page_id, l AS layer_text_id, o AS ocr_text_id, round(geom,6) AS geom_score, round(sim,6) AS text_score, round(w,6) AS weight FROM edges")
def _(t):
    edges = X.match_edges(t("texts"), t("ocr_texts"), KEYS, similarity="edit")
    return edges.select("page_id", "layer_text_id", "ocr_text_id", r6("geom_score"), r6("text_score"), r6("weight"))


@query("text_similarity")
def _(t):
    edges = X.match_edges(t("texts"), t("ocr_texts"), KEYS, similarity="blocks")
    return edges.select("page_id", "layer_text_id", "ocr_text_id", r6("geom_score"), r6("text_score"), r6("weight"))


@query(
    "text_similarity_lev",
    rf"""SELECT page_id, text_id, round(CASE WHEN na='' AND nb='' THEN 1e0 WHEN na='' OR nb='' THEN 0e0 WHEN na=nb THEN 1e0 ELSE 1e0-levenshtein({ACCENTS.format('na')}, {ACCENTS.format('nb')})/CAST(greatest(length(na),length(nb)) AS DOUBLE) END,6) AS similarity
        FROM (SELECT page_id, text_id, lower(regexp_replace(text, '\s', '', 'g')) AS na, lower(regexp_replace(other, '\s', '', 'g')) AS nb FROM (SELECT a.doc_id AS page_id, a.doc_id*10000000+a.line_no AS text_id, a.line AS text, b.line AS other FROM lines a JOIN lines b ON b.doc_id=a.doc_id AND b.line_no=a.line_no+1) s) n""",
)
def _(t):
    # Normalised before they are paired, once each, and dealt out, since comparing is the costly part.
    texts = t("texts").select("page_id", "line_no", "text_id", normalize_text(F.col("text")).alias("text"))
    following = texts.select("page_id", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("other"))
    pairs = dealt(texts.join(following, ["page_id", "line_no"]), "page_id", "text_id")
    return pairs.select("page_id", "text_id", F.round(edit_similarity(F.col("text"), F.col("other"), normalized=True), 6).alias("similarity"))


MATCHED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, l, o) AS i, count(*) OVER (PARTITION BY page_id) AS n FROM edges),
 taken AS (SELECT page_id, i, n, [l] AS ls, [o] AS os, [i] AS picks FROM ranked WHERE i=1 UNION ALL
  SELECT e.page_id, e.i, e.n, CASE WHEN free THEN list_append(ls, l) ELSE ls END, CASE WHEN free THEN list_append(os, o) ELSE os END, CASE WHEN free THEN list_append(picks, e.i) ELSE picks END
  FROM (SELECT r.page_id, r.i, r.n, r.l, r.o, t.ls, t.os, t.picks, NOT list_contains(t.ls, r.l) AND NOT list_contains(t.os, r.o) AS free FROM taken t JOIN ranked r ON r.page_id=t.page_id AND r.i=t.i+1) e),
 pairs AS (SELECT r.* FROM (SELECT page_id, unnest(picks) AS i FROM taken WHERE i=n) p JOIN ranked r ON r.page_id=p.page_id AND r.i=p.i)"""
MERGED = """merged AS (SELECT page_id, text, x1, y1, x2, y2, conf, merge_status, text_source, printf('text_%03d', row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, rk, pl, id)) AS text_id FROM (
  SELECT t.page_id, t.text, o.x1, o.y1, o.x2, o.y2, greatest(1e0,o.conf) AS conf, 'matched' AS merge_status, 'psd' AS text_source, 0 AS rk, -p.w AS pl, t.text_id AS id FROM pairs p JOIN texts t ON t.text_id=p.l JOIN ocr_texts o ON o.text_id=p.o
  UNION ALL SELECT page_id, text, x1, y1, x2, y2, conf, 'unmatched_ocr', 'ocr', 1, 0e0, text_id FROM ocr_texts WHERE text_id NOT IN (SELECT o FROM pairs)
  UNION ALL SELECT page_id, text, x1, y1, x2, y2, 1e0, 'unmatched_psd', 'psd', 2, 0e0, text_id FROM texts WHERE text_id NOT IN (SELECT l FROM pairs)) u)"""


def merged(t):
    return X.merge_sources(t("texts"), t("ocr_texts"), KEYS, similarity="edit")


@query("text_match_greedy", f"WITH RECURSIVE {NEAR}, {MATCHED}, {MERGED} SELECT page_id, text_id, text, x1, y1, x2, y2, round(conf,6) AS conf, merge_status, text_source FROM merged")
def _(t):
    return merged(t).select("page_id", "text_id", "text", "x1", "y1", "x2", "y2", r6("conf"), "merge_status", "text_source")


@query(
    "merge_stats",
    f"""WITH RECURSIVE {NEAR}, {MATCHED}, {MERGED} SELECT page_id, CAST(count(*) FILTER (WHERE merge_status='unmatched_psd') AS BIGINT) AS merge_unmatched_psd_count,
        CAST(count(*) FILTER (WHERE merge_status='unmatched_ocr') AS BIGINT) AS merge_unmatched_ocr_count FROM merged GROUP BY 1""",
)
def _(t):
    from panelweave.operators.packaging import merge_stats

    return merge_stats(merged(t), KEYS)


def _sql_quad(a: str) -> str:
    x1, y1, x2, y2 = (f"CAST({a}{c} AS DOUBLE)" for c in ("x1", "y1", "x2", "y2"))
    points = [f"CAST({x}+{dx} AS VARCHAR), ' ', CAST({y}+{dy} AS VARCHAR)" for x, dx, y, dy in ((x1, "0.25e0", y1, "0e0"), (x2, "0e0", y1, "0.5e0"), (x2, "0.75e0", y2, "0e0"), (x1, "0e0", y2, "0e0"))]
    return "concat(" + ", ',', ".join(points) + ")"


# Every second OCR text and every third layer text has a quad a little wider than its box.
PLACED = f"""placed AS (
 SELECT t.page_id, t.text, CASE WHEN o.text_id%2=0 THEN o.x1 ELSE t.x1 END AS x1, CASE WHEN o.text_id%2=0 THEN o.y1 ELSE t.y1 END AS y1, CASE WHEN o.text_id%2=0 THEN o.x2+1 WHEN t.text_id%3=0 THEN t.x2+1 ELSE t.x2 END AS x2,
  CASE WHEN o.text_id%2=0 THEN o.y2 ELSE t.y2 END AS y2, greatest(1e0,o.conf) AS conf, 'matched' AS merge_status, 'psd' AS text_source, CASE WHEN o.text_id%2=0 THEN {_sql_quad('o.')} WHEN t.text_id%3=0 THEN {_sql_quad('t.')} END AS quad,
  t.text_id%50 AS layer_id, concat('root#1/t#', CAST(t.text_id%50 AS VARCHAR)) AS layer_path, printf('m_%03d', row_number() OVER (PARTITION BY p.page_id ORDER BY p.w DESC, p.l, p.o)) AS merge_group_id,
  CASE WHEN o.text_id%2=0 THEN 'ocr_quad' ELSE 'psd_bbox' END AS geom_source, 0 AS rk, -p.w AS pl, t.text_id AS id FROM pairs p JOIN texts t ON t.text_id=p.l JOIN ocr_texts o ON o.text_id=p.o
 UNION ALL SELECT page_id, text, x1, y1, CASE WHEN text_id%2=0 THEN x2+1 ELSE x2 END, y2, conf, 'unmatched_ocr', 'ocr', CASE WHEN text_id%2=0 THEN {_sql_quad('')} END, NULL, NULL, NULL, 'ocr_quad', 1, 0e0, text_id FROM ocr_texts WHERE text_id NOT IN (SELECT o FROM pairs)
 UNION ALL SELECT page_id, text, x1, y1, CASE WHEN text_id%3=0 THEN x2+1 ELSE x2 END, y2, 1e0, 'unmatched_psd', 'psd', CASE WHEN text_id%3=0 THEN {_sql_quad('')} END, text_id%50, concat('root#1/t#', CAST(text_id%50 AS VARCHAR)), NULL, 'psd_bbox', 2, 0e0, text_id FROM texts WHERE text_id NOT IN (SELECT l FROM pairs))"""


def _with_quads(df, every: int):
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    wide = F.array(F.array(x1 + 0.25, y1), F.array(x2, y1 + 0.5), F.array(x2 + 0.75, y2), F.array(x1, y2))
    return df.withColumn("quad", F.when(F.col("text_id") % every == 0, wide))


@query(
    "text_canvas_map",
    f"""WITH RECURSIVE {NEAR}, {MATCHED}, {PLACED} SELECT page_id, printf('text_%03d', row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, rk, pl, id)) AS text_id, text, quad, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2,
        round(least(greatest(x1/780e0,0e0),1e0),9) AS norm_x1, round(least(greatest(y1/1850e0,0e0),1e0),9) AS norm_y1, round(least(greatest(x2/780e0,0e0),1e0),9) AS norm_x2, round(least(greatest(y2/1850e0,0e0),1e0),9) AS norm_y2,
        layer_id, layer_path, text_source, geom_source, merge_group_id, merge_status, round(conf,6) AS confidence FROM placed""",
)
def _(t):
    from panelweave.functions.ocr_json import quad_text
    from panelweave.operators.packaging import text_canvas_map

    layer = F.col("text_id") % 50
    layers = _with_quads(t("texts"), 3).withColumns({"layer_id": layer, "layer_path": F.concat(F.lit("root#1/t#"), layer)})
    told = text_canvas_map(X.merge_sources(layers, _with_quads(t("ocr_texts"), 2), KEYS), KEYS, 780, 1850)
    return told.withColumns({"quad": quad_text(F.col("quad")), "confidence": r6("confidence"), **{c: F.round(c, 9) for c in ("norm_x1", "norm_y1", "norm_x2", "norm_y2")}})


BOXES = "boxes AS (SELECT page_id, text_id, least(greatest(x1,0),780) AS x1, least(greatest(y1,0),1850) AS y1, least(greatest(x2,0),780) AS x2, least(greatest(y2,0),1850) AS y2 FROM texts WHERE least(greatest(x2,0),780)>least(greatest(x1,0),780) AND least(greatest(y2,0),1850)>least(greatest(y1,0),1850))"
GAPS = "gaps AS (SELECT page_id, m AS median_h, least(greatest(CAST(round_even(m*0.4e0,0) AS INT),2),72) AS gap_x, least(greatest(CAST(round_even(m*0.6e0,0) AS INT),2),96) AS gap_y FROM (SELECT page_id, quantile_cont(greatest(y2-y1,1),0.5) AS m FROM boxes GROUP BY 1) q)"
LINKS = "links AS (SELECT a.page_id, a.text_id AS a, b.text_id AS b FROM boxes a JOIN boxes b ON a.page_id=b.page_id AND a.text_id<b.text_id JOIN gaps g ON g.page_id=a.page_id WHERE NOT (a.x2+gap_x<b.x1 OR b.x2+gap_x<a.x1 OR a.y2+gap_y<b.y1 OR b.y2+gap_y<a.y1))"
GROUPS = """ends AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
 reach(u, v) AS (SELECT text_id, text_id FROM boxes UNION SELECT r.u, e.v FROM reach r JOIN ends e ON e.u=r.v),
 groups AS (SELECT b.page_id, b.text_id, b.x1, b.y1, b.x2, b.y2, r.c AS component FROM boxes b JOIN (SELECT u, min(v) AS c FROM reach GROUP BY 1) r ON r.u=b.text_id)"""


def boxes(t):
    return X.clipped_boxes(t("texts"), KEYS, 780, 1850)


@query("text_gap_params", f"WITH {BOXES}, {GAPS} SELECT page_id, median_h, gap_x, gap_y FROM gaps")
def _(t):
    return X.gap_params(boxes(t), KEYS)


@query("box_gap_selfjoin", f"WITH {BOXES}, {GAPS}, {LINKS} SELECT page_id, a, b FROM links")
def _(t):
    return X.gap_links(boxes(t), KEYS)


@query("connected_boxes", f"WITH RECURSIVE {BOXES}, {GAPS}, {LINKS}, {GROUPS} SELECT page_id, text_id, component FROM groups")
def _(t):
    return X.box_groups(boxes(t), KEYS).select("page_id", "text_id", "component")


@query(
    "text_union_boxes",
    f"""WITH RECURSIVE {BOXES}, {GAPS}, {LINKS}, {GROUPS} SELECT * FROM (SELECT page_id, component, members,
        least(greatest(CAST(floor((x1+x2)*0.5e0-greatest(x2-x1,1)*0.75e0) AS INT),0),780) AS x1, least(greatest(CAST(floor((y1+y2)*0.5e0-greatest(y2-y1,1)*0.75e0) AS INT),0),1850) AS y1,
        least(greatest(CAST(ceil((x1+x2)*0.5e0+greatest(x2-x1,1)*0.75e0) AS INT),0),780) AS x2, least(greatest(CAST(ceil((y1+y2)*0.5e0+greatest(y2-y1,1)*0.75e0) AS INT),0),1850) AS y2
        FROM (SELECT page_id, component, CAST(count(*) AS BIGINT) AS members, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM groups GROUP BY 1,2) g) e WHERE x2>x1 AND y2>y1""",
)
def _(t):
    return X.union_boxes(X.box_groups(boxes(t), KEYS), KEYS, 780, 1850)
