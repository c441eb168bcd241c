"""Row profile, cut and band queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import bands as D
from panelweave.operators import rows as R
from panelweave.plans.registry import query
from panelweave.session import cut_lineage

KEYS = ["image_id"]
FEATS = """feats AS (SELECT image_id, y, gray_mean, sum(white_raw) OVER w / 21e0 AS white_ratio, sum(dark_raw) OVER w / 21e0 AS dark_ratio,
 sum(edge_raw) OVER w / 21e0 AS edge_density FROM row_profile WINDOW w AS (PARTITION BY image_id ORDER BY y ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))"""


def _runs(flag, least):
    return f"""SELECT image_id, min(y) AS y1, max(y)+1 AS y2 FROM (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g
      FROM feats WHERE {flag}) s GROUP BY image_id, g HAVING max(y)+1-min(y) >= {least}"""


GUTTERS = f"""gutters AS (SELECT f.image_id, f.y, 0.5e0*least(f.white_ratio,1e0) + 0.3e0*least(greatest(1e0-f.edge_density/0.006e0,0e0),1e0) + 0.2e0*least((u.y2-u.y1)/36e0,1e0) AS strength,
 'gutter' AS kind, u.y1 AS span_y1, u.y2 AS span_y2, least(greatest(1e0-f.edge_density/0.006e0,0e0),1e0) AS meta_e
 FROM ({_runs('white_ratio >= 0.985e0 AND edge_density <= 0.006e0', 18)}) u JOIN feats f ON f.image_id=u.image_id AND f.y=CAST(floor((u.y1+u.y2)/2) AS INT))"""
BARS = f"""bars AS (SELECT f.image_id, f.y, 0.7e0*least(f.dark_ratio,1e0) + 0.3e0*least((u.y2-u.y1)/48e0,1e0) AS strength,
 'black_bar' AS kind, u.y1 AS span_y1, u.y2 AS span_y2, least(f.edge_density,1e0) AS meta_e
 FROM ({_runs('dark_ratio >= 0.9e0 AND edge_density <= 0.03e0', 24)}) u JOIN feats f ON f.image_id=u.image_id AND f.y=CAST(floor((u.y1+u.y2)/2) AS INT))"""
RANK = "CASE {} WHEN 'black_bar' THEN 3 WHEN 'gutter' THEN 2 WHEN 'hard_line' THEN 1 ELSE 0 END"


def _merged(source, name="merged"):
    """CTEs folding ``source`` cuts into groups."""
    return f"""{name}_seq AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, ord) AS i FROM {source}),
 {name}_fold AS (SELECT image_id, i, y, strength, kind, span_y1, span_y2, meta_e, 1 AS n FROM {name}_seq WHERE i = 1 UNION ALL
   SELECT s.image_id, s.i, CASE WHEN s.y-r.y<=25 THEN r.y ELSE s.y END, CASE WHEN s.y-r.y<=25 THEN greatest(r.strength,s.strength) ELSE s.strength END,
     CASE WHEN s.y-r.y<=25 AND {RANK.format('s.kind')} <= {RANK.format('r.kind')} THEN r.kind ELSE s.kind END,
     CASE WHEN s.y-r.y<=25 THEN least(r.span_y1,s.span_y1) ELSE s.span_y1 END, CASE WHEN s.y-r.y<=25 THEN greatest(r.span_y2,s.span_y2) ELSE s.span_y2 END,
     CASE WHEN s.y-r.y<=25 THEN r.meta_e ELSE s.meta_e END, CASE WHEN s.y-r.y<=25 THEN r.n+1 ELSE 1 END
   FROM {name}_fold r JOIN {name}_seq s ON s.image_id=r.image_id AND s.i=r.i+1),
 {name} AS (SELECT image_id, y, strength, kind, span_y1, span_y2, meta_e, CAST(n AS INT) AS merged, CAST(y AS BIGINT) AS ord FROM (SELECT *, max(n) OVER (PARTITION BY image_id, y) AS top FROM {name}_fold) t WHERE n = top)"""


LISTED = "listed AS (SELECT image_id, ord, y, kind, strength, span_y1, span_y2, (ord%5)/100e0 AS meta_e FROM cut_list)"


def listed(t):
    return t("cut_list").withColumn("meta_e", F.col("ord") % 5 / 100.0)


def feats(t):
    raw = t("row_profile")
    return R.moving_average(raw, KEYS, {"white_raw": "white_ratio", "dark_raw": "dark_ratio", "edge_raw": "edge_density"})


def r6(name):
    return F.round(name, 6).alias(name)


@query("moving_average", f"WITH {FEATS} SELECT image_id, y, round(white_ratio,6) AS white_ratio, round(dark_ratio,6) AS dark_ratio, round(edge_density,6) AS edge_density FROM feats")
def _(t):
    return feats(t).select("image_id", "y", r6("white_ratio"), r6("dark_ratio"), r6("edge_density"))


CUT_OUT = "image_id, CAST(y AS INT) AS y, round(strength,6) AS strength, kind, CAST(span_y1 AS INT) AS span_y1, CAST(span_y2 AS INT) AS span_y2"


def _cut_out(df):
    return df.select("image_id", "y", r6("strength"), "kind", "span_y1", "span_y2")


@query("detect_gutters", f"WITH {FEATS}, {GUTTERS} SELECT {CUT_OUT} FROM gutters")
def _(t):
    return _cut_out(R.detect_gutters(feats(t), KEYS))


@query("detect_black_bars", f"WITH {FEATS}, {BARS} SELECT {CUT_OUT} FROM bars")
def _(t):
    return _cut_out(R.detect_black_bars(feats(t), KEYS))


@query("merge_candidates", f"WITH RECURSIVE {LISTED}, {_merged('listed')} SELECT {CUT_OUT}, merged, round(meta_e,6) AS meta_e FROM merged")
def _(t):
    return D.merge_cuts(listed(t), KEYS).select("image_id", "y", r6("strength"), "kind", "span_y1", "span_y2", "merged", r6("meta_e"))


def _rescaled(cuts, name):
    return f"""{name}_diff AS (SELECT c.image_id, c.y, abs(coalesce(avg(CASE WHEN f.y<c.y THEN f.gray_mean END),0e0)-coalesce(avg(CASE WHEN f.y>=c.y THEN f.gray_mean END),0e0))/255e0 AS gd,
  abs(coalesce(avg(CASE WHEN f.y<c.y THEN f.edge_density END),0e0)-coalesce(avg(CASE WHEN f.y>=c.y THEN f.edge_density END),0e0)) AS ed
  FROM (SELECT DISTINCT image_id, y FROM {cuts}) c JOIN feats f ON f.image_id=c.image_id AND f.y BETWEEN c.y-64 AND c.y+63 GROUP BY c.image_id, c.y),
 {name} AS (SELECT c.image_id, c.ord, c.y, c.kind, c.span_y1, c.span_y2, c.meta_e, coalesce(d.gd,0e0) AS gray_diff, coalesce(d.ed,0e0) AS edge_diff,
  CASE WHEN coalesce(d.gd,0e0)<0.02e0 AND coalesce(d.ed,0e0)<0.002e0 THEN least(greatest(c.strength*least(greatest(0.4e0+coalesce(d.gd,0e0)/0.02e0*0.6e0,0.4e0),1e0),0e0),1e0) ELSE c.strength END AS strength
  FROM {cuts} c LEFT JOIN {name}_diff d ON d.image_id=c.image_id AND d.y=c.y)"""


# Cuts every 23 rows, so that alike and different surroundings both occur.
STEPPED = "stepped AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y) AS BIGINT) AS ord, y, 'gutter' AS kind, 0.5e0 + (y%50)/100e0 AS strength, y-2 AS span_y1, y+2 AS span_y2, 0e0 AS meta_e FROM (SELECT image_id, y FROM row_profile) s)"


@query("content_diff_rescale", f"WITH {FEATS}, {STEPPED}, {_rescaled('stepped', 'scaled')} SELECT image_id, y, round(strength,9) AS strength, round(gray_diff,9) AS gray_diff FROM scaled")
def _(t):
    rows = feats(t)
    cuts = rows.select("image_id", "y", (F.lit(0.5) + F.col("y") % 50 / 100.0).alias("strength"))
    scaled = R.content_difference(cuts, rows, KEYS)
    return scaled.select("image_id", "y", F.round("strength", 9).alias("strength"), F.round("gray_diff", 9).alias("gray_diff"))


def _spans(cuts, name="spans"):
    return f"""{name}_in AS (SELECT image_id, ord, span_y1 AS y1, span_y2 AS y2, strength, meta_e AS edge FROM {cuts} WHERE kind='black_bar' AND span_y2-span_y1>=24),
 {name}_flag AS (SELECT *, CASE WHEN y1 <= max(y2) OVER (PARTITION BY image_id ORDER BY y1, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 0 ELSE 1 END AS f FROM {name}_in),
 {name} AS (SELECT image_id, min(y1) AS y1, max(y2) AS y2, max(strength) AS strength, max(edge) AS edge FROM (SELECT *, sum(f) OVER (PARTITION BY image_id ORDER BY y1, ord ROWS UNBOUNDED PRECEDING) AS g FROM {name}_flag) s GROUP BY image_id, g)"""


@query("span_merge", f"WITH {LISTED}, {_spans('listed')} SELECT image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2, round(strength,6) AS strength, round(edge,6) AS edge FROM spans")
def _(t):
    return D.bar_spans(listed(t), KEYS).select("image_id", "y1", "y2", r6("strength"), r6("edge"))


def _split(cuts, intervals, name="raw"):
    return f"""{name}_pts AS (SELECT image_id, iv_y1, iv_y2, iv_y1 AS y FROM {intervals} WHERE iv_y2>iv_y1 UNION SELECT v.image_id, iv_y1, iv_y2, c.y FROM {intervals} v JOIN {cuts} c ON c.image_id=v.image_id AND c.y>iv_y1 AND c.y<iv_y2),
 {name} AS (SELECT image_id, iv_y1, iv_y2, y AS y1, lead(y,1,iv_y2) OVER (PARTITION BY image_id, iv_y1 ORDER BY y) AS y2 FROM {name}_pts)"""


WHOLE = "whole AS (SELECT image_id, 0 AS iv_y1, 4000 AS iv_y2 FROM cut_list GROUP BY image_id)"


def whole(t):
    return t("cut_list").select("image_id").distinct().withColumns({"iv_y1": F.lit(0), "iv_y2": F.lit(4000)})


@query("cuts_to_intervals", f"WITH {LISTED}, {WHOLE}, {_split('listed', 'whole')} SELECT image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2 FROM raw")
def _(t):
    return D.split_intervals(whole(t), listed(t), KEYS).select("image_id", "y1", "y2")


def _small(raw="raw", name="small"):
    return f"""{name}_seq AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id, iv_y1) AS n, lead(y2-y1) OVER w AS nh FROM {raw} WINDOW w AS (PARTITION BY image_id, iv_y1 ORDER BY y1)),
 {name}_fold AS (
   SELECT image_id, iv_y1, i, n, CASE WHEN y2-y1>=180 OR n=1 THEN [{{'a': y1, 'b': y2}}] ELSE [] END AS done, CASE WHEN y2-y1>=180 OR n=1 THEN NULL ELSE y1 END AS p FROM {name}_seq WHERE i=1
   UNION ALL
   SELECT image_id, iv_y1, i, n,
     CASE WHEN y2-a>=180 OR (i=n AND len(done)=0) THEN list_append(done, {{'a': a, 'b': y2}}) WHEN i<n AND (len(done)=0 OR nh>=done[-1].b-done[-1].a) THEN done
          ELSE list_append(done[:-2], {{'a': done[-1].a, 'b': y2}}) END,
     CASE WHEN y2-a>=180 OR (i=n AND len(done)=0) THEN NULL WHEN i<n AND (len(done)=0 OR nh>=done[-1].b-done[-1].a) THEN a END
   FROM (SELECT s.*, r.done, coalesce(r.p, s.y1) AS a FROM {name}_fold r JOIN {name}_seq s ON s.image_id=r.image_id AND s.iv_y1=r.iv_y1 AND s.i=r.i+1) q),
 {name} AS (SELECT image_id, d.a AS y1, d.b AS y2 FROM (SELECT image_id, unnest(done) AS d FROM {name}_fold WHERE i=n) u)"""


@query("merge_small_bands", f"WITH RECURSIVE {LISTED}, {WHOLE}, {_split('listed', 'whole')}, {_small()} SELECT image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2 FROM small")
def _(t):
    return D.merge_small(D.split_intervals(cut_lineage(whole(t)), cut_lineage(listed(t)), KEYS), KEYS).select("image_id", "y1", "y2")


def _scored(bands, cuts, name="scored"):
    return f"""{name}_near AS (SELECT b.image_id, b.y1, b.y2, (SELECT max(y) FROM {cuts} c WHERE c.image_id=b.image_id AND c.y<=b.y1) AS ya, (SELECT min(y) FROM {cuts} c WHERE c.image_id=b.image_id AND c.y>=b.y2) AS yb FROM {bands} b),
 {name}_ends AS (SELECT n.*, a.s AS sa, a.k AS ka, b.s AS sb, b.k AS kb FROM {name}_near n
   LEFT JOIN (SELECT image_id, y, arg_min(strength, ord) AS s, arg_min(kind, ord) AS k FROM {cuts} GROUP BY image_id, y) a ON a.image_id=n.image_id AND a.y=n.ya
   LEFT JOIN (SELECT image_id, y, arg_min(strength, ord) AS s, arg_min(kind, ord) AS k FROM {cuts} GROUP BY image_id, y) b ON b.image_id=n.image_id AND b.y=n.yb),
 {name}_in AS (SELECT e.image_id, e.y1, e.y2, avg(c.strength) AS m, arg_max(c.kind, 1000000*{RANK.format('c.kind')} - c.ord) AS k FROM {name}_ends e JOIN {cuts} c ON c.image_id=e.image_id AND c.y BETWEEN e.y1 AND e.y2 WHERE e.ya IS NULL AND e.yb IS NULL GROUP BY 1,2,3),
 {name} AS (SELECT e.image_id, e.y1, e.y2, least(greatest(CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN (sa+sb)/2e0 ELSE coalesce(sa,sb,i.m,CASE WHEN h.image_id IS NULL THEN 0.2e0 ELSE 0.3e0 END) END,0e0),1e0) AS score,
   CASE WHEN kb IS NOT NULL AND (ka IS NULL OR {RANK.format('kb')}>{RANK.format('ka')}) THEN kb ELSE coalesce(ka, i.k, CASE WHEN h.image_id IS NULL THEN 'fallback_chunk' ELSE 'structure' END) END AS reason
   FROM {name}_ends e LEFT JOIN {name}_in i ON i.image_id=e.image_id AND i.y1=e.y1 AND i.y2=e.y2 LEFT JOIN (SELECT DISTINCT image_id FROM {cuts}) h ON h.image_id=e.image_id)"""


BAND_OUT = "image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2, round(score,6) AS score, reason"


def _band_out(df):
    return df.select("image_id", "y1", "y2", r6("score"), "reason")


# Bands of 450 rows and one band of the whole image, so that cuts lie above, below, inside or nowhere.
FIXED = "fixed AS (SELECT image_id, 450*k AS y1, 450*k+450 AS y2 FROM (SELECT DISTINCT CAST(floor(event_id/35) AS BIGINT) AS image_id FROM events) i CROSS JOIN (SELECT unnest(range(0,9)) AS k) q UNION ALL SELECT DISTINCT CAST(floor(event_id/35) AS BIGINT), 0, 4050 FROM events)"


def fixed(t):
    images = t("events").select(F.floor(F.col("event_id") / 35).alias("image_id")).distinct()
    pieces = images.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("image_id", (F.col("k") * 450).alias("y1"), (F.col("k") * 450 + 450).alias("y2"))
    return pieces.unionByName(images.withColumns({"y1": F.lit(0), "y2": F.lit(4050)}))


@query("band_nearest_cuts", f"WITH {LISTED}, {FIXED}, {_scored('fixed', 'listed')} SELECT {BAND_OUT} FROM scored")
def _(t):
    return _band_out(D.score_bands(cut_lineage(fixed(t)), cut_lineage(listed(t)), KEYS))


HEIGHTS = "heights AS (SELECT CAST(floor(event_id/35) AS BIGINT) AS image_id, 3000 + CAST(min(event_id)%9 AS INT)*500 AS height FROM events GROUP BY 1)"


def heights(t):
    images = t("events").groupBy(F.floor(F.col("event_id") / 35).alias("image_id")).agg(F.min("event_id").alias("e"))
    return images.select("image_id", (F.lit(3000) + (F.col("e") % 9).cast("int") * 500).alias("height"))


@query(
    "fallback_chunks",
    f"WITH {HEIGHTS} SELECT image_id, CAST(y AS INT) AS y1, CAST(least(y+2600,height) AS INT) AS y2, 0.2e0 AS score, 'fallback_chunk' AS reason FROM (SELECT image_id, height, unnest(range(0,height,2600)) AS y FROM heights) s",
)
def _(t):
    return D.fallback_chunks(heights(t), KEYS)


def _built(cuts, images, name="built"):
    return f"""{_spans(cuts, name + '_bar')},
 {name}_cuts AS (SELECT image_id, y, strength, kind, ord FROM {cuts} UNION ALL SELECT image_id, y1, greatest(0.8e0,strength), 'black_bar', 500000 FROM {name}_bar UNION ALL SELECT image_id, y2, greatest(0.8e0,strength), 'black_bar', 500000 FROM {name}_bar),
 {name}_own AS (SELECT b.image_id, least(greatest(b.y1,0),h.height) AS y1, least(greatest(b.y2,0),h.height) AS y2, b.strength, b.edge FROM {name}_bar b JOIN {images} h ON h.image_id=b.image_id),
 {name}_iv AS (SELECT image_id, coalesce(max(y2) OVER (PARTITION BY image_id ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS iv_y1, y1 AS iv_y2 FROM {name}_own
   UNION ALL SELECT h.image_id, coalesce((SELECT max(y2) FROM {name}_own o WHERE o.image_id=h.image_id),0), h.height FROM {images} h WHERE h.image_id IN (SELECT image_id FROM {cuts})),
 {_split(name + '_cuts', name + '_iv', name + '_raw')}, {_small(name + '_raw', name + '_small')}, {_scored(name + '_small', name + '_cuts', name + '_score')},
 {name} AS (SELECT image_id, y1, y2, score, reason FROM {name}_score
   UNION ALL SELECT image_id, y1, y2, CASE WHEN edge>=0.02e0 THEN least(least(greatest(0.6e0+0.4e0*strength,0e0),1e0),0.45e0) ELSE least(greatest(0.6e0+0.4e0*strength,0e0),1e0) END, 'black_bar_band' FROM {name}_own WHERE y2>y1
   UNION ALL SELECT image_id, y, least(y+2600,height), 0.2e0, 'fallback_chunk' FROM (SELECT image_id, height, unnest(range(0,height,2600)) AS y FROM {images} WHERE image_id NOT IN (SELECT image_id FROM {cuts})) c)"""


@query("build_bands", f"WITH RECURSIVE {LISTED}, {_merged('listed')}, {HEIGHTS}, {_built('merged', 'heights')} SELECT {BAND_OUT} FROM built")
def _(t):
    return _band_out(D.build_bands(heights(t), D.merge_cuts(listed(t), KEYS), KEYS))


@query(
    "band_feature_means",
    f"""WITH {FEATS} SELECT b.image_id, CAST(b.y1 AS INT) AS y1, CAST(b.y2 AS INT) AS y2, round(coalesce(avg(f.white_ratio),0e0),9) AS white_mean, round(coalesce(avg(f.edge_density),0e0),9) AS edge_mean
        FROM band_list b LEFT JOIN feats f ON f.image_id=b.image_id AND f.y>=b.y1 AND f.y<b.y2 GROUP BY 1,2,3""",
)
def _(t):
    return D.band_feature_means(t("band_list"), feats(t), KEYS).select("image_id", "y1", "y2", F.round("white_mean", 9).alias("white_mean"), F.round("edge_mean", 9).alias("edge_mean"))


@query(
    "band_content_score",
    f"""WITH {FEATS} SELECT image_id, y1, y2, round(least(greatest(0.6e0*least(greatest(1e0-w,0e0),1e0)+0.4e0*least(greatest(least(greatest(e,0e0),1e0)/0.02e0,0e0),1e0),0e0),1e0),6) AS content
        FROM (SELECT b.image_id, CAST(b.y1 AS INT) AS y1, CAST(b.y2 AS INT) AS y2, avg(f.white_ratio) AS w, avg(f.edge_density) AS e FROM band_list b JOIN feats f ON f.image_id=b.image_id AND f.y>=b.y1 AND f.y<b.y2 GROUP BY 1,2,3) s""",
)
def _(t):
    from panelweave.functions.geometry import band_content_score

    means = D.band_feature_means(t("band_list"), feats(t), KEYS).where("row_count > 0")
    return means.select("image_id", "y1", "y2", F.round(band_content_score(F.col("white_mean"), F.col("edge_mean")), 6).alias("content"))


def detected(t):
    """Cuts of the row profiles, merged and weakened where both sides look alike."""
    rows = cut_lineage(feats(t))
    found = R.detect_gutters(rows, KEYS).withColumn("ord", F.lit(0) + F.col("y"))
    found = found.unionByName(R.detect_black_bars(rows, KEYS).withColumn("ord", F.lit(1_000_000) + F.col("y")))
    return rows, R.content_difference(D.merge_cuts(found, KEYS), rows, KEYS)


SPLIT = f"""WITH RECURSIVE {FEATS}, {GUTTERS}, {BARS}, found AS (SELECT *, y AS ord FROM gutters UNION ALL SELECT *, 1000000+y FROM bars), {_merged('found')}, {_rescaled('merged', 'scaled')},
 tall AS (SELECT image_id, max(y)+1 AS height FROM row_profile GROUP BY image_id), {_built('scaled', 'tall')} SELECT image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2, round(score,9) AS score, reason FROM built"""


def profile_bands(t):
    rows, cuts = detected(t)
    images = t("row_profile").groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    return rows, D.build_bands(images, cuts, KEYS)


@query("profile_bands", SPLIT)
def _(t):
    return profile_bands(t)[1].select("image_id", "y1", "y2", F.round("score", 9).alias("score"), "reason")


@query("refine_bands")
def _(t):
    rows, _bands = profile_bands(t)
    fine = t("band_list").select("image_id", "y1", "y2", "score", F.when(F.col("reason") == "black_bar", "black_bar_band").otherwise(F.col("reason")).alias("reason"))
    return _band_out(D.refine_bands(fine, rows, KEYS))


@query("band_split_refined")
def _(t):
    rows, built = profile_bands(t)
    return _band_out(D.refine_bands(built, rows, KEYS))


LINES = """lines_ AS MATERIALIZED (SELECT *, (sy1+sy2)*0.5e0 AS mid_y, CAST(least(floor(th/pi()*18),17) AS INT) AS angle_bin FROM (SELECT *, CASE WHEN atan2(sy2-sy1,sx2-sx1)<0 THEN atan2(sy2-sy1,sx2-sx1)+pi() ELSE atan2(sy2-sy1,sx2-sx1) END AS th,
 sqrt(power(sx2-sx1,2)+power(sy2-sy1,2)) AS length FROM segments) s WHERE length>=350e0)"""
STATS = """ang AS MATERIALIZED (SELECT image_id, angle_bin, count(*) AS n FROM lines_ GROUP BY 1,2),
 ybins AS (SELECT image_id, CAST(least(floor(mid_y*42/1000e0),41) AS INT) AS yb, count(*) AS n FROM lines_ WHERE mid_y>=0 AND mid_y<=1000 GROUP BY 1,2),
 stats AS MATERIALIZED (SELECT a.image_id, a.dominance, CAST(a.dominant_bin AS INT) AS dominant_bin, coalesce(y.concentration,0e0) AS concentration, l.max_len,
   CASE WHEN l.max_len>=600e0 THEN a.dominance>=0.45e0 OR coalesce(y.concentration,0e0)>=0.22e0 ELSE a.dominance>=0.45e0 AND coalesce(y.concentration,0e0)>=0.22e0 END AS passes
   FROM (SELECT image_id, max(n)/CAST(sum(n) AS DOUBLE) AS dominance, arg_max(angle_bin, n*100-angle_bin) AS dominant_bin FROM ang GROUP BY 1) a
   LEFT JOIN (SELECT image_id, max(n)/CAST(sum(n) AS DOUBLE) AS concentration FROM ybins GROUP BY 1) y ON y.image_id=a.image_id
   JOIN (SELECT image_id, max(length) AS max_len FROM lines_ GROUP BY 1) l ON l.image_id=a.image_id)"""
DENSITY = """dens AS MATERIALIZED (SELECT image_id, CAST(y AS INT) AS y, sum(share)/1000e0 AS density FROM (SELECT image_id, length/(greatest(sy1,sy2)-least(sy1,sy2)+1) AS share,
 unnest(range(least(least(sy1,sy2),999), least(greatest(sy1,sy2),999)+1)) AS y FROM lines_ WHERE image_id IN (SELECT image_id FROM stats WHERE passes)) s GROUP BY 1,2)"""
RUNS = """line_runs AS MATERIALIZED (SELECT image_id, min(y) AS y1, max(y)+1 AS y2 FROM (SELECT image_id, y, y-row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM dens WHERE density>=0.12e0) s GROUP BY image_id, g HAVING max(y)+1-min(y)>=10)"""
INRUN = """inrun AS MATERIALIZED (SELECT * FROM (SELECT r.image_id, r.y1, r.y2, l.mid_y, l.length, l.angle_bin=s.dominant_bin AS is_dom, bool_or(l.angle_bin=s.dominant_bin) OVER (PARTITION BY r.image_id, r.y1) AS has_dom
 FROM line_runs r JOIN lines_ l ON l.image_id=r.image_id AND l.mid_y>=r.y1 AND l.mid_y<=r.y2 JOIN stats s ON s.image_id=r.image_id) q WHERE is_dom OR NOT has_dom)"""


def _median(source, keys, name):
    return f"""{name} AS MATERIALIZED (SELECT {keys}, min(mid_y) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY mid_y ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY {keys}) AS a
      FROM (SELECT {keys}, mid_y, sum(length) AS w FROM {source} GROUP BY {keys}, mid_y) m) q WHERE c>=a*0.5e0 GROUP BY {keys})"""


def _lines(t):
    return R.long_segments(t("segments"), 1000)


def _line_parts(t):
    lines, tasks = R.laid_lines(t("segments"), KEYS, 1000)
    stats = cut_lineage(R.orientation_stats(lines, KEYS, 1000, 1000).where("passes"))
    lines = lines.join(stats.select("image_id"), "image_id", "left_semi")
    density = cut_lineage(R.line_density(lines, KEYS, 1000, 1000, tasks))
    runs = cut_lineage(R.true_runs(density, KEYS, "y", F.col("density") >= 0.12, tasks=tasks).where("y2 - y1 >= 10"))
    return lines, stats, density, runs, tasks


@query("orientation_stats", f"WITH {LINES}, {STATS} SELECT image_id, round(dominance,6) AS dominance, dominant_bin, round(concentration,6) AS concentration, round(max_len,6) AS max_len, passes FROM stats")
def _(t):
    stats = R.orientation_stats(_lines(t), KEYS, 1000, 1000)
    return stats.select("image_id", r6("dominance"), "dominant_bin", r6("concentration"), r6("max_len"), "passes")


@query("line_density", f"WITH {LINES}, {STATS}, {DENSITY} SELECT image_id, y, round(density,6) AS density FROM dens")
def _(t):
    return _line_parts(t)[2].select("image_id", "y", r6("density"))


@query("segments_in_span", f"WITH {LINES}, {STATS}, {DENSITY}, {RUNS}, {INRUN} SELECT image_id, CAST(y1 AS INT) AS y1, CAST(y2 AS INT) AS y2, mid_y, CAST(count(*) AS BIGINT) AS n, round(sum(length),4) AS length FROM inrun GROUP BY 1,2,3,4")
def _(t):
    lines, stats, _density, runs, tasks = _line_parts(t)
    return R.segments_in_runs(lines, runs, stats, KEYS, tasks).select("image_id", "y1", "y2", "mid_y", "n", F.round("length", 4).alias("length"))


@query("weighted_median", f"WITH {LINES}, {_median('lines_', 'image_id', 'med')} SELECT image_id, median FROM med")
def _(t):
    return R.weighted_median(_lines(t), KEYS)


@query(
    "detect_hard_lines",
    f"""WITH {LINES}, {STATS}, {DENSITY}, {RUNS}, {INRUN}, {_median('inrun', 'image_id, y1, y2', 'near')}, {_median('lines_', 'image_id', 'overall')},
    placed AS (SELECT r.image_id, r.y1, r.y2, least(greatest(CAST(trunc(coalesce(n.median,o.median)) AS INT),0),999) AS y FROM line_runs r LEFT JOIN near n ON n.image_id=r.image_id AND n.y1=r.y1 AND n.y2=r.y2 LEFT JOIN overall o ON o.image_id=r.image_id)
    SELECT p.image_id, p.y, round(least(greatest(0.6e0*least(greatest(coalesce(d.density,0e0)/0.12e0,0e0),1e0)+0.2e0*s.dominance+0.2e0*s.concentration,0e0),1e0),6) AS strength, 'hard_line' AS kind,
      CAST(CASE WHEN least(p.y+9,1000)>greatest(p.y-9,0) THEN greatest(p.y-9,0) ELSE y1 END AS INT) AS span_y1, CAST(CASE WHEN least(p.y+9,1000)>greatest(p.y-9,0) THEN least(p.y+9,1000) ELSE y2 END AS INT) AS span_y2
    FROM placed p JOIN stats s ON s.image_id=p.image_id LEFT JOIN dens d ON d.image_id=p.image_id AND d.y=p.y""",
)
def _(t):
    return _cut_out(R.detect_hard_lines(t("segments"), KEYS, 1000, 1000))
