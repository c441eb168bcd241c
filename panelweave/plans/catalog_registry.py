"""Run, asset and user state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import packaging as P
from panelweave.operators import registry as R
from panelweave.plans.registry import query

# Meta records, and state saved by users: some runs have both, some one of them.
METAS = "metas AS (SELECT id AS prefix, CASE WHEN run_no%9=0 THEN '' ELSE concat('in/', file) END AS image, split_mode, panel_count, text_count, assigned_count, mtime, note, concat('clean/', id, '.png') AS clean_image FROM runs WHERE has_pipeline_meta)"
UI = "ui AS (SELECT id, file, status, strftime(mtime, '%m/%d %H:%M') AS time, CASE WHEN run_no%7=0 THEN 'stopped' ELSE '' END AS error FROM runs WHERE has_ui_meta OR NOT has_pipeline_meta)"
NORMAL = "CASE WHEN {s}='running' THEN {r} ELSE {s} END"
DONE = f"""done AS (SELECT m.prefix AS id, CASE WHEN m.image<>'' THEN substr(m.image,4) ELSE concat(m.prefix,'.psd') END AS file, CASE WHEN coalesce(u.status,'success')='running' THEN 'success' ELSE coalesce(u.status,'success') END AS status,
 CASE WHEN m.split_mode='stage2' THEN 'advanced' ELSE 'normal' END AS strategy, m.panel_count AS panels, m.text_count AS texts, coalesce(u.time,'') AS time, CASE WHEN u.status='running' THEN '' ELSE coalesce(u.error,'') END AS error, m.image AS image_path FROM metas m LEFT JOIN ui u ON u.id=m.prefix)"""
LOADED = f"""loaded AS (SELECT * FROM done UNION ALL SELECT id, file, CASE WHEN status='running' THEN 'error' ELSE status END, NULL, NULL, NULL, time, CASE WHEN status='running' AND error='' THEN '{R.INTERRUPTED}' ELSE error END, NULL FROM ui WHERE id NOT IN (SELECT id FROM done))"""


def metas(t):
    image = F.when(F.col("run_no") % 9 == 0, "").otherwise(F.concat(F.lit("in/"), "file"))
    return t("runs").where("has_pipeline_meta").select(
        F.col("id").alias("prefix"), image.alias("image"), "split_mode", "panel_count", "text_count", "assigned_count", "mtime", "note",
        F.concat(F.lit("clean/"), "id", F.lit(".png")).alias("clean_image"),
    )


def ui(t):
    error = F.when(F.col("run_no") % 7 == 0, "stopped").otherwise("")
    return t("runs").where("has_ui_meta OR NOT has_pipeline_meta").select("id", "file", "status", R.display_time(F.col("mtime"), short=True).alias("time"), error.alias("error"))


def loaded(t):
    return R.load_registry(metas(t), ui(t))


@query("run_from_meta", f"WITH {METAS}, {UI}, {DONE} SELECT * FROM done")
def _(t):
    return R.runs_from_metas(metas(t), ui(t))


@query("run_registry_load", f"WITH {METAS}, {UI}, {DONE}, {LOADED} SELECT * FROM loaded")
def _(t):
    return loaded(t)


@query("run_normalize", f"SELECT id, CASE WHEN status='running' THEN CASE WHEN has_pipeline_meta THEN 'success' ELSE 'error' END ELSE status END AS status, CASE WHEN status='running' THEN CASE WHEN has_pipeline_meta THEN '' WHEN note<>'' THEN note ELSE '{R.INTERRUPTED}' END ELSE note END AS error FROM runs")
def _(t):
    runs = t("runs").withColumn("error", F.col("note"))
    return R.normalize_runs(runs, F.col("has_pipeline_meta")).select("id", "status", "error")


@query("runs_filter", f"WITH {METAS}, {UI}, {DONE}, {LOADED} SELECT id, file, status FROM loaded WHERE status='error' AND (contains(lower(id),'_1') OR contains(lower(file),'_1'))")
def _(t):
    return R.filter_runs(loaded(t), "error", "_1").select("id", "file", "status")


@query("runs_order", f"WITH {METAS}, {UI}, {DONE}, {LOADED} SELECT id, file, status, CASE status WHEN 'running' THEN 0 WHEN 'error' THEN 1 WHEN 'success' THEN 2 ELSE 3 END AS status_rank FROM loaded ORDER BY 4, 1")
def _(t):
    return R.order_runs(loaded(t)).select("id", "file", "status", "status_rank")


@query("run_lookup", f"WITH {METAS}, {UI}, {DONE}, {LOADED} SELECT id, file, status FROM loaded WHERE id='run_77'")
def _(t):
    return loaded(t).where(F.col("id") == "run_77").select("id", "file", "status")


@query("status_counts", "SELECT CAST(count(*) AS BIGINT) AS \"all\", CAST(count(*) FILTER (WHERE status='success') AS BIGINT) AS success, CAST(count(*) FILTER (WHERE status='running') AS BIGINT) AS running, CAST(count(*) FILTER (WHERE status='error') AS BIGINT) AS error FROM runs")
def _(t):
    return R.status_counts(t("runs"))


UPLOADS = "uploads AS (SELECT concat('asset_', CAST(c_custkey AS VARCHAR), CASE WHEN c_nationkey%2=0 THEN '.psd' ELSE '.psb' END) AS name, concat('uploads/asset_', CAST(c_custkey AS VARCHAR), CASE WHEN c_nationkey%2=0 THEN '.psd' ELSE '.psb' END) AS path FROM customer UNION ALL SELECT concat('asset_', CAST(s_suppkey AS VARCHAR), '.psb'), concat('uploads/asset_', CAST(s_suppkey AS VARCHAR), '.psb') FROM supplier)"
EXISTING = "existing AS (SELECT DISTINCT image AS path FROM metas WHERE image<>'' AND text_count%2=0)"


def uploads(t):
    ext = F.when(F.col("c_nationkey") % 2 == 0, ".psd").otherwise(".psb")
    first = t("customer").select(F.concat(F.lit("asset_"), "c_custkey", ext).alias("name"))
    both = first.unionByName(t("supplier").select(F.concat(F.lit("asset_"), "s_suppkey", F.lit(".psb")).alias("name")))
    return both.withColumn("path", F.concat(F.lit("uploads/"), "name"))


FILES = f"""{METAS}, {UPLOADS}, {EXISTING}, files AS (SELECT name, path, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, o, path) AS r FROM (
 SELECT name, path, 'upload' AS source, CASE WHEN suffix(path,'.psd') THEN 0 ELSE 1 END AS p, path AS o FROM uploads UNION ALL SELECT substr(image,4), image, 'existing', 2, prefix FROM metas WHERE image IN (SELECT path FROM existing)) u) q WHERE r=1)"""


def files(t):
    known = metas(t)
    return R.list_asset_files(uploads(t), known, known.where("image <> '' AND text_count % 2 = 0").select(F.col("image").alias("path")).distinct())


@query("asset_files_list", f"WITH {FILES} SELECT * FROM files")
def _(t):
    return files(t)


@query("assets_union", f"WITH {FILES} SELECT source, CAST(count(*) AS BIGINT) AS names FROM files GROUP BY 1")
def _(t):
    return files(t).groupBy("source").agg(F.count(F.lit(1)).alias("names"))


ROLLUP = f"""{METAS}, placed AS (SELECT *, substr(image,4) AS file, concat(prefix,'_pipeline_meta.json') AS o FROM metas WHERE image<>''),
 rollup_ AS (SELECT file, max(panel_count) AS panels, coalesce(arg_max(CAST(floor(100*assigned_count/CAST(nullif(text_count,0) AS DOUBLE)) AS INT), o) FILTER (WHERE text_count>0),0) AS coverage, arg_max(strftime(mtime,'%Y/%m/%d %H:%M'), o) AS updated,
  coalesce(arg_max(note, o) FILTER (WHERE note<>''),'') AS notes, arg_min(image, o) AS image_path, arg_min(prefix, o) AS preview_run, CAST(count(*) AS BIGINT) AS run_count FROM placed GROUP BY 1)"""


@query("asset_rollup", f"WITH {ROLLUP} SELECT * FROM rollup_")
def _(t):
    return R.asset_rollup(metas(t))


@query("asset_runs", f"WITH {METAS} SELECT substr(image,4) AS file, prefix AS id, CASE WHEN split_mode='stage2' THEN 'advanced' ELSE 'normal' END AS strategy, panel_count AS panels, text_count AS texts FROM metas WHERE image<>''")
def _(t):
    return R.asset_runs(metas(t))


@query("assets_search", f"WITH {ROLLUP} SELECT file, panels FROM rollup_ WHERE contains(lower(file),'t_3')")
def _(t):
    return R.asset_rollup(metas(t)).where(F.contains(F.lower("file"), F.lit("t_3"))).select("file", "panels")


@query("latest_run", f"WITH {METAS} SELECT file, id FROM (SELECT substr(image,4) AS file, prefix AS id, row_number() OVER (PARTITION BY image ORDER BY mtime DESC, concat(prefix,'_pipeline_meta.json')) AS r FROM metas WHERE image<>'') s WHERE r=1")
def _(t):
    return R.latest_runs(metas(t))


# Rows of three files per run: panels and texts by part and line item keys, bindings by customer.
@query(
    "run_result",
    f"""WITH {METAS} SELECT r.id, r.status, m.clean_image, CAST(coalesce(p.n,0) AS BIGINT) AS panel_rows, CAST(coalesce(x.n,0) AS BIGINT) AS text_rows, CAST(coalesce(b.n,0) AS BIGINT) AS binding_rows FROM runs r LEFT JOIN metas m ON m.prefix=r.id
        LEFT JOIN (SELECT concat('run_',CAST(p_size AS VARCHAR)) AS id, count(*) AS n FROM part GROUP BY 1) p ON p.id=r.id LEFT JOIN (SELECT concat('run_',CAST(l_orderkey AS VARCHAR)) AS id, count(*) AS n FROM lineitem GROUP BY 1) x ON x.id=r.id
        LEFT JOIN (SELECT concat('run_',CAST(c_custkey AS VARCHAR)) AS id, count(*) AS n FROM customer GROUP BY 1) b ON b.id=r.id""",
)
def _(t):
    def rows(table, key):
        return t(table).select(F.concat(F.lit("run_"), key).alias("run_id"))

    out = R.run_results(t("runs").select("id", "status"), metas(t), rows("part", "p_size"), rows("lineitem", "l_orderkey"), rows("customer", "c_custkey"))
    return out.select("id", "status", "clean_image", "panel_rows", "text_rows", "binding_rows")


@query("strip_binding", "SELECT text_id, CAST(NULL AS BIGINT) AS primary_panel_id, CASE WHEN text_id%4=0 THEN NULL ELSE page_id*3 END AS detected_panel_id FROM texts")
def _(t):
    items = t("texts").select("text_id", F.when(F.col("text_id") % 4 != 0, F.col("page_id") * 3).alias("primary_panel_id"))
    return R.strip_binding(items)


SCRIPTS = """scripts AS (SELECT p_partkey AS panel_id, CASE WHEN p_size%5=0 THEN concat('b', p_brand) END AS binding, CASE WHEN p_size%5=1 THEN concat('old', p_brand) END AS legacy_binding, CASE WHEN p_size%5=2 THEN p_type ELSE '' END AS selected_text_ids,
 CASE WHEN p_size%2=0 THEN p_name END AS nested_script, concat('whole ', p_name) AS whole_script FROM part)"""
BOUND = "bound AS (SELECT panel_id, coalesce(binding, legacy_binding, CASE WHEN selected_text_ids<>'' THEN concat('made:', CAST(panel_id AS VARCHAR), ':', selected_text_ids) END) AS binding, coalesce(nested_script, whole_script) AS script FROM scripts)"


def scripts(t):
    kind = F.col("p_size") % 5
    raw = t("part").select(
        F.col("p_partkey").alias("panel_id"), F.when(kind == 0, F.concat(F.lit("b"), "p_brand")).alias("binding"), F.when(kind == 1, F.concat(F.lit("old"), "p_brand")).alias("legacy_binding"),
        F.when(kind == 2, F.col("p_type")).otherwise("").alias("selected_text_ids"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("nested_script"), F.concat(F.lit("whole "), "p_name").alias("whole_script"),
    )
    return R.normalize_script_binding(raw)


@query("script_binding_normalize", f"WITH {SCRIPTS}, {BOUND} SELECT panel_id, binding, script FROM bound")
def _(t):
    return scripts(t).select("panel_id", "binding", "script")


@query(
    "asset_detail",
    f"""WITH {SCRIPTS}, {BOUND}, items AS (SELECT text_id, page_id*3 AS primary_panel_id FROM texts) SELECT p.panel_id, p.page_id, CAST(coalesce(i.n,0) AS BIGINT) AS text_count, b.script, coalesce(b.binding, c.c_name) AS script_binding, coalesce(s.s_name,'') AS note
        FROM panels p LEFT JOIN (SELECT primary_panel_id AS panel_id, count(*) AS n FROM items GROUP BY 1) i ON i.panel_id=p.panel_id LEFT JOIN bound b ON b.panel_id=p.panel_id
        LEFT JOIN customer c ON c.c_custkey=p.panel_id LEFT JOIN supplier s ON s.s_suppkey=p.panel_id""",
)
def _(t):
    items = t("texts").select("text_id", (F.col("page_id") * 3).alias("primary_panel_id"))
    bindings = t("customer").select(F.col("c_custkey").alias("panel_id"), F.col("c_name").alias("binding"))
    notes = t("supplier").select(F.col("s_suppkey").alias("panel_id"), F.col("s_name").alias("note"))
    return R.asset_detail(t("panels").select("panel_id", "page_id"), items, scripts(t), bindings, notes)


MANIFEST = "manifest AS (SELECT p_partkey AS panel_id, 0 AS ord, concat('a/', CAST(p_partkey AS VARCHAR), '.png') AS image_path, concat('a/', CAST(p_partkey AS VARCHAR), '.txt') AS txt_path FROM part UNION ALL SELECT p_partkey, 1, 'z.png', 'z.txt' FROM part)"
LISTING = "listing AS (SELECT concat('a/', CAST(c_custkey AS VARCHAR), '.png') AS path FROM customer UNION ALL SELECT concat('a/', CAST(o_custkey AS VARCHAR), '.txt') FROM orders WHERE o_orderstatus='F')"


@query("panel_resolve", f"WITH {MANIFEST}, {LISTING} SELECT panel_id, image_path, txt_path FROM manifest WHERE ord=0 AND image_path IN (SELECT path FROM listing) AND txt_path IN (SELECT path FROM listing)")
def _(t):
    key = F.col("p_partkey")
    first = t("part").select(key.alias("panel_id"), F.lit(0).alias("ord"), F.concat(F.lit("a/"), key, F.lit(".png")).alias("image_path"), F.concat(F.lit("a/"), key, F.lit(".txt")).alias("txt_path"))
    second = t("part").select(key.alias("panel_id"), F.lit(1).alias("ord"), F.lit("z.png").alias("image_path"), F.lit("z.txt").alias("txt_path"))
    listing = t("customer").select(F.concat(F.lit("a/"), "c_custkey", F.lit(".png")).alias("path")).unionByName(
        t("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("a/"), "o_custkey", F.lit(".txt")).alias("path"))
    )
    wanted = t("part").select(key.alias("panel_id"))
    return R.resolve_panels(wanted, first.unionByName(second), listing).select("panel_id", "image_path", "txt_path")


SIGN = "SELECT concat('f', CAST(o_orderkey AS VARCHAR)) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, epoch_us(o_orderdate) AS mtime, false AS inpaint, CASE WHEN o_orderstatus='F' THEN 'pdf' ELSE 'multilang' END AS ocr_mode, 'zh' AS ocr_lang, o_orderkey FROM orders"


@query(
    "cache_hits",
    f"""WITH files AS ({SIGN}), cache AS (SELECT path, size + CASE WHEN o_orderkey%7=0 THEN 1 ELSE 0 END AS size, mtime, inpaint, CASE WHEN o_orderkey%5=0 THEN 'pdf' ELSE ocr_mode END AS ocr_mode, ocr_lang, o_orderkey%11 AS gone FROM files)
        SELECT f.path, c.path IS NOT NULL AS hit FROM files f LEFT JOIN (SELECT * FROM cache WHERE gone<>0) c ON c.path=f.path AND c.size=f.size AND c.mtime=f.mtime AND c.inpaint=f.inpaint AND c.ocr_mode=f.ocr_mode AND c.ocr_lang=f.ocr_lang""",
)
def _(t):
    key = F.col("o_orderkey")
    raw = t("orders").select(
        F.concat(F.lit("f"), key).alias("path"), F.floor("o_totalprice").alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.lit(False).alias("inpaint"),
        F.when(F.col("o_orderstatus") == "F", "pdf").otherwise("multilang").alias("ocr_mode"), F.lit("zh").alias("ocr_lang"), key,
    )
    stored = raw.select(
        "path", (F.col("size") + F.when(key % 7 == 0, 1).otherwise(0)).alias("size"), "mtime", "inpaint", F.when(key % 5 == 0, "pdf").otherwise(F.col("ocr_mode")).alias("ocr_mode"), "ocr_lang",
        F.concat(F.lit("clean"), key).alias("image_out"), F.concat(F.lit("texts"), key).alias("texts_out"),
    )
    kept = t("orders").where(key % 11 != 0)
    listing = kept.select(F.concat(F.lit("clean"), key).alias("path")).unionByName(kept.select(F.concat(F.lit("texts"), key).alias("path")))
    return R.split_by_cache(raw, stored, listing).select("path", "hit")


@query(
    "embedding_cache",
    """SELECT content_key, min(value) AS value FROM (SELECT sha1(CAST(o_custkey AS VARCHAR)) AS content_key, 'cached' AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey<12)
       UNION ALL SELECT sha1(CAST(o_custkey AS VARCHAR)), 'made' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey<12)) s GROUP BY 1""",
)
def _(t):
    def hashed(column):
        return F.sha1(F.col(column).cast("string")).alias("content_key")

    wanted = t("orders").select(hashed("o_custkey"))
    cache = t("customer").where("c_nationkey < 12").select(hashed("c_custkey"), F.lit("cached").alias("value"))
    return R.fill_cache(wanted, cache, lambda missing: missing.withColumn("value", F.lit("made")))


@query(
    "preview_to_source",
    f"""WITH {UPLOADS} SELECT r.id, concat('uploads/', replace(r.file,'.psd','.png')) AS preview_path, u.path AS source_path FROM runs r LEFT JOIN (SELECT stem, arg_min(path, k) AS path FROM (SELECT replace(replace(name,'.psd',''),'.psb','') AS stem, path, CASE WHEN suffix(path,'.psd') THEN 0 ELSE 1 END AS k FROM uploads) q GROUP BY 1) u ON u.stem=replace(r.file,'.psd','')""",
)
def _(t):
    previews = t("runs").select("id", F.concat(F.lit("uploads/"), F.replace("file", F.lit(".psd"), F.lit(".png"))).alias("preview_path"))
    return R.preview_sources(previews, uploads(t))


@query("manifest_txt_path", "SELECT p.panel_id, CASE WHEN c.c_custkey IS NULL THEN '' ELSE concat('txt/', CAST(c.c_custkey AS VARCHAR)) END AS txt_path FROM panels p LEFT JOIN customer c ON c.c_custkey=p.panel_id")
def _(t):
    paths = t("customer").select(F.col("c_custkey").alias("panel_id"), F.concat(F.lit("txt/"), "c_custkey").alias("txt_path"))
    return t("panels").select("panel_id").join(paths, "panel_id", "left").withColumn("txt_path", F.coalesce("txt_path", F.lit("")))


@query("upsert_notes", "SELECT coalesce(c.c_custkey, u.k) AS panel_id, CASE WHEN u.k IS NOT NULL THEN u.note ELSE c.c_name END AS note FROM customer c FULL OUTER JOIN (SELECT o_custkey*2 AS k, arg_max(o_orderpriority, o_orderkey) AS note FROM orders GROUP BY 1) u ON u.k=c.c_custkey")
def _(t):
    base = t("customer").select(F.col("c_custkey").alias("panel_id"), F.col("c_name").alias("note"))
    updates = t("orders").select((F.col("o_custkey") * 2).alias("panel_id"), F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("seq"))
    return R.upsert_notes(base, updates, ["panel_id"])


@query(
    "upsert_bindings",
    """SELECT coalesce(c.c_custkey, u.k) AS panel_id, CASE WHEN u.k IS NOT NULL THEN u.ids ELSE c.c_name END AS text_ids, CASE WHEN coalesce(u.cleared,false) THEN '' ELSE coalesce(c.c_mktsegment,'') END AS script_meta
       FROM customer c FULL OUTER JOIN (SELECT o_custkey*2 AS k, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS ids, arg_max(o_orderstatus='F', o_orderkey) AS gone, bool_or(o_orderstatus='F') AS cleared FROM orders GROUP BY 1) u ON u.k=c.c_custkey WHERE NOT coalesce(u.gone,false)""",
)
def _(t):
    base = t("customer").select(F.col("c_custkey").alias("panel_id"), F.col("c_name").alias("text_ids"), F.col("c_mktsegment").alias("script_meta"))
    updates = t("orders").select(
        (F.col("o_custkey") * 2).alias("panel_id"), (F.col("o_orderstatus") == "F").alias("clear"), F.col("o_orderkey").cast("string").alias("text_ids"), F.col("o_orderkey").alias("seq")
    )
    return R.upsert_bindings(base, updates, ["panel_id"])


@query(
    "run_id_dedup",
    """WITH known AS (SELECT concat('asset_', CAST(o_orderkey//3 AS VARCHAR), CASE o_orderkey%3 WHEN 0 THEN '' WHEN 1 THEN '_1' ELSE '_2' END) AS id, o_orderstatus AS s FROM orders),
       asks AS (SELECT concat('asset_', CAST(o_orderkey//3 AS VARCHAR)) AS base, o_orderkey AS seq FROM orders),
       tried AS (SELECT a.base, a.seq, k0.s AS s0, k1.s AS s1, k2.s AS s2, row_number() OVER (PARTITION BY a.base ORDER BY a.seq) AS r FROM asks a LEFT JOIN known k0 ON k0.id=a.base LEFT JOIN known k1 ON k1.id=concat(a.base,'_1') LEFT JOIN known k2 ON k2.id=concat(a.base,'_2')),
       found AS (SELECT *, CASE WHEN coalesce(s0,'')<>'F' THEN 0 WHEN coalesce(s1,'')<>'F' THEN 1 WHEN coalesce(s2,'')<>'F' THEN 2 ELSE 3 END AS n FROM tried)
       SELECT base, seq, CASE WHEN coalesce(s0,'')='O' OR (r>1 AND n=0) THEN NULL WHEN n=0 THEN base ELSE concat(base,'_',CAST(n AS VARCHAR)) END AS id, CASE WHEN coalesce(s0,'')='O' THEN 'reject' WHEN r=1 THEN 'accept' WHEN n=0 THEN 'reject' ELSE 'overwrite' END AS outcome FROM found""",
)
def _(t):
    key = F.col("o_orderkey")
    base = F.concat(F.lit("asset_"), F.floor(key / 3))
    ending = F.element_at(F.array(F.lit(""), F.lit("_1"), F.lit("_2")), (key % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    known = t("orders").select(F.concat(base, ending).alias("id"), status.alias("status"))
    return R.allot_run_ids(t("orders").select(base.alias("base"), key.alias("seq")), known)


@query("display_time", "SELECT id, strftime(mtime,'%Y/%m/%d %H:%M') AS full_time, strftime(mtime,'%m/%d %H:%M') AS short_time FROM runs")
def _(t):
    return t("runs").select("id", R.display_time(F.col("mtime")).alias("full_time"), R.display_time(F.col("mtime"), short=True).alias("short_time"))


@query("env_threshold", "SELECT o_orderkey, CASE WHEN v>=0e0 AND v<=1e0 THEN v ELSE 0.35e0 END AS value FROM (SELECT o_orderkey, try_cast(CASE WHEN o_orderkey%5=0 THEN o_orderstatus ELSE CAST(o_totalprice/300000e0 AS VARCHAR) END AS DOUBLE) AS v FROM orders) s")
def _(t):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise((F.col("o_totalprice") / 300000.0).cast("string"))
    return t("orders").select("o_orderkey", R.threshold(raw, 0.35).alias("value"))


@query("mask_secret", "SELECT doc_id, line_no, CASE WHEN length(s)<=8 THEN repeat('*', length(s)) ELSE concat(substr(s,1,4), repeat('*', greatest(4, length(s)-8)), right(s,4)) END AS masked FROM (SELECT doc_id, line_no, trim(line) AS s FROM lines UNION ALL SELECT p_partkey, -1, p_name FROM part UNION ALL SELECT r_regionkey, -2, r_name FROM region UNION ALL SELECT n_nationkey, -3, n_name FROM nation) q")
def _(t):
    secrets = t("lines").select("doc_id", "line_no", F.col("line").alias("s")).unionByName(t("part").select(F.col("p_partkey").alias("doc_id"), F.lit(-1).cast("long").alias("line_no"), F.col("p_name").alias("s")))
    for table, key, name, tag in (("region", "r_regionkey", "r_name", -2), ("nation", "n_nationkey", "n_name", -3)):
        secrets = secrets.unionByName(t(table).select(F.col(key).cast("long").alias("doc_id"), F.lit(tag).cast("long").alias("line_no"), F.col(name).alias("s")))
    return secrets.select("doc_id", "line_no", R.mask_secret(F.col("s")).alias("masked"))


@query("safe_name", "SELECT page_id, replace(replace(url,'/','_'),chr(92),'_') AS name FROM pages")
def _(t):
    return t("pages").select("page_id", R.safe_name(F.col("url")).alias("name"))


@query("csv_list", "SELECT doc_id, line_no, CAST(pos AS INT) AS pos, item FROM (SELECT doc_id, line_no, unnest(range(0,len(l))) AS pos, unnest(l) AS item FROM (SELECT doc_id, line_no, list_filter(list_transform(string_split(line,','), lambda x: trim(x)), lambda x: x<>'') AS l FROM lines) a) b")
def _(t):
    return t("lines").select("doc_id", "line_no", F.posexplode(R.csv_list(F.col("line"))).alias("pos", "item"))


@query("runs_csv_export", f"WITH {METAS}, {UI}, {DONE}, {LOADED} SELECT id AS \"Run ID\", file AS \"PSD File\", status AS \"Status\", strategy AS \"Strategy\", panels AS \"Panels\", texts AS \"Texts\", time AS \"Time\" FROM loaded")
def _(t):
    return R.export_columns(loaded(t))
