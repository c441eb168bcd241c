"""Write-and-read-back and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import texts as X
from panelweave.operators.registry import export_columns
from panelweave.plans import catalog_registry as CR
from panelweave.plans import catalog_scripts as CS
from panelweave.plans import catalog_texts as CT
from panelweave.plans.registry import query
from panelweave.session import shared_folder
from panelweave.sources import readers, writers
from panelweave.streaming import streams


@query("bands_sink", "SELECT image_id, band_index, y1, y2, reason, round(score,6) AS score FROM band_list")
def _(t):
    path = shared_folder(t.spark, "bands")
    bands = t("band_list").select("image_id", "band_index", "y1", "y2", "reason", F.round("score", 6).alias("score"))
    writers.write_bands(bands, path)
    return t.spark.read.schema(bands.schema).json(path)


ORDERED = "SELECT page_id, primary_panel_id AS panel_id, CAST(text_id AS VARCHAR) AS text_id, text, CAST(row_number() OVER (PARTITION BY page_id, primary_panel_id ORDER BY rel_y1, rel_x1, text_id) AS INT) AS reading_no FROM items WHERE status='assigned'"


@query("panel_text_files", f"WITH {CT.ITEMS} {ORDERED}")
def _(t):
    path = shared_folder(t.spark, "panel-texts")
    writers.write_panel_texts(X.reading_order(CT.items(t), CT.KEYS), path, CT.KEYS)
    rows = readers.scan_panel_texts(t.spark, path, [*CT.KEYS, "panel_id"])
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("panel_id").cast("long").alias("panel_id"), "text_id", "text", "reading_no")


@query("panel_text_scan", "SELECT CAST(event_id AS VARCHAR) AS text_id, event_type AS text FROM events WHERE event_id%4=0")
def _(t):
    path = shared_folder(t.spark, "lines")
    line = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("event_id").alias("text_id"), F.col("event_type").alias("text"))))
    line = line.when(F.col("event_id") % 4 == 1, "  ").when(F.col("event_id") % 4 == 2, "[1,2]").otherwise('"bare"')
    t("events").select(line.alias("value")).write.text(path)
    return readers.scan_panel_texts(t.spark, path).select("text_id", "text")


@query("runs_csv_sink", f"WITH {CR.METAS}, {CR.UI}, {CR.DONE}, {CR.LOADED} SELECT id AS \"Run ID\", file AS \"PSD File\", status AS \"Status\", coalesce(strategy,'') AS \"Strategy\", panels AS \"Panels\", texts AS \"Texts\", time AS \"Time\" FROM loaded")
def _(t):
    path = shared_folder(t.spark, "runs")
    export = export_columns(CR.loaded(t))
    writers.write_runs_csv(export, path)
    return t.spark.read.schema(export.schema).option("header", True).csv(path).fillna("", ["Strategy", "Time"])


@query("panel_script_sink", f"WITH {CS.ROWS}, {CS.SPOKEN}, {CS.SCRIPT} SELECT panel_id, script_text AS markdown FROM script_")
def _(t):
    path = shared_folder(t.spark, "scripts")
    scripts = CS.S.generate_scripts(CS.dialogue(t), CS.PANEL).withColumn("script_markdown", F.lit(None).cast("string"))
    payloads = CS.S.script_payloads(scripts)
    writers.write_scripts(payloads, path)
    return t.spark.read.schema(payloads.schema).json(path).select("panel_id", "markdown")


@query("stream_ingest_new", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    events = streams.event_stream(t.spark, t.folder, "events.parquet").select("ts", "user_id", "event_type")
    return streams.drain(streams.first_seen(events, ["user_id", "event_type"], "60 days"), "first-seen").select("user_id", "event_type")


STATUS = "CASE WHEN event_type IN ('view','click') THEN 'running' WHEN event_type='error' THEN 'error' ELSE 'success' END"


@query("stream_run_status", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, {STATUS} AS status, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1,2")
def _(t):
    events = streams.event_stream(t.spark, t.folder, "events.parquet").select("ts", "event_type")
    windows = streams.status_windows(events, F.expr(STATUS))
    last = streams.drain_updates(windows, "run-status", ["window_start", "status"], "events")
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "status", "events")
