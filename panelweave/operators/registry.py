"""Runs, assets and what users attach to them, as keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the note on runs that a restart has cut off.
INTERRUPTED = "任务在服务重启前处于运行中，已标记为中断"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def display_time(moment: Column, short: bool = False) -> Column:
    return F.date_format(moment, "MM/dd HH:mm" if short else "yyyy/MM/dd HH:mm")


def normalize_runs(runs: DataFrame, has_meta: Column) -> DataFrame:
    """A run still marked running at load has either finished (it left a meta record) or been cut off."""
    running = F.col("status") == "running"
    known = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).otherwise(F.lit(INTERRUPTED))
    return runs.withColumns({
        "status": F.when(running, F.when(has_meta, F.lit("success")).otherwise(F.lit("error"))).otherwise(F.col("status")),
        "error": F.when(running, F.when(has_meta, F.lit("")).otherwise(known)).otherwise(F.col("error")),
    })


def runs_from_metas(metas: DataFrame, ui: DataFrame) -> DataFrame:
    """Runs of the pipeline's meta records; saved user state overrides status, time and error."""
    saved = ui.select(F.col("id").alias("prefix"), F.col("status").alias("_status"), F.col("time").alias("_time"), F.col("error").alias("_error"))
    image = F.coalesce("image", F.lit(""))
    runs = metas.join(saved, "prefix", "left").select(
        F.col("prefix").alias("id"), F.when(image != "", base_name(image)).otherwise(F.concat("prefix", F.lit(".psd"))).alias("file"),
        F.coalesce("_status", F.lit("success")).alias("status"), F.when(F.col("split_mode") == "stage2", "advanced").otherwise("normal").alias("strategy"),
        F.col("panel_count").alias("panels"), F.col("text_count").alias("texts"), F.coalesce("_time", F.lit("")).alias("time"),
        F.coalesce("_error", F.lit("")).alias("error"), image.alias("image_path"),
    )
    return normalize_runs(runs, F.lit(True))


def load_registry(metas: DataFrame, ui: DataFrame) -> DataFrame:
    """All runs: those with meta records, and those known from user state alone."""
    done = runs_from_metas(metas, ui)
    alone = normalize_runs(ui.join(done.select("id"), "id", "left_anti"), F.lit(False))
    return done.unionByName(alone, allowMissingColumns=True)


def filter_runs(runs: DataFrame, status: str | None = None, q: str | None = None) -> DataFrame:
    out = runs if not status or status == "all" else runs.where(F.col("status") == status)
    if q:
        needle = F.lit(q.lower())
        out = out.where(F.contains(F.lower("id"), needle) | F.contains(F.lower("file"), needle))
    return out


def status_rank() -> Column:
    return F.when(F.col("status") == "running", 0).when(F.col("status") == "error", 1).when(F.col("status") == "success", 2).otherwise(3)


def order_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status_rank", status_rank()).orderBy("status_rank", "id")


def status_counts(runs: DataFrame) -> DataFrame:
    states = ("success", "running", "error")
    return runs.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("status") == s).alias(s) for s in states))


def list_asset_files(uploads: DataFrame, metas: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads (``.psd`` before ``.psb``, by path), then known images that exist; one row per name, first wins."""
    ranked = uploads.select("name", "path", F.lit("upload").alias("source"), F.when(F.col("path").endswith(".psd"), 0).otherwise(1).alias("_p"), F.col("path").alias("_o"))
    known = metas.where("image <> ''").join(existing.select(F.col("path").alias("image")), "image", "left_semi")
    images = known.select(base_name(F.col("image")).alias("name"), F.col("image").alias("path"), F.lit("existing").alias("source"), F.lit(2).alias("_p"), F.col("prefix").alias("_o"))
    first = ranked.unionByName(images).groupBy("name").agg(F.min(F.struct("_p", "_o", "path", "source")).alias("f"))
    return first.select("name", "f.path", "f.source")


def asset_rollup(metas: DataFrame) -> DataFrame:
    """Per image file: most panels, coverage and time of the last run, last note, first run for the preview.

    Runs count in the order of their meta files.  Runs themselves stay rows, see ``asset_runs``.
    """
    order = F.concat("prefix", F.lit("_pipeline_meta.json"))
    covered = F.when(F.col("text_count") > 0, F.floor(100 * F.col("assigned_count") / F.col("text_count")).cast("int"))
    placed = metas.where("image <> ''").withColumns({"file": base_name(F.col("image")), "_order": order, "_cover": covered})
    with_texts, noted = F.when(F.col("text_count") > 0, F.col("_order")), F.when(F.coalesce("note", F.lit("")) != "", F.col("_order"))
    return placed.groupBy("file").agg(
        F.max("panel_count").alias("panels"), F.coalesce(F.max_by("_cover", with_texts), F.lit(0)).alias("coverage"),
        F.max_by(display_time(F.col("mtime")), "_order").alias("updated"), F.coalesce(F.max_by("note", noted), F.lit("")).alias("notes"),
        F.min_by("image", "_order").alias("image_path"), F.min_by("prefix", "_order").alias("preview_run"), F.count(F.lit(1)).alias("run_count"),
    )


def asset_runs(metas: DataFrame) -> DataFrame:
    return metas.where("image <> ''").select(
        base_name(F.col("image")).alias("file"), F.col("prefix").alias("id"),
        F.when(F.col("split_mode") == "stage2", "advanced").otherwise("normal").alias("strategy"), F.col("panel_count").alias("panels"), F.col("text_count").alias("texts"),
    )


def latest_runs(metas: DataFrame) -> DataFrame:
    """Newest run of each file; of equal times the one whose meta file sorts first."""
    placed = metas.where("image <> '' AND prefix <> ''").withColumn("file", base_name(F.col("image")))
    best = F.min_by("prefix", F.struct((-F.unix_micros(F.col("mtime").cast("timestamp"))).alias("t"), F.concat("prefix", F.lit("_pipeline_meta.json")).alias("p")))
    return placed.groupBy("file").agg(best.alias("id"))


def run_results(runs: DataFrame, metas: DataFrame, panels: DataFrame, items: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each run with what its files hold; missing parts are empty."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    out = runs.join(metas.select(F.col("prefix").alias("id"), F.col("clean_image")), "id", "left")
    for df, name in ((panels, "panel_rows"), (items, "text_rows"), (bindings, "binding_rows")):
        out = out.join(counted(df, name), "id", "left")
    return out.fillna(0, ["panel_rows", "text_rows", "binding_rows"])


def strip_binding(items: DataFrame) -> DataFrame:
    """Keep the detected panel as a hint, but expose no active binding."""
    return items.withColumn("detected_panel_id", F.col("primary_panel_id")).withColumn("primary_panel_id", F.lit(None).cast(items.schema["primary_panel_id"].dataType))


def normalize_script_binding(scripts: DataFrame) -> DataFrame:
    """Binding of a script file: stored, under its legacy key, or made from the selection; script: nested or whole."""
    chosen = F.coalesce("selected_text_ids", F.lit("")) != ""
    made = F.when(chosen, F.concat(F.lit("made:"), "panel_id", F.lit(":"), "selected_text_ids"))
    return scripts.withColumns({"binding": F.coalesce("binding", "legacy_binding", made), "script": F.coalesce("nested_script", "whole_script")})


def asset_detail(panels: DataFrame, items: DataFrame, scripts: DataFrame, ui_bindings: DataFrame, notes: DataFrame) -> DataFrame:
    """Panel cards: text count, script, binding (the script file's before the user state's) and note.

    The texts themselves, unassigned ones included, are the rows of ``texts_by_panel``.
    """
    texts = items.groupBy(F.col("primary_panel_id").alias("panel_id")).agg(F.count(F.lit(1)).alias("text_count"))
    out = panels.join(texts, "panel_id", "left").join(scripts.select("panel_id", "script", "binding"), "panel_id", "left")
    out = out.join(ui_bindings.select("panel_id", F.col("binding").alias("_ui")), "panel_id", "left").join(notes.select("panel_id", "note"), "panel_id", "left")
    return out.withColumns({
        "text_count": F.coalesce("text_count", F.lit(0)),
        "script_binding": F.coalesce("binding", "_ui"), "note": F.coalesce("note", F.lit("")),
    }).drop("binding", "_ui")


def resolve_panels(wanted: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """First manifest row of each wanted panel, where both its files exist."""
    first = manifest.groupBy("panel_id").agg(F.min(F.struct("ord", "image_path", "txt_path")).alias("f")).select("panel_id", "f.image_path", "f.txt_path")
    found = wanted.join(first, "panel_id")
    for column in ("image_path", "txt_path"):
        found = found.join(listing.select(F.col("path").alias(column)), column, "left_semi")
    return found


def split_by_cache(files: DataFrame, cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Mark files whose signature and settings equal a cached entry that still has its outputs (``hit``)."""
    signature = ["path", "size", "mtime", "inpaint", "ocr_mode", "ocr_lang"]
    alive = cache
    for column in ("image_out", "texts_out"):
        alive = alive.join(listing.select(F.col("path").alias(column)), column, "left_semi")
    marks = alive.select(*signature).distinct().withColumn("_hit", F.lit(True))
    return files.join(marks, signature, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def fill_cache(wanted: DataFrame, cache: DataFrame, compute, key: str = "content_key") -> DataFrame:
    """Cached rows for the wanted keys, and ``compute(missing)`` for the others, once per key."""
    missing = wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    hits = cache.join(wanted.select(key), key, "left_semi")
    return hits.unionByName(compute(missing))


def preview_sources(previews: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploaded source with the preview's stem; ``.psd`` before ``.psb``."""
    rank = F.when(F.col("path").endswith(".psd"), 0).when(F.col("path").endswith(".psb"), 1)
    sources = uploads.where(rank.isNotNull()).groupBy(stem(F.col("path")).alias("_stem")).agg(F.min_by("path", rank).alias("source_path"))
    return previews.withColumn("_stem", stem(F.col("preview_path"))).join(sources, "_stem", "left").drop("_stem")


def upsert_notes(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set notes; of several updates of one key the last (``seq``) wins."""
    last = updates.groupBy(*keys).agg(F.max_by("note", "seq").alias("_new"), F.lit(True).alias("_set"))
    merged = base.join(last, [*keys], "full_outer")
    return merged.withColumn("note", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("note"))).drop("_new", "_set")


def upsert_bindings(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set or clear bindings in ``seq`` order.  A set keeps the script's meta unless a clear came before."""
    last = updates.groupBy(*keys).agg(F.max_by(F.struct("clear", "text_ids"), "seq").alias("_u"), F.bool_or("clear").alias("_cleared"))
    merged = base.join(last, [*keys], "full_outer").where(~F.coalesce(F.col("_u.clear"), F.lit(False)))
    touched = F.col("_u").isNotNull()
    return merged.withColumns({
        "text_ids": F.when(touched, F.col("_u.text_ids")).otherwise(F.col("text_ids")),
        "script_meta": F.when(F.coalesce("_cleared", F.lit(False)), F.lit("")).otherwise(F.coalesce("script_meta", F.lit(""))),
    }).drop("_u", "_cleared")


def allot_run_ids(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Id and outcome for requested base ids (``base``, ``seq``).

    A base held by a running run is rejected.  While a successful run holds the
    id, ``_1``, ``_2`` ... are tried.  The first request of a base gets the id;
    later ones find it running: they are rejected, or take over a suffixed id.
    """
    done = runs.where("status = 'success'").select("id").distinct()
    plain = done.select(F.col("id").alias("base"), F.lit(0).cast("long").alias("n"))
    parts = F.regexp_extract("id", r"^(.*)_([1-9]\d*)$", 1), F.regexp_extract("id", r"^(.*)_([1-9]\d{0,17})$", 2)
    numbered = done.where(parts[1] != "").select(parts[0].alias("base"), parts[1].cast("long").alias("n"))
    taken = plain.unionByName(numbered)
    open_after = taken.join(taken.select("base", (F.col("n") - 1).alias("n")), ["base", "n"], "left_anti").groupBy("base").agg((F.min("n") + 1).alias("free"))
    rooted = open_after.join(plain.select("base"), "base", "left_semi")
    running = runs.where("status = 'running'").select(F.col("id").alias("base")).distinct().withColumn("_running", F.lit(True))
    first = requests.groupBy("base").agg(F.min("seq").alias("_first"))
    joined = requests.join(first, "base").join(rooted, "base", "left").join(running, "base", "left")
    n, is_first = F.coalesce("free", F.lit(0)), F.col("seq") == F.col("_first")
    outcome = F.when(F.coalesce("_running", F.lit(False)), "reject").when(is_first, "accept").when(n == 0, "reject").otherwise("overwrite")
    run_id = F.when(n > 0, F.concat_ws("_", "base", n)).otherwise(F.col("base"))
    return joined.select("base", "seq", F.when(outcome != "reject", run_id).alias("id"), outcome.alias("outcome"))


def export_columns(runs: DataFrame) -> DataFrame:
    names = {"id": "Run ID", "file": "PSD File", "status": "Status", "strategy": "Strategy", "panels": "Panels", "texts": "Texts", "time": "Time"}
    return runs.select(*(F.col(old).alias(new) for old, new in names.items()))


def threshold(raw: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A setting's number; the default if it is no number or out of range."""
    value = F.trim(raw).try_cast("double")
    return F.when(value.between(low, high), value).otherwise(F.lit(float(default)))


def mask_secret(secret: Column) -> Column:
    value = F.trim(F.coalesce(secret, F.lit("")))
    size = F.length(value)
    stars = F.expr("repeat('*', 1)")
    long = F.concat(F.substring(value, 1, 4), F.lpad(stars, F.greatest(F.lit(4), size - 8), "*"), F.right(value, F.lit(4)))
    return F.when(size <= 8, F.lpad(F.lit(""), size, "*")).otherwise(long)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\", "__")


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != "")
