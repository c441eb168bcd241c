"""Reading images, meta records, manifests and panel texts from files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.registry import base_name

PIXELS = "origin string, y int, x int, b int, g int, r int"

META_SCHEMA = (
    "image string, is_psd boolean, split_mode string, bands_count int, regions_count int, panel_count int, text_count int, upload_latency_ms int, "
    "ocr_latency_ms int, ocr_mode string, ocr_lang string, merge_unmatched_psd_count int, merge_unmatched_ocr_count int, textbox_layer_count int, "
    "preprocess struct<ocr_status:string,art_clean_path:string>, _corrupt_record string"
)
PANEL = "struct<panel_id:string,region_id:int,band_index:int,score:double,bbox:array<int>,bbox_path:string,mask_path:string,txt_path:string>"


def scan_images(spark: SparkSession, path: str, rows_per_batch: int = 256) -> DataFrame:
    """Pixels of all images below ``path``; an unreadable image is an error."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    broken = F.col("height").isNull() | (F.col("height") <= 0)
    images = images.withColumn("height", F.when(broken, F.raise_error(F.concat(F.lit("unreadable image: "), "origin"))).otherwise(F.col("height")))

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for image in batch.itertuples():
                grid = np.frombuffer(image.data, dtype=np.uint8).reshape(image.height, image.width, image.nChannels)
                grid = np.repeat(grid, 3, axis=2) if image.nChannels == 1 else grid[:, :, :3]
                for top in range(0, image.height, rows_per_batch):
                    part = grid[top : top + rows_per_batch]
                    ys, xs = np.indices(part.shape[:2], dtype=np.int32)
                    yield pd.DataFrame({
                        "origin": image.origin, "y": ys.ravel() + top, "x": xs.ravel(), **{c: part[:, :, i].ravel().astype(np.int32) for i, c in enumerate("bgr")}
                    })

    return images.mapInPandas(unpack, PIXELS)


def _records(spark: SparkSession, folder: str, ending: str, schema: str) -> DataFrame:
    """JSON files named ``<prefix><ending>``; broken ones are left out."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", f"*{ending}").json(folder)
    named = raw.select("*", F.col("_metadata.file_path").alias("meta_path"), F.col("_metadata.file_modification_time").alias("mtime"))
    prefix = F.replace(F.regexp_replace(base_name(F.col("meta_path")), r"\.json$", ""), F.lit(ending.removesuffix(".json")), F.lit(""))
    return named.where("_corrupt_record IS NULL").drop("_corrupt_record").withColumn("prefix", prefix)


def scan_pipeline_metas(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder, "_pipeline_meta.json", META_SCHEMA)


def scan_panel_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per panel of every manifest."""
    records = _records(spark, folder, "_panels_manifest.json", f"panel_count int, panel_dir string, panels array<{PANEL}>, _corrupt_record string")
    return records.select("prefix", "meta_path", F.posexplode("panels").alias("ord", "panel")).select("prefix", "meta_path", "ord", "panel.*")


def scan_panel_texts(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """JSON lines of panel texts: blank lines and rows that are no objects are skipped, broken JSON is an error.

    ``keys`` are further fields of a line, read as strings, which say what panel it is of.
    """
    lines = spark.read.text(path, recursiveFileLookup=False).where(F.trim("value") != "")
    rows = lines.withColumn("_v", F.parse_json("value")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    partitions = [c for c in lines.columns if c != "value"]
    fields = {**dict.fromkeys(keys, "string"), "text_id": "string", "text": "string", "reading_no": "int", "assignment_score": "double"}
    return rows.select(*partitions, *(F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in fields.items()))
