"""Writing bands, panel texts, exports and scripts.

Ordered files are laid out by range, so that one large panel becomes several
files in order instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bands(bands: DataFrame, path: str) -> None:
    bands.write.mode("overwrite").json(path)


def write_panel_texts(ordered: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON lines of all panels, one after the other, each in reading order; a line names its panel.

    Files follow the texts, not the panels: a folder per panel would be more files than a driver can list.  A panel
    without texts has no line; the manifest lists it.
    """
    columns = ["text_id", "text", "reading_no", "assignment_score"]
    panel = [*keys, "primary_panel_id"]
    laid = ordered.select(*panel, *columns).repartitionByRange(*panel, "reading_no").sortWithinPartitions(*panel, "reading_no")
    lines = laid.select(F.to_json(F.struct(*keys, F.col("primary_panel_id").alias("panel_id"), *columns)).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_runs_csv(export: DataFrame, path: str) -> None:
    """Header and seven columns, UTF-8 without a byte order mark."""
    export.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_scripts(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("overwrite").json(path)
