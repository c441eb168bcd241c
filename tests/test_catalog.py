"""A spread of registered queries against DuckDB; ``tools/check.py`` runs all of them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare

import __spark_entry__ as entry
from panelweave.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
KEYS = [
    "bbox_iou", "bbox_from_quad", "text_panel_top3", "text_panel_nearest", "reading_order", "texts_by_panel", "connected_boxes", "moving_average", "detect_gutters",
    "merge_candidates", "merge_small_bands", "band_nearest_cuts", "build_bands", "select_primary", "nms_dedup", "number_panels", "boundary_costs", "patch_embedding",
    "layer_eligibility", "layer_paths", "run_registry_load", "asset_rollup", "asset_detail", "upsert_bindings", "run_id_dedup", "ocr_envelope", "prompt_build", "stream_run_status",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_check(spark, duck, key):
    df = entry.queries()[key](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert compare(rows, df.columns, cursor.fetchall(), names) == ""
    assert rows


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["page_id", "text_id", "panel_id", "score", "overlap_ratio", "center_distance_norm", "rank"]


@pytest.mark.parametrize("left_out", [("panelweave/llm",), ("panelweave/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_optional_part(tmp_path, left_out):
    top = Path(__file__).resolve().parents[1]
    for part in ("panelweave", "__spark_entry__.py", "corpus_pipeline.py"):
        if (top / part).is_dir():
            shutil.copytree(top / part, tmp_path / part, ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{Path(d).relative_to(top)}/{n}" in left_out])
        elif (top / part).exists() and part not in left_out:
            shutil.copy(top / part, tmp_path / part)
    told = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    done = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    count, pipeline, first = done.stdout.split()
    assert int(count) > 150 and pipeline == "False"
    assert first == str("panelweave/llm" not in left_out and (top / "panelweave/llm").exists())
