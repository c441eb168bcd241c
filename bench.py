"""Wall time of headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelweave.plans import catalog
from panelweave.plans.registry import PLANS, Tables
from panelweave.session import local_session

HEADLINE = [
    "text_panel_top3", "text_panel_nearest", "unified_text_map", "reading_order", "moving_average", "detect_gutters", "merge_candidates",
    "band_nearest_cuts", "band_feature_means", "line_density", "detect_hard_lines", "select_primary", "nms_dedup", "connected_boxes",
    "gradient_map", "boundary_costs", "patch_embedding", "grow_regions", "layer_eligibility", "layer_paths", "run_registry_load",
    "asset_rollup", "asset_detail", "ocr_general_boxes", "prompt_build", "text_similarity", "stream_run_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "panelweave-bench")
    catalog.load()
    PLANS["bbox_area"](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        try:
            PLANS[key](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
        except Exception as exc:
            times[key] = None
            print(f"{key}: {type(exc).__name__}: {str(exc)[:200]}", file=__import__("sys").stderr)
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
