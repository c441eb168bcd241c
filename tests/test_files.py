"""Scans over small files written by the tests."""

import json
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelweave.functions import ocr_json as O
from panelweave.operators import scripts
from panelweave.sources import readers


def test_tasks_need_no_copy_of_the_package(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from panelweave.session import local_session\nfrom panelweave.functions.ocr_json import json_nodes\n"
        "spark = local_session(1)\nprint('nodes', json_nodes(spark.createDataFrame([(1, '{\"a\":{}}')], 'id int, payload string'), ['id']).count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "nodes 2" in done.stdout


def _png(path, pixels):
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(c for p in row for c in p) for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_scan_gives_bgr_rows(spark, tmp_path):
    _png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)], [(1, 2, 3), (4, 5, 6)]])
    rows = {(r.y, r.x): (r.b, r.g, r.r) for r in readers.scan_images(spark, str(tmp_path), rows_per_batch=2).collect()}
    assert rows == {(0, 0): (0, 0, 255), (0, 1): (0, 255, 0), (1, 0): (255, 0, 0), (1, 1): (7, 8, 9), (2, 0): (3, 2, 1), (2, 1): (6, 5, 4)}


def test_unreadable_image_is_an_error(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="unreadable image"):
        readers.scan_images(spark, str(tmp_path)).collect()


def test_meta_scan_skips_broken_files(spark, tmp_path):
    (tmp_path / "p1_pipeline_meta.json").write_text(json.dumps({"image": "in/a.psd", "panel_count": 3}, indent=2))
    (tmp_path / "p2_pipeline_meta.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    got = [(r.prefix, r.image, r.panel_count) for r in readers.scan_pipeline_metas(spark, str(tmp_path)).collect()]
    assert got == [("p1", "in/a.psd", 3)]


def test_manifest_scan_gives_panels(spark, tmp_path):
    panels = [{"panel_id": "panel_001", "bbox": [0, 1, 2, 3], "score": 0.5}, {"panel_id": "panel_002", "bbox": [4, 5, 6, 7]}]
    (tmp_path / "p1_panels_manifest.json").write_text(json.dumps({"panel_count": 2, "panels": panels}))
    got = sorted((r.prefix, r.ord, r.panel_id, tuple(r.bbox)) for r in readers.scan_panel_manifests(spark, str(tmp_path)).collect())
    assert got == [("p1", 0, "panel_001", (0, 1, 2, 3)), ("p1", 1, "panel_002", (4, 5, 6, 7))]


def test_panel_text_scan(spark, tmp_path):
    good = tmp_path / "good.txt"
    good.write_text('{"text_id":"a","text":"hi"}\n\n   \n[1]\n"x"\n')
    assert [(r.text_id, r.text) for r in readers.scan_panel_texts(spark, str(good)).collect()] == [("a", "hi")]
    bad = tmp_path / "bad.txt"
    bad.write_text("{oops\n")
    with pytest.raises(Exception):
        readers.scan_panel_texts(spark, str(bad)).collect()


def test_general_boxes_prefer_the_main_list(spark):
    answer = {"meta": {"text": "hi", "bbox": [0, 0, 1, 1], "score": 0.1}, "items": [{"text": "b", "bbox": [1, 1, 2, 2]}, {"text": "hi", "bbox": [0, 0, 1, 1], "score": 0.9}, {"text": " "}]}
    df = spark.createDataFrame([(1, json.dumps(answer))], "id int, payload string")
    got = sorted((r.list_rank, r.node_no, r.text, r.confidence) for r in O.general_boxes(df, ["id"]).collect())
    assert [(g[2], g[3]) for g in got] == [("b", None), ("hi", 0.9)]


def test_places_are_read_at_any_depth(spark):
    deep = lambda n, place: {"points": deep(n - 1, place)} if n else place
    corners = {"LeftTop": {"X": 1, "Y": 2}, "rightTop": {"x": 3, "y": 2}, "RightBottom": {"X": 3, "y": 4.5}, "left_bottom": {"X": 1, "Y": 4}}
    square = [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]
    places = {
        "corners": (corners, [[1.0, 2.0], [3.0, 2.0], [3.0, 4.5], [1.0, 4.0]]), "edges": ({"left": 1, "y0": 2, "x1": 3, "bottom": 4}, square), "size": ({"x": 1, "y": 2, "w": 2, "height": 2}, square),
        "eight": ([1, 2, 3, 2, 3, 4, 1, 4], square), "four": ([1, 2, 3, 4], square), "points": ([["1", 2, 9], [3, "2"], [3, 4], [1, 4]], square),
        "mixed": ([1, "2", 3, 4], None), "three": ([[1, 2], [3, 2], [3, 4]], None), "words": ([["a", 2], [3, 2], [3, 4], [1, 4]], None), "none": ({}, None), "huge": ([10**400, 2, 3, 4], None),
    }
    rows = [(f"{name}{n}", json.dumps({"text": "t", "Quad": deep(n, place)})) for name, (place, _) in places.items() for n in (0, 1, 4, 60)]
    rows += [("null", json.dumps({"text": "t", "bbox": None, "x0": 1, "top": 2, "right": 3, "y1": 4})), ("late", json.dumps({"text": "t", "Rect": [1, 2, 3, 4], "bbox": "no"}))]
    got = {r.id: r.quad for r in O.general_boxes(spark.createDataFrame(rows, "id string, payload string"), ["id"]).collect()}
    want = {f"{name}{n}": points for name, (_, points) in places.items() for n in (0, 1, 4, 60) if points}
    # Corners nested in a place are objects of the tree too, but hold no text.
    assert got == {**want, "null": square}


def test_trees_of_odd_shape(spark):
    rows = [
        (1, '{"a": [[{"b": 1}], {"c": [{"d": null, "e": true}]}], "f": {}}'), (2, "[1, {}]"), (3, "7"), (4, '{"a": {"a": {"a": {"text": "deep", "rect": [0, 0, 1, 1]}}}}'),
        (5, "[" * 200_000), (None, '{"text": "x"}'), (6, '{"texts": [], "boxes": {"box": [{"text": "in", "x0": 0, "y0": 0, "x1": 1, "y1": 1}]}}'),
    ]
    df = spark.createDataFrame(rows, "id int, payload string").withColumns({c: F.lit("x") for c in ("no", "key", "text", "_named", "owner")})
    got = sorted(tuple(r) for r in O.json_nodes(df, ["id"]).where("id IS NOT NULL").select("id", "no", "parent", "key", "is_item", F.to_json("scalars")).collect())
    assert got[:5] == [(1, 0, -1, "", False, "{}"), (1, 1, 0, "a", True, '{"b":"1"}'), (1, 2, 0, "a", True, "{}"), (1, 3, 2, "c", True, '{"e":"true"}'), (1, 4, 0, "f", False, "{}")]
    assert [g[0] for g in got[5:]] == [2, 4, 4, 4, 4, 6, 6, 6]
    boxes = {(r.id, r.text): r.list_rank for r in O.general_boxes(df, ["id"]).collect()}
    assert boxes == {(4, "deep"): 1, (6, "in"): 1}, "an empty main list ends the search for one"
    assert O.general_boxes(df.limit(0), ["id"]).count() == 0 == O.license_fields(df.limit(0), ["id"]).count()


def test_lines_of_other_languages_are_left_out(spark):
    line = lambda text, **more: {"text": text, "rect": [0, 0, 1, 1], **more}
    answer = {"ocr_infos": [line("a", lang="ZH "), line("b", lang="ko"), line("c"), line("d", lang="en"), line("e", lang="not_lang"), 7], "other": line("f", lang="ko")}
    df = spark.createDataFrame([(1, json.dumps(answer))], "id int, payload string")
    assert {r.text for r in O.general_boxes(df, ["id"], lang="zh").collect()} == set("acdef")
    assert {r.text for r in O.general_boxes(df, ["id"]).collect()} == set("abcdef")


def test_license_fields_prefer_known_containers(spark):
    answer = {"x": {"text": "no"}, "Fields": {"name": {"Value": {"text": "Ann"}}, "no": " 7 ", "empty": ""}, "Data": [{"Name": "n", "text": "later"}]}
    listed = {"Data": [{"Name": "n", "text": "v"}, {"Name": "n", "text": "w"}, {"text": "nameless"}]}
    df = spark.createDataFrame([(1, json.dumps(answer)), (2, json.dumps(listed))], "id int, payload string")
    got = sorted((r.id, r.field, r.text) for r in O.license_fields(df, ["id"]).collect())
    assert got == [(1, "name", "Ann"), (1, "no", "7"), (2, "n", "w")]


def test_envelopes(spark):
    inner = json.dumps(json.dumps({"texts": []}))
    rows = [(1, '{"Result":{"Output":' + json.dumps(inner) + "}}"), (2, '{"data":{"detail":"not json"}}'), (3, '{"code":"7"}'), (4, '{"result":3}'), (5, "junk")]
    got = {r.id: (r.status, r.payload) for r in O.open_envelopes(spark.createDataFrame(rows, "id int, resp string")).collect()}
    assert got[2] == ("ok", '{"detail":"not json"}')
    assert [got[i][0] for i in (3, 4, 5)] == ["business_error", "invalid", "invalid"]


def test_model_callables_fall_back_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "panel_id int, reading_no int, text string")

    def broken(prompt):
        raise OSError("down")

    def plain(prompt):
        if "1. b" in prompt:
            raise OSError("down too")
        return " fine "

    got = {r.panel_id: r for r in scripts.generate_scripts(rows, ["panel_id"], modes={"multimodal": broken, "text_only": plain}).collect()}
    assert (got[1].script_text, got[1].backend) == ("fine", "text_only")
    assert got[2].backend == "local_fallback" and "multimodal#1: OSError: down; text_only#1" in got[2].reason
    assert "《未知角色1》：b" in got[2].script_text


def test_embedding_callable_runs_per_batch(spark):
    df = spark.range(5)
    got = scripts.embed_batch(df, lambda batch: [[float(i)] for i in batch["id"]]).collect()
    assert sorted(r.embedding[0] for r in got) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_a_second_embedding_run_computes_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(len(batch))
        return [[3.0, 4.0]] * len(batch)

    store = str(tmp_path / "store")
    first = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "content_key string")
    got = {r.content_key: (r.embedding, r.backend) for r in scripts.embed_through_store(first, store, {"m": model}).collect()}
    assert got == {"a": ([0.6, 0.8], "m"), "b": ([0.6, 0.8], "m")} and calls.value == 2
    more = first.unionByName(spark.createDataFrame([("c",)], "content_key string"))
    again = scripts.embed_through_store(more, store, {"m": model})
    assert {r.content_key: r.backend for r in again.collect()} == {"a": "cache", "b": "cache", "c": "m"} and calls.value == 3
    scripts.embed_through_store(more, store, {"m": model})
    assert calls.value == 3
    assert {r.content_key: r.backend for r in again.collect()}["c"] == "m"
    assert scripts.embed_through_store(first.limit(0), store, {"m": model}).collect() == []


def test_embedding_falls_back_or_stops(spark, tmp_path):
    tries = spark.sparkContext.accumulator(0)

    def broken(batch):
        tries.add(1)
        raise OSError("down")

    def short(batch):
        return [[1.0]] * (len(batch) - 1)

    def odd(batch):
        if (batch["content_key"] == "b").any():
            raise OSError("not this one")
        return [[float(len(k)), 0.0] for k in batch["content_key"]]

    rows = spark.createDataFrame([("a",), ("b",)], "content_key string").coalesce(1)
    local = lambda left: left.select("content_key", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
    models = {"broken": broken, "short": short, "odd": odd}
    got = scripts.embed_through_store(rows, str(tmp_path / "one"), models, local, retries=2, wait=0.0, batch_rows=1).collect()
    assert {r.content_key: (r.embedding, r.backend) for r in got} == {"a": ([1.0, 0.0], "odd"), "b": ([0.0, 1.0], "local")}
    assert tries.value == 4
    with pytest.raises(Exception, match="no vector from any model"):
        scripts.embed_through_store(rows, str(tmp_path / "two"), {"broken": broken}, retries=1, wait=0.0)
    with pytest.raises(ValueError, match="no model"):
        scripts.embed_through_store(rows, str(tmp_path / "three"))
    assert scripts.stored_vectors(spark, str(tmp_path / "two")).count() == 0
