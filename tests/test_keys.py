"""Ids that are unique within a page only, ids of any type, null keys, bad answers and deep trees lose no rows."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions import errors, geometry
from panelweave.functions.ocr_json import find_uris, general_boxes, json_nodes
from panelweave.operators import rounds, spread, texts
from panelweave.operators.layers import layer_paths
from panelweave.operators.regions import dedup_regions, select_primary
from panelweave.operators.spread import row_numbers, running_max, with_halo
from panelweave.operators.texts import box_groups, merge_sources

BOX = "x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize("kind", ["int", "string"])
def test_regions_of_two_pages_with_the_same_ids(spark, kind):
    rows = [(1, 0, 0, 0, 100, 100, 0.9, 0.5), (1, 1, 10, 10, 60, 60, 0.5, 0.2), (2, 0, 0, 0, 100, 100, 0.9, 0.5), (2, 1, 200, 200, 300, 300, 0.5, 0.2)]
    df = spark.createDataFrame(rows, f"page_id int, region_id int, {BOX}, score double, area_ratio double").withColumn("region_id", F.col("region_id").cast(kind))
    for pick in (select_primary, dedup_regions):
        got = pick(df, ["page_id"])
        assert got.columns == df.columns
        assert sorted((r.page_id, int(r.region_id)) for r in got.collect()) == [(1, 0), (2, 0), (2, 1)]


def test_texts_of_two_pages_with_the_same_ids(spark):
    layer = [(p, f"psd_{k}", "hello there", 10 * k, 100 * k, 10 * k + 50, 100 * k + 20) for p in (1, 2) for k in (1, 2)]
    ocr = [(1, "a", "hello there", 11, 101, 61, 121, 0.5), (2, "a", "hello there", 21, 201, 71, 221, 0.5), (2, "b", "else", 400, 400, 420, 420, 0.5)]
    merged = merge_sources(
        spark.createDataFrame(layer, f"page_id int, text_id string, text string, {BOX}"), spark.createDataFrame(ocr, f"page_id int, text_id string, text string, {BOX}, conf double"), ["page_id"]
    )
    got = sorted((r.page_id, r.merge_status, r.y1) for r in merged.collect())
    assert got == [(1, "matched", 101), (1, "unmatched_psd", 200), (2, "matched", 201), (2, "unmatched_ocr", 400), (2, "unmatched_psd", 100)]


def test_groups_of_two_pages_with_the_same_ids(spark):
    rows = [(1, "a", 0, 0, 10, 10), (1, "b", 11, 0, 20, 10), (2, "a", 0, 0, 10, 10), (2, "b", 500, 500, 510, 510)]
    got = {(r.page_id, r.text_id): r.component for r in box_groups(spark.createDataFrame(rows, f"page_id int, text_id string, {BOX}"), ["page_id"]).join(spark.createDataFrame(rows, f"page_id int, text_id string, {BOX}").select("page_id", "text_id", "x1"), ["page_id", "text_id", "x1"]).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (2, "a"): "a", (2, "b"): "b"}


def test_null_keys_and_positions_stay(spark):
    rows = [(None, 1), (None, None), (1, None), (1, 3), (1, 9000), (None, 9000)]
    df = spark.createDataFrame(rows, "g int, y int")
    got = row_numbers(df, ["g"], [F.col("y")])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, None, 1), (None, 1, 2), (None, 9000, 3), (1, None, 1), (1, 3, 2), (1, 9000, 3)], key=str)
    peaks = running_max(df, ["g"], [F.col("y")], F.col("y"), F.col("y"), "top", size=10)
    assert peaks.count() == len(rows) and peaks.where("top < y").isEmpty()


def test_frames_longer_than_a_bucket(spark):
    df = spark.range(50).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("y"))
    copies = with_halo(df, ["g"], "y", 25, 12, size=10).groupBy("_bucket").agg(F.collect_set("y").alias("held"), F.collect_set(F.when(F.col("_own"), F.col("y"))).alias("own"))
    for r in copies.collect():
        for y in r.own:
            assert {k for k in range(max(0, y - 25), min(50, y + 13))} <= set(r.held)


def test_answers_that_are_no_json(spark):
    df = spark.createDataFrame([(1, "<html>busy</html>"), (2, '{"a":{"myUri":"u"}}'), (3, None), (4, "")], "id int, resp string")
    assert {r.id: r.uri for r in find_uris(df, ["id"]).collect()} == {1: None, 2: "u", 3: None, 4: None}
    assert {r.id for r in json_nodes(df, ["id"], "resp").collect()} == {2}


def test_a_mixed_list_is_not_the_main_list(spark):
    place = '"bbox":[0,0,9,9]'
    answer = f'{{"x":{{"text":"t","confidence":0.9,{place}}},"boxes":[1,{{"text":"t","confidence":0.1,{place}}}]}}'
    got = general_boxes(spark.createDataFrame([(1, answer)], "id int, payload string"), ["id"]).collect()
    assert [r.confidence for r in got] == [0.9]


def test_a_deep_tree_and_a_circle(spark):
    tree = spark.range(2000).select(F.lit(1).alias("p"), F.col("id").cast("string").alias("layer_id"), F.col("id").alias("pos"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("above"), F.lit("n").alias("name"))
    deepest = layer_paths(tree, ["p"]).where("layer_id = '1999'").first()
    assert deepest.path.count("/") == 1999
    with pytest.raises(ValueError):
        layer_paths(spark.createDataFrame([(1, "a", 0, "b", "n"), (1, "b", 1, "a", "n")], "p int, layer_id string, pos long, above string, name string"), ["p"])


def test_requests_and_images_at_the_edge(spark):
    rows = [("ConnectionResetError", None, "x"), ("JSONDecodeError", None, "timeout"), ("ValueError", 503, "x"), ("Other", 503, "x")]
    df = spark.createDataFrame(rows, "t string, s int, m string")
    assert [r.r for r in df.select(errors.retryable(F.col("t"), F.col("s"), F.col("m")).alias("r")).collect()] == [True, False, False, True]
    urls = spark.createDataFrame([("http://a",), ("ftp://a",), ("",), (None,)], "u string")
    assert [r.v for r in urls.select(errors.validate(F.col("u"), "url").alias("v")).collect()] == ["ok", "bad url", "bad url", "bad url"]
    sizes = spark.createDataFrame([(0, 500), (4000, 2000)], "w int, h int").select(*[c.alias(n) for c, n in zip(geometry.fit_within(F.col("w"), F.col("h"), 2000, 2000), "swh")])
    assert [tuple(r) for r in sizes.collect()] == [(1.0, 0, 500), (0.5, 2000, 1000)]


def test_texts_are_not_stored_while_they_are_merged(spark, monkeypatch):
    stored = []
    for module in (texts, rounds, spread):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain: stored.append(df.columns) or plain(df))
    kinds = f"page int, text_id string, text string, {BOX}"
    layer = [(1, "a", "one", 0, 0, 50, 20), (1, "a", "other", 0, 100, 50, 120), (1, "b", "two", 0, 200, 50, 220), (1, "b", "two", 0, 200, 50, 220), (None, "c", "lost", 0, 0, 50, 20)]
    ocr = [(1, "x", "two", 1, 201, 51, 221, 0.5), (1, "x", "two", 1, 201, 51, 221, 0.5), (1, "y", "far", 500, 500, 550, 520, 0.25), (None, "z", "none", 0, 0, 50, 20, 0.5)]
    merged = merge_sources(spark.createDataFrame(layer, kinds), spark.createDataFrame(ocr, f"{kinds}, conf double"), ["page"])
    assert stored and all({"text", "l_text", "o_text", "quad", "l_quad", "o_quad"}.isdisjoint(x) for x in stored)
    got = sorted((r.page or 0, r.text_id, r.text, r.x1, r.y1, r.conf, r.merge_status, r.merge_group_id) for r in merged.collect())
    assert got == [
        (0, "text_001", "none", 0, 0, 0.5, "unmatched_ocr", None), (0, "text_002", "lost", 0, 0, 1.0, "unmatched_psd", None), (1, "text_001", "one", 0, 0, 1.0, "unmatched_psd", None),
        (1, "text_002", "other", 0, 100, 1.0, "unmatched_psd", None), *((1, f"text_{n:03d}", "two", 1, 201, 1.0, "matched", "m_001") for n in (3, 4, 5, 6)), (1, "text_007", "far", 500, 500, 0.25, "unmatched_ocr", None),
    ]
