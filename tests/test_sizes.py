"""Plans and files whose cost must follow the rows."""

import difflib
import os
import random

from pyspark.sql import functions as F

from panelweave.functions import text
from panelweave.functions.geometry import Box
from panelweave.functions.text import _ratio, edit_distance, edit_similarity
from panelweave.operators import patches, rows, texts
from panelweave.operators.spatial import nearest_by_center, touching_pairs
from panelweave.plans import catalog
from panelweave.plans.registry import PLANS, Tables
from panelweave.session import tasks_for
from panelweave.sources import readers, writers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _boxes(spark, n: int, prefix: str = ""):
    at = {c: (F.col("id") * 7 + d).cast("int").alias(prefix + c) for c, d in (("x1", 0), ("y1", 3), ("x2", 300), ("y2", 300))}
    return spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias(f"{prefix}id"), *at.values())


def test_cells_are_not_broadcast(spark):
    left, right = _boxes(spark, 20), _boxes(spark, 20, "o_")
    pairs = touching_pairs(left, right, ["page"], Box.named(), Box.named("o_"))
    assert pairs.count() == 400 and "Broadcast" not in _plan(pairs)
    square = (F.col("_px") - F.col("_tx")) * (F.col("_px") - F.col("_tx"))
    near = nearest_by_center(left, right, ["page"], Box.named().center, Box.named("o_").center, ["id"], [square, F.col("o_id")], ["o_id"])
    assert all(r.id == r.o_id for r in near.collect()) and near.count() == 20
    assert "_cx" not in "".join(line for line in _plan(near).splitlines() if "BroadcastHashJoin" in line)


def test_panel_boxes_are_not_broadcast(spark):
    boxes = _boxes(spark, 5)
    panels = boxes.withColumnRenamed("id", "panel_id").withColumn("ord", F.lit(0))
    told = boxes.select("page", F.col("id").alias("text_id"), F.lit("t").alias("text"), "x1", "y1", "x2", "y2")
    mapping = told.select("page", "text_id", F.col("text_id").alias("primary_panel_id"), F.lit(1.0).alias("assignment_score"), F.lit(0).alias("ord"))
    unified = texts.unify(told, mapping, panels, ["page"])
    assert unified.where("status = 'assigned'").count() == 5
    assert "primary_panel_id" not in "".join(line for line in _plan(unified).splitlines() if "BroadcastHashJoin" in line)


def test_panel_text_files_follow_the_texts(spark, tmp_path):
    rows = spark.range(600).select(
        (F.col("id") % 3).cast("string").alias("page"), F.floor(F.col("id") / 2).alias("primary_panel_id"), F.col("id").alias("text_id"),
        F.concat(F.lit("line\n"), "id").alias("text"), (F.col("id") % 2 + 1).cast("int").alias("reading_no"), F.lit(0.5).alias("assignment_score"),
    )
    path = str(tmp_path / "texts")
    writers.write_panel_texts(rows, path, ["page"])
    assert sum(name.endswith(".txt") for _, _, names in os.walk(path) for name in names) <= 200
    back = readers.scan_panel_texts(spark, path, ["page", "panel_id"])
    got = sorted((r.page, int(r.panel_id), r.text_id, r.text, r.reading_no, r.assignment_score) for r in back.collect())
    assert got == sorted((str(i % 3), i // 2, str(i), f"line\n{i}", i % 2 + 1, 0.5) for i in range(600))


def test_long_pairs_are_measured_by_bit_vectors(spark):
    rng = random.Random(7)

    def model(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = ["".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(1, 80))) for _ in range(120)]
    assert all(edit_distance(a, b) == model(a, b) for a, b in zip(words, words[1:]))
    long = "".join(rng.choice("abcdefgh") for _ in range(600))
    changed = "x".join(long[i : i + 50] for i in range(0, 600, 50))
    other = "".join(rng.choice("abcdefgh") for _ in range(600))
    pairs = spark.createDataFrame([(0, long, changed), (1, long, other), (2, long, long), (3, None, long), (4, "ab", "ac"), (5, "", long)], "i int, a string, b string")
    got = {r.i: (r.full, r.half) for r in pairs.select(
        "i", edit_similarity(F.col("a"), F.col("b"), normalized=True).alias("full"), edit_similarity(F.col("a"), F.col("b"), F.lit(0.9), normalized=True).alias("half")
    ).collect()}
    apart = model(long, other)
    assert got == {0: (1 - 11 / 611, 1 - 11 / 611), 1: (1 - apart / 600, 0.0), 2: (1.0, 1.0), 3: (None, None), 4: (0.5, 0.5), 5: (0.0, 0.0)}


def test_lines_are_normalised_once(spark):
    rows = [(1, "a b\nA c\n\nlast"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).createOrReplaceTempView("sizes_documents")

    class Given(Tables):
        def __call__(self, name):
            return self.spark.table("sizes_documents") if name == "documents" else super().__call__(name)

    catalog.load()
    told = PLANS["text_similarity_lev"](Given(spark, ""))
    assert sorted((r.text_id % 10, r.similarity) for r in told.collect()) == [(0, 0.5), (1, 0.0), (2, 0.0)]
    assert all(line.count("regexp_replace") <= 1 for line in _plan(told).splitlines())


def test_pairs_are_compared_once(spark):
    def sheet(first: int, change):
        rows = [(1, first + i, change(f"line {i} of the page, " + "abcdefghij" * (i % 3)), 10, 100 * i, 200, 100 * i + 40) for i in range(12)]
        return spark.createDataFrame(rows, "page int, text_id long, text string, x1 int, y1 int, x2 int, y2 int")

    layer, ocr = sheet(100, lambda text: text), sheet(500, lambda text: text.replace("e", "3"))
    for similarity, step in (("edit", "levenshtein("), ("edit", "distances("), ("blocks", "ratios(")):
        edges = texts.match_edges(layer, ocr, ["page"], similarity=similarity)
        told = [line for line in _plan(edges).splitlines() if step in line]
        assert len(told) == 1 and all(line.count(step) <= 2 for line in told)
        assert sorted((r.layer_text_id, r.ocr_text_id) for r in edges.collect()) == [(100 + i, 500 + i) for i in range(12)]


def test_blocks_are_looked_for_where_they_may_do():
    assert _ratio("abcd", "wxyz", 0.5) == 0.0 and _ratio("abcd", "abcx", 0.7) == _ratio("abcd", "abcx") == 0.75
    assert _ratio("abcd", "dcba", 0.9) == _ratio("abcd", "dcba") == 0.25


def test_blocks_are_those_of_the_standard_library():
    assert not hasattr(text, "difflib")
    rng = random.Random(8)
    for trial in range(400):
        size = rng.choice([4, 30, 90, 199, 200, 260, 420])
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz\u6f22\u5b57\U0001f600"])
        b = "".join(rng.choice(letters) for _ in range(size)) + "".join(map(chr, rng.sample(range(0x4E00, 0x4F00), trial % 3 * 9)))
        a = "".join(rng.choice(("", c, c, c, c, c, c + "z", rng.choice(letters))) for c in b[:: rng.choice((1, 1, 1, -1))])
        want, least = difflib.SequenceMatcher(a=a, b=b).ratio(), rng.random()
        assert _ratio(a, b) == want and _ratio(a, b, least) in ((want,) if want >= least else (want, 0.0))


def test_texts_move_once_to_be_compared(spark):
    def sheet(first: int, change):
        rows = [(page, first + i, change(f"line {i} of page {page}"), 10, 90 * i, 200, 90 * i + 40) for page in (1, 2, None) for i in range(12 - 6 * (page == 2))]
        return spark.createDataFrame(rows, "page int, text_id long, text string, x1 int, y1 int, x2 int, y2 int")

    layer, ocr = sheet(100, lambda text: text), sheet(500, lambda text: text.replace("e", "3"))
    for similarity in ("edit", "blocks"):
        alone = texts.match_edges(layer, ocr, ["page"], similarity=similarity)
        assert len([line for line in _plan(alone).splitlines() if "Exchange" in line]) == 2
        mixed, cells = (texts.match_edges(layer, ocr, ["page"], similarity=similarity, crowd=crowd) for crowd in (15, 1))
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, mixed.collect())) == sorted(map(tuple, cells.collect()))
        assert sorted((r.page, r.layer_text_id, r.ocr_text_id) for r in alone.collect()) == [(page, 100 + i, 500 + i) for page in (1, 2) for i in range(18 - 6 * page)]


def test_lines_are_worked_on_in_tasks_of_bounded_size(spark, monkeypatch):
    rng = random.Random(21)
    found = [(i % 5, rng.randrange(300), rng.randrange(60), rng.randrange(700, 1000), rng.randrange(60)) for i in range(4000)]
    segments = spark.createDataFrame(found, "image_id int, sx1 int, sy1 int, sx2 int, sy2 int")
    assert tasks_for(segments, 100) == 40
    assert tasks_for(segments, 4000) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = rows.long_segments(segments, 1000)
    spread = rows.line_density(lines, ["image_id"], 1000, 1000, tasks=40)
    assert spread.rdd.getNumPartitions() == 40

    def told(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

    assert told(spread) == told(rows.line_density(lines, ["image_id"], 1000, 1000))
    few = told(rows.detect_hard_lines(segments, ["image_id"], 1000, 1000))
    monkeypatch.setattr(rows, "tasks_for", lambda df: 40)
    stored, tasks = rows.laid_lines(segments, ["image_id"], 1000)
    assert (stored.rdd.getNumPartitions(), tasks) == (40, 40)
    assert few and told(rows.detect_hard_lines(segments, ["image_id"], 1000, 1000)) == few


def test_keys_of_patches_are_made_once(spark, monkeypatch, tmp_path):
    catalog.load()
    spark.range(1000).selectExpr("id AS event_id", "CAST(id % 97 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    tables, made, plain = Tables(spark, str(tmp_path)), spark.sparkContext.accumulator(0), patches.content_keys

    def counted(crops, keys, salt):
        keyed = plain(crops, keys, salt)

        def passed(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return keyed.mapInArrow(passed, keyed.schema)

    monkeypatch.setattr(patches, "content_keys", counted)
    assert PLANS["batch_embed"](tables).count() > 0
    assert made.value == tables("pixels").select("image_id", "label").distinct().count()
