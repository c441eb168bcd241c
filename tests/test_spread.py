"""Helpers that split groups, against plain windows and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.geometry import Box
from panelweave.operators import rounds, spatial, spread


def test_row_numbers_and_running_max_equal_windows(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).cast("int").alias("y"), "id")
    order = Window.partitionBy("g").orderBy("y")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "id", F.row_number().over(order).alias("rn"), F.max("id").over(before).alias("m"))
    got = spread.row_numbers(df, ["g"], [F.col("y")])
    got = spread.running_max(got, ["g"], [F.col("y")], F.col("y"), F.col("id"), "m", size=64, include_current=False)
    assert want.exceptAll(got.select("g", "id", "rn", "m")).isEmpty()
    assert got.count() == 5000


def test_runs_are_stitched_across_buckets(spark):
    rows = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("y"))
    got = sorted((r.y1, r.y2) for r in spread.true_runs(rows, ["g"], "y", F.col("y") % 37 < 30, size=16).collect())
    assert got == [(y, min(y + 30, 3000)) for y in range(0, 3000, 37)]


def test_halo_frames_see_all_neighbours(spark):
    rows = spark.range(200).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("y"))
    frame = Window.partitionBy("g", spread.BUCKET).orderBy("y").rangeBetween(-3, 2)
    got = spread.with_halo(rows, ["g"], "y", 3, 2, size=16).withColumn("n", F.count("y").over(frame)).where("_own").collect()
    assert len(got) == 200
    assert all(r.n == len(range(max(r.y - 3, 0), min(r.y + 2, 199) + 1)) for r in got)


def _boxes(n, seed):
    rng = random.Random(seed)
    return [(1, i, x, y, x + rng.randrange(150), y + rng.randrange(150)) for i in range(n) for x, y in [(rng.randrange(900), rng.randrange(900))]]


def test_touching_pairs_equal_all_pairs(spark):
    boxes = _boxes(150, 3)
    left = spark.createDataFrame(boxes, "g int, i int, x1 int, y1 int, x2 int, y2 int")
    right = left.select("g", *(F.col(c).alias(f"o_{c}") for c in ("i", "x1", "y1", "x2", "y2")))
    got = sorted((r.i, r.o_i) for r in spatial.touching_pairs(left, right, ["g"], Box.named(), Box.named("o_"), 64).collect())
    want = sorted((a[1], b[1]) for a in boxes for b in boxes if max(a[2], b[2]) <= min(a[4], b[4]) and max(a[3], b[3]) <= min(a[5], b[5]))
    assert got == want


def test_nearest_target_by_levels(spark):
    rng = random.Random(5)
    points = [(rng.choice([1, 1, 2]), i, float(rng.randrange(3000)), float(rng.randrange(3000))) for i in range(120)]
    targets = [(rng.choice([1, 2]), i, float(rng.randrange(2500, 2900)), float(rng.randrange(3000))) for i in range(25)]
    p, t = spark.createDataFrame(points, "g int, pid int, px double, py double"), spark.createDataFrame(targets, "g int, tid int, tx double, ty double")
    squared = F.pow(F.col("_px") - F.col("_tx"), 2) + F.pow(F.col("_py") - F.col("_ty"), 2)
    got = spatial.nearest_by_center(p, t, ["g"], (F.col("px"), F.col("py")), (F.col("tx"), F.col("ty")), ["pid"], [squared, F.col("tid")], ["tid"], cell=64)
    want = {a[1]: min(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[1]) for b in targets if b[0] == a[0])[1] for a in points}
    assert {r.pid: r.tid for r in got.collect()} == want


def test_greedy_rounds_equal_one_pass(spark):
    rng = random.Random(7)
    conflicts = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(90)}
    kept, lost = [], set()
    for i in range(50):
        (lost.add if any((k, i) in conflicts for k in kept) else kept.append)(i)
    got = rounds.suppressed(spark.createDataFrame(sorted(conflicts), "hi int, lo int"))
    assert {r.id for r in got.collect()} == lost


def test_matching_rounds_equal_one_pass(spark):
    rng = random.Random(9)
    edges = list({(rng.randrange(20), rng.randrange(20)): rng.randrange(5) / 4 for _ in range(120)}.items())
    taken_l, taken_r, want = set(), set(), set()
    for (a, b), _w in sorted(edges, key=lambda e: (-e[1], e[0])):
        if a not in taken_l and b not in taken_r:
            taken_l.add(a), taken_r.add(b), want.add((a, b))
    got = rounds.matched(spark.createDataFrame([(a, b, w) for (a, b), w in edges], "l int, r int, w double"), "l", "r", "w")
    assert {(r.l, r.r) for r in got.collect()} == want


def test_components_of_chain_and_pairs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 102)]
    got = {r.id: r.component for r in rounds.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_parts_split_a_dense_group_by_rows(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("page"), (F.col("id") * 7919 % 500).cast("int").alias("y"), "id")
    parts = spread.laid_out(rows, ["page"], [F.col("y"), F.col("id")]).groupBy(spread.BUCKET).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 50_000
    got = spread.row_numbers(rows, ["page"], [F.desc("y"), F.col("id")])
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("y"), "id")))
    assert got.select("id", "rn").exceptAll(want.select("id", "rn")).isEmpty() and got.count() == 100_000


def test_interval_sums_equal_plain_sums(spark):
    rng = random.Random(9)
    values = {(g, y): rng.random() for g in (1, None) for y in range(-40, 300) if y % 11}
    rows = spark.createDataFrame([(g, y, v) for (g, y), v in values.items()] + [(2, 5, float("nan")), (2, 6, None), (2, 7, 1.5)], "g int, y int, v double")
    spans = [(g, a, a + rng.randrange(-5, 260)) for g in (1, None, 2, 3) for a in rng.sample(range(-60, 290), 25)]
    got = spread.interval_sums(spark.createDataFrame(spans, "g int, y1 int, y2 int"), rows, ["g"], ["v"]).collect()
    assert len(got) == len(spans)
    for r in got:
        held = [v for (g, y), v in values.items() if g == r.g and r.y1 <= y < r.y2]
        more = [v for y, v in ((5, None), (6, None), (7, 1.5)) if r.g == 2 and r.y1 <= y < r.y2]
        assert r.n_rows == len(held) + len(more) and abs(r.v - sum(held) - sum(v or 0 for v in more)) < 1e-12


def test_neighbours_over_empty_buckets(spark):
    rng = random.Random(2)
    ys = sorted(rng.sample(range(5000), 60))
    df = spark.createDataFrame([(g, y) for g in (1, None) for y in ys], "g int, y int")
    got = spread.neighbours(df, ["g"], F.col("y"), ["y"], size=64).collect()
    around = {y: (a, b) for a, y, b in zip([None, *ys], ys, [*ys[1:], None])}
    assert len(got) == 120 and all((r.prev and r.prev.y, r.next and r.next.y) == around[r.y] for r in got)


def test_walked_reads_each_group_in_order(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 9001).alias("y"))

    def falls(rows):
        last = -1
        for (y,) in rows:
            yield (y, y > last)
            last = y

    schema = spark.createDataFrame([], "g long, y long, up boolean").schema
    got = spread.walked(df, ["g"], ["y"], schema, falls, piece=100)
    assert got.count() == 9000 and got.where("NOT up").isEmpty()


def _greedy_losers(conflicts):
    """Ids in order; the stronger of a conflict is the smaller."""
    kept, lost = set(), set()
    for i in sorted({i for pair in conflicts for i in pair}):
        (lost if any((k, i) in conflicts for k in kept) else kept).add(i)
    return lost


@pytest.mark.parametrize("most", [100_000, 30])
def test_suppression_equals_one_ordered_pass(spark, most):
    rng = random.Random(most)
    for n, links in ((60, 90), (200, 260), (40, 400)):
        conflicts = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)} | {(1000 + k, 1001 + k) for k in range(25)}
        df = spark.createDataFrame([(a, b) for a, b in conflicts], "a int, b int").select(*[F.struct(F.when(F.col(c) % 7 > 0, F.col(c) % 7).alias("g"), c).alias(c2) for c, c2 in (("a", "hi"), ("b", "lo"))])
        df = df.select(F.struct("hi.g", F.col("hi.a").alias("i")).alias("hi"), F.struct("lo.g", F.col("lo.b").alias("i")).alias("lo"))
        got = [r.id.i for r in rounds.suppressed(df, most=most, rounds=1).collect()]
        assert sorted(got) == sorted(_greedy_losers(conflicts))


@pytest.mark.parametrize("most", [100_000, 20])
def test_matching_equals_one_ordered_pass(spark, most):
    rng = random.Random(most)
    edges = {(rng.randrange(40), rng.randrange(40)): rng.choice([0.5, 0.7, 0.9]) for _ in range(160)} | {(100 + k, 100 + k + d): 1 + (2 * k + d) / 1000 for k in range(30) for d in (0, 1)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a int, b int, w double").select(F.struct("a").alias("l"), F.struct("b").alias("r"), "w")
    want, lefts, rights = [], set(), set()
    for (a, b), w in sorted(edges.items(), key=lambda e: (-e[1], *e[0])):
        if a not in lefts and b not in rights:
            want.append((a, b, w))
            lefts.add(a)
            rights.add(b)
    assert sorted((r.l.a, r.r.b, r.w) for r in rounds.matched(df, "l", "r", "w", rounds=1, most=most).collect()) == sorted(want)


def test_long_chains_take_few_jobs(spark, monkeypatch):
    written = []
    plain = rounds.cut_lineage
    monkeypatch.setattr(rounds, "cut_lineage", lambda df: written.append(1) or plain(df))
    stairs = spark.range(5000).select(F.col("id").alias("hi"), (F.col("id") + 1).alias("lo"))
    assert rounds.suppressed(stairs).agg(F.count("id"), F.min(F.col("id") % 2)).first()[:] == (2500, 1)
    assert len(written) < 40


@pytest.mark.parametrize("most", [100_000, 20])
def test_groups_are_matched_without_rounds(spark, monkeypatch, most):
    rng = random.Random(most)
    edges = {(g, rng.randrange(12), rng.randrange(12)): rng.choice([0.5, 0.7, 0.9]) for g in (1, 2, 3) for _ in range(9 * g)}
    written = []
    plain = rounds.cut_lineage
    monkeypatch.setattr(rounds, "cut_lineage", lambda df: written.append(1) or plain(df))
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "g int, l int, r int, w double")
    want, taken = [], set()
    for (g, a, b), w in sorted(edges.items(), key=lambda e: (-e[1], *e[0])):
        if not {(g, "l", a), (g, "r", b)} & taken:
            want.append((g, a, b, w))
            taken |= {(g, "l", a), (g, "r", b)}
    got = rounds.matched(df, "l", "r", "w", most=most, within=["g"])
    assert sorted(map(tuple, got.select("g", "l", "r", "w").collect())) == sorted(want)
    assert (len(written) == 1) == (most > 20)
