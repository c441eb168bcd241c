"""Walks that SQL cannot say, against small models written from the rules."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import bands, packaging, patches, regions, texts

LIMITS = {"iou": 0.45, "containment": 0.78, "x_overlap": 0.82, "gap": 20, "fragment": 0.12}


def _area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def _fusible(a, b):
    (p, pr), (q, qr) = (a["box"], a["ratio"]), (b["box"], b["ratio"])
    inter = _area((max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])))
    union = _area(p) + _area(q) - inter
    across = max(0, min(p[2], q[2]) - max(p[0], q[0])) / max(1, min(p[2] - p[0], q[2] - q[0]))
    apart = q[1] - p[3] if p[3] < q[1] else p[1] - q[3] if q[3] < p[1] else 0
    return (inter > 0 and inter / max(union, 1) >= 0.45) or inter / max(_area(p), 1) >= 0.78 or inter / max(_area(q), 1) >= 0.78 or (
        min(pr, qr) <= 0.12 and across >= 0.82 and apart <= 20
    )


def _fused_plainly(rows):
    """Boxes, scores, ratios and members after merging the first pair in list order, from the start each time."""
    todo = [{"id": r[0], "box": r[1:5], "score": r[5], "ratio": r[6], "ids": set(r[7])} for r in sorted(rows, key=lambda r: (r[2], r[1], r[0]))]
    pair = True
    while pair:
        pair = next(((a, b) for k, a in enumerate(todo) for b in todo[k + 1 :] if _fusible(a, b)), None)
        if pair:
            a, b = pair
            p, q = a["box"], b["box"]
            a.update(box=(min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])), score=max(a["score"], b["score"]), ratio=min(1.0, a["ratio"] + b["ratio"]), ids=a["ids"] | b["ids"])
            todo.remove(b)
    return [(r["id"], *r["box"], r["score"], round(r["ratio"], 9), sorted(r["ids"])) for r in todo]


def _fused(rows):
    part = pd.DataFrame(rows, columns=["region_id", "x1", "y1", "x2", "y2", "score", "area_ratio", "node_ids"])
    out = regions._Fragments(part.assign(y1_in=part["y1"], x1_in=part["x1"]), LIMITS).fused()
    return [(r.region_id, r.x1, r.y1, r.x2, r.y2, r.score, round(r.area_ratio, 9), sorted(r.node_ids)) for r in out.itertuples()]


def _boxes(rng, n, wide, high):
    for i in range(n):
        x, y = rng.randrange(wide), rng.randrange(high)
        yield i, x, y, x + rng.randrange(0, 240), y + rng.randrange(0, 90), rng.random(), rng.randrange(40) / 100, [i, i + 1]


def test_fragments_equal_starting_over():
    rng = random.Random(12)
    for case in range(400):
        rows = list(_boxes(rng, rng.randrange(1, 90), rng.choice([60, 300, 2000]), rng.choice([100, 900, 4000])))
        assert _fused(rows) == _fused_plainly(rows)


def test_many_stretches_in_one_list_merge_as_each_by_itself():
    rng = random.Random(17)
    names = ["region_id", "x1", "y1", "x2", "y2", "score", "area_ratio", "node_ids"]
    stretches = [sorted(_boxes(rng, rng.randrange(1, 90), 60, 900), key=lambda r: (r[2], r[1], r[0])) for _ in range(60)]
    starts = np.cumsum([0, *map(len, stretches[:-1])])
    out = regions._Fragments(pd.DataFrame(sum(stretches, []), columns=names), LIMITS, starts).fused()
    got = [(r.region_id, r.x1, r.y1, r.x2, r.y2, r.score, round(r.area_ratio, 9), sorted(r.node_ids)) for r in out.itertuples()]
    assert got == [r for rows in stretches for r in _fused(rows)]


def test_stretches_are_whole_whatever_the_batches(spark):
    rng = random.Random(18)
    rows = [(band, *r) for band in range(40) for r in _boxes(rng, rng.randrange(1, 30), 200, 600)]
    df = spark.createDataFrame(rows, "band int, region_id int, x1 int, y1 int, x2 int, y2 int, score double, area_ratio double, node_ids array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, regions.merge_fragments(df, ["band"]).drop("area_ratio").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(band, *r[:6], r[7]) for band in range(40) for r in _fused([r[1:] for r in rows if r[0] == band])]
    assert got == sorted(want)
    assert len(got) < len(rows)


def test_five_thousand_fragments_are_merged_quickly():
    rows = list(_boxes(random.Random(13), 5000, 4000, 40_000))
    start = time.perf_counter()
    assert 0 < len(_fused(rows)) < 5000
    assert time.perf_counter() - start < 20


def test_manifest_states_and_follows_its_limits(spark):
    schema = "page int, band int, region_id int, x1 int, y1 int, x2 int, y2 int, score double, area_ratio double, node_ids array<int>"
    rows = [(1, 0, i, 0, 200 * i, 100, 200 * i + 100, i / 10, 0.3, [i]) for i in range(5)]
    df = spark.createDataFrame(rows, schema)
    for limits, panels in ((regions.ExportLimits(), 3), (regions.ExportLimits(score_thr=0.35, pad=0), 1), (regions.ExportLimits(merge_gap_px=100, merge_fragment_max_area_ratio=1.0), 1)):
        manifest, exported = regions.panel_manifest(df, ["page"], ["page", "band"], 1000, 1000, limits)
        (record,) = manifest.collect()
        assert (record.source_count, record.panel_count, record.pad, record.score_thr, record.merge_gap_px) == (5, panels, limits.pad, limits.score_thr, limits.merge_gap_px)
        assert exported.count() == panels


def test_a_run_record_fills_what_is_not_told(spark):
    summary = spark.createDataFrame([(1, "a", 3), (2, "b", 0)], "page int, prefix string, panel_count long")
    merges = spark.createDataFrame([(1, 4, 5)], "page int, merge_unmatched_psd_count long, merge_unmatched_ocr_count long")
    told = spark.createDataFrame([(2, "license", None)], "page int, ocr_mode string, ocr_latency_ms long")
    one, two = sorted(packaging.run_record(summary, ["page"], merges, told, " Stage2 ").collect())
    assert (one.split_mode, one.panel_count, one.merge_unmatched_psd_count, one.ocr_mode, one.textbox_layer_count) == ("stage2", 3, 4, "", 0)
    assert (two.merge_unmatched_ocr_count, two.ocr_mode, two.ocr_latency_ms, two.panel_text_manifest_path) == (0, "license", 0, "b_panel_text_manifest.json")


def test_groups_of_boxes_equal_linking_all_pairs(spark):
    rng = random.Random(14)
    rows = []
    for page, (n, side, most) in enumerate([(40, 300, 30), (120, 900, 25), (60, 500, 12), (150, 200, 60), (90, 1500, 60), (1, 10, 5)]):
        for i in range(n):
            x, y = rng.randrange(-20, side), rng.randrange(side)
            rows.append((page, i, x, y, x + 1 + rng.randrange(most * 2), y + 1 + rng.randrange(most)))
    df = spark.createDataFrame(rows, "page int, text_id int, x1 int, y1 int, x2 int, y2 int")
    gaps = {r.page: (r.gap_x, r.gap_y) for r in texts.gap_params(df, ["page"]).collect()}
    got = {(r.page, r.text_id): r.component for r in texts.box_groups(df, ["page"], crowd=0).collect()}
    mixed = {(r.page, r.text_id): r.component for r in texts.box_groups(df, ["page"], crowd=20).collect()}
    want = {(page, i): i for page, i, *_ in rows}
    again = True
    while again:
        again = False
        for p, i, ax1, ay1, ax2, ay2 in rows:
            for q, j, bx1, by1, bx2, by2 in rows:
                if p == q and want[p, i] < want[p, j]:
                    gx, gy = gaps[p]
                    if not (ax2 + gx < bx1 or bx2 + gx < ax1 or ay2 + gy < by1 or by2 + gy < ay1):
                        want[p, j], again = want[p, i], True
    assert got == mixed == want and len({(p, c) for (p, _), c in got.items()}) > 20


def test_links_of_a_dense_page_are_in_proportion_to_its_boxes(spark):
    df = spark.range(20_000).selectExpr("1 page", "id text_id", "CAST(id % 200 AS INT) x1", "CAST(id DIV 200 AS INT) y1").selectExpr("*", "x1 + 60 AS x2", "y1 + 30 AS y2")
    grown = df.join(texts.gap_params(df, ["page"]), "page")
    assert texts._linking(grown, ["page"]).count() < 30 * 20_000
    assert texts.box_groups(df, ["page"]).select("component").distinct().count() == 1


def test_regions_without_a_box_stay(spark):
    schema = "band int, region_id int, x1 int, y1 int, x2 int, y2 int, score double, area_ratio double, node_ids array<int>"
    rows = [(None, 1, 0, 0, 100, 50, 0.5, 0.1, [1]), (None, 2, 0, 55, 100, 90, 0.6, 0.1, [2]), (None, 3, None, 10, 20, 30, 0.1, 0.1, None), (1, 4, 0, None, 5, 5, 0.1, 0.1, [4]), (1, 5, 0, None, 5, 5, 0.1, 0.1, [5])]
    got = regions.merge_fragments(spark.createDataFrame(rows, schema), ["band"]).collect()
    assert sorted((r.region_id, r.y2, r.node_ids) for r in got) == [(1, 90, [1, 2]), (3, 30, None), (4, 5, [4]), (5, 5, [5])]


def test_merge_fragments_follows_list_order(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        x, y = rng.randrange(300), rng.randrange(1500)
        rows.append((i % 2, i, x, y, x + 40 + rng.randrange(200), y + 10 + rng.randrange(80), rng.random(), rng.randrange(40) / 100, [i, i + 1]))
    df = spark.createDataFrame(rows, "band int, region_id int, x1 int, y1 int, x2 int, y2 int, score double, area_ratio double, node_ids array<int>")
    got = {r.region_id: (r.x1, r.y1, r.x2, r.y2, round(r.score, 9), tuple(r.node_ids)) for r in regions.merge_fragments(df, ["band"]).collect()}
    want = {}
    for band in (0, 1):
        todo = [{"id": r[1], "box": r[2:6], "score": r[6], "ratio": r[7], "ids": set(r[8])} for r in sorted(rows, key=lambda r: (r[3], r[2], r[1])) if r[0] == band]
        again = True
        while again:
            again = False
            for i in range(len(todo)):
                for j in range(i + 1, len(todo)):
                    if _fusible(todo[i], todo[j]):
                        a, b = todo[i], todo[j]
                        p, q = a["box"], b["box"]
                        a.update(box=(min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])), score=max(a["score"], b["score"]), ratio=min(1.0, a["ratio"] + b["ratio"]), ids=a["ids"] | b["ids"])
                        del todo[j]
                        again = True
                        break
                if again:
                    break
        want.update({r["id"]: (*r["box"], round(r["score"], 9), tuple(sorted(r["ids"]))) for r in todo})
    assert got == want
    assert len(got) < 60


def _refined(rows, white, edge):
    """Bands of one image as the rule says, on whole lists."""
    out = [list(r) for r in rows]

    def content(b):
        w, e = white[b[0]:b[1]], edge[b[0]:b[1]]
        blank, lines = 1 - sum(w) / len(w), sum(e) / len(e)
        return min(max(0.6 * min(max(blank, 0), 1) + 0.4 * min(lines / 0.02, 1), 0), 1)

    i = 0
    while i < len(out) and len(rows) > 1:
        outer = i in (0, len(out) - 1)
        bar = out[i][3] == "black_bar_band"
        if bar or out[i][1] - out[i][0] >= (251 if outer else 153) or content(out[i]) >= 0.17 * (1.25 if outer else 1):
            i += 1
            continue
        sides = [j for j in (i - 1, i + 1) if 0 <= j < len(out) and out[j][3] != "black_bar_band"]
        if not sides:
            i += 1
            continue
        best = max(sides, key=lambda j: content(out[j]) + 0.15 * min((out[j][1] - out[j][0]) / 180, 1))
        a, b = out[i], out[best]
        out[best] = [min(a[0], b[0]), max(a[1], b[1]), max(a[2], b[2]), b[3]]
        del out[i]
        i = max(0, i - 1)
    return sorted(map(tuple, out))


def test_refine_bands_equals_walk_over_the_whole_page(spark):
    rng = random.Random(13)
    features, listed, want = [], [], []
    for image in range(6):
        cuts = sorted({0, 3000, *(rng.randrange(1, 3000) for _ in range(24))})
        rows = [(a, b, rng.random(), rng.choice(["gutter", "gutter", "gutter", "black_bar_band"])) for a, b in zip(cuts, cuts[1:])]
        white, edge = [], []
        for a, b, *_ in rows:
            blank = rng.random() < 0.6
            white += [0.99 if blank else 0.4] * (b - a)
            edge += [0.0005 if blank else 0.01] * (b - a)
        features += [(image, y, white[y], edge[y]) for y in range(3000)]
        listed += [(image, *r) for r in rows]
        want += [(image, *r) for r in _refined(rows, white, edge)]
    rows = spark.createDataFrame(features, "image_id int, y int, white_ratio double, edge_density double")
    given = spark.createDataFrame(listed, "image_id int, y1 int, y2 int, score double, reason string")
    got = sorted(tuple(r) for r in bands.refine_bands(given, rows, ["image_id"]).collect())
    assert got == sorted(want)
    assert len(got) < len(listed)


def _grid(spark, seed):
    rng = random.Random(seed)
    nodes = []
    for i in range(30):
        kind = rng.randrange(3)
        vector = [1.0 if kind == k else 0.2 for k in range(3)]
        nodes.append((0, i, 100 + rng.randrange(200), rng.random(), rng.random(), 80.0 * kind, 60.0, 90.0 * kind, vector))
    edges = [(0, a, b, rng.randrange(100) / 100) for a in range(30) for b in (a + 1, a + 6) if b < 30 and not (b == a + 1 and b % 6 == 0)]
    node_schema = "band int, node_id int, area int, edge_mean double, non_white_ratio double, mean_b double, mean_g double, mean_r double, embedding array<double>"
    return spark.createDataFrame(nodes, node_schema), spark.createDataFrame(edges, "band int, a int, b int, boundary_cost double"), edges


@pytest.mark.parametrize("seed", [1, 2])
def test_grown_regions_partition_the_nodes_and_hang_together(spark, seed):
    nodes, edges, links = _grid(spark, seed)
    got = patches.grow_regions(nodes, edges, ["band"]).collect()
    assert sorted(r.node_id for r in got) == list(range(30))
    members = {}
    for r in got:
        members.setdefault(r.region_id, set()).add(r.node_id)
    assert sorted(members) == list(range(len(members)))
    for group in members.values():
        reached, todo = set(), [min(group)]
        while todo:
            n = todo.pop()
            if n not in reached:
                reached.add(n)
                todo += [b if a == n else a for _, a, b, _c in links if n in (a, b) and (b if a == n else a) in group]
        assert reached == group


def test_grow_two_blocks_by_hand(spark):
    # Nodes 0-3 alike, 4-7 alike, a strong border between 3 and 4.
    rows = [(0, i, 100, 0.9 if i in (0, 4) else 0.1, 0.5, 0.0, 0.0, 250.0 if i > 3 else 0.0, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)]
    schema = "band int, node_id int, area int, edge_mean double, non_white_ratio double, mean_b double, mean_g double, mean_r double, embedding array<double>"
    edges = [(0, i, i + 1, 0.9 if i == 3 else 0.1) for i in range(7)]
    got = patches.grow_regions(spark.createDataFrame(rows, schema), spark.createDataFrame(edges, "band int, a int, b int, boundary_cost double"), ["band"])
    assert sorted((r.region_id, r.node_id) for r in got.collect()) == [(0, i) for i in range(4)] + [(1, i) for i in range(4, 8)]


def test_equal_boxes_leave_one(spark):
    rows = [(1, i, 10, 10, 110, 110, 0.5, 0.3) for i in range(40)] + [(1, 99, 500, 500, 600, 600, 0.4, 0.3)]
    df = spark.createDataFrame(rows, "page int, region_id int, x1 int, y1 int, x2 int, y2 int, score double, area_ratio double")
    assert sorted(r.region_id for r in regions.dedup_regions(df, ["page"]).collect()) == [0, 99]
    assert sorted(r.region_id for r in regions.select_primary(df, ["page"]).collect()) == [0, 99]


def _grow_model(nodes, links):
    """The rules of region growth over dicts and sets: areas, vectors and colours by node, costs by pair."""
    area, vec = ({n[1]: n[k] for n in nodes} for k in (2, 8))
    cost = {}
    for _, a, b, c in links:
        cost[a, b] = cost[b, a] = c
    near = {n: {b for a, b in cost if a == n} for n in area}
    total = sum(area.values())
    salience = {n[1]: 0.45 * n[3] + 0.45 * n[4] + 0.1 * min(n[2] / total * 10, 1) for n in nodes}
    color = {n[1]: n[5:8] for n in nodes}

    def unit(group):
        mean = [sum(vec[n][k] for n in group) / len(group) for k in range(3)]
        size = sum(x * x for x in mean) ** 0.5
        return [x / size for x in mean]

    def cos(u, v):
        return sum(x * y for x, y in zip(u, v)) / (sum(x * x for x in u) ** 0.5 * sum(x * x for x in v) ** 0.5)

    def alike(a, b):
        return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(color[a], color[b])) ** 0.5 / (255 * 3**0.5))

    def border(g, h):
        found = [cost[a, b] for a in g for b in h if (a, b) in cost]
        return min(1.0, min(found)) if found else None

    regions, used = [], set()
    for seed in sorted(salience, key=lambda n: (-salience[n], n))[:8]:
        if seed in used:
            continue
        group = {seed}
        while True:
            offers = []
            for n in {m for g in group for m in near[g]} - group - used:
                c, v, s = border({n}, group), max(alike(n, g) for g in group if g in near[n]), cos(vec[n], unit(group))
                if c <= 0.46 and (s >= 0.5 or v >= 0.58):
                    offers.append((0.55 * s + 0.3 * v - 0.35 * c, n))
            grown = False
            for _score, n in sorted(offers, reverse=True)[:24]:
                if sum(area[g] for g in group) + area[n] <= 0.72 * total:
                    group.add(n)
                    grown = True
            if not grown:
                break
        if sum(area[g] for g in group) >= 0.03 * total:
            regions.append(group)
            used |= group
    for n in sorted(set(area) - used):
        best = min(((border({n}, g), i) for i, g in enumerate(regions) if border({n}, g) is not None), default=(2, None))
        if best[0] <= 0.46:
            regions[best[1]].add(n)
        else:
            regions.append({n})
    again = True
    while again:
        again = False
        for i, g in enumerate(regions):
            middle = unit(g) if g else None
            for h in regions[i + 1:] if g else []:
                if h and border(g, h) is not None and border(g, h) <= 0.3 and cos(middle, unit(h)) >= 0.78:
                    g |= h
                    h.clear()
                    again = True
        regions = [g for g in regions if g]
    again = True
    while again:
        again = False
        for i, g in enumerate(regions):
            if len(g) >= 3 and sum(area[n] for n in g) >= 0.015 * total:
                continue
            best = min(((border(g, h), j) for j, h in enumerate(regions) if j != i and border(g, h) is not None), default=(2, None))
            if best[0] < 1.0:
                regions[best[1]] |= g
                del regions[i]
                again = True
                break
    return [sorted(g) for g in regions]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_grow_equals_model(spark, seed):
    nodes, edges, links = _grid(spark, seed)
    got = {}
    for r in patches.grow_regions(nodes, edges, ["band"]).collect():
        got.setdefault(r.region_id, []).append(r.node_id)
    assert [sorted(got[i]) for i in sorted(got)] == _grow_model([tuple(r) for r in nodes.collect()], links)


def test_a_band_of_twenty_thousand_patches_takes_memory_in_proportion():
    rng, wide = np.random.default_rng(9), 145
    n = wide * wide
    kind = (np.arange(n) % wide // 29) % 3
    nodes = pd.DataFrame({"node_id": np.arange(n), "area": rng.integers(50, 150, n), "seed_no": np.where(np.arange(n) < 8, np.arange(n) + 1.0, np.nan)})
    nodes = nodes.assign(embedding=[[float(k == c) + 0.1 for c in range(3)] for k in kind], mean_b=kind * 90.0, mean_g=50.0, mean_r=kind * 60.0)
    a = np.concatenate([np.flatnonzero(np.arange(n) % wide < wide - 1), np.arange(n - wide)])
    b = a + np.where(np.arange(len(a)) < n - wide, 1, wide)
    edges = pd.DataFrame({"a": a, "b": b, "boundary_cost": rng.random(len(a)).round(2)})
    tracemalloc.start()
    found = patches._regions_of(patches._Graph(nodes, edges), patches.GrowLimits(), "absorb")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x for r in found for x in r) == list(range(n)) and most < 200 << 20


def test_no_cost_is_the_strongest_border_and_the_lowest_of_several_counts(spark):
    schema = "band int, node_id int, area int, edge_mean double, non_white_ratio double, mean_b double, mean_g double, mean_r double, embedding array<double>"
    rows = [(0, i, 100, 0.9 if i == 0 else 0.1, 0.5, 0.0, 0.0, 0.0, [1.0, 0.0]) for i in range(6)]
    links = [(0, 0, 1, 0.9), (0, 0, 1, 0.1), (0, 1, 2, 0.1), (0, 2, 3, None), (0, 3, 4, 0.1), (0, 4, 5, 0.1), (0, 5, 5, 0.0), (0, 5, 77, 0.0)]
    got = patches.grow_regions(spark.createDataFrame(rows, schema), spark.createDataFrame(links, "band int, a int, b int, boundary_cost double"), ["band"])
    assert sorted((r.region_id, r.node_id) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]


def test_stages_only_ever_join_regions(spark):
    nodes, edges, _links = _grid(spark, 6)
    counts = [patches.grow_regions(nodes, edges, ["band"], stage=s).select("region_id").distinct().count() for s in ("orphans", "merge", "absorb")]
    assert counts == sorted(counts, reverse=True)


def _merged_by_anchor(cuts, distance):
    out = []
    for y, ord_, strength, kind in sorted(cuts):
        if out and y - out[-1][0] <= distance:
            g = out[-1]
            better = bands.PRIORITY.get(kind, 0) > bands.PRIORITY.get(g[2], 0)
            out[-1] = (g[0], max(g[1], strength), kind if better else g[2], g[3], g[4] + 1)
        else:
            out.append((y, strength, kind, ord_ / 10, 1))
    return out


@pytest.mark.parametrize("size", [32, 4096])
def test_anchors_cross_buckets_as_in_one_walk(spark, monkeypatch, size):
    rng = random.Random(size)
    plain = bands._anchors
    monkeypatch.setattr(bands, "_anchors", lambda cuts, keys, distance: plain(cuts, keys, distance, size))
    rows, want = [], []
    for image, step in ((1, 3), (2, 12), (3, 30), (None, 7)):
        y, cuts = rng.randrange(40), []
        for k in range(250):
            y += rng.choice([0, 1, step, step, rng.randrange(1, 2 * step), 25, 26])
            cuts.append((y, k, rng.random(), rng.choice(["gutter", "black_bar", "hard_line", "other"])))
        rows += [(image, k, y, s, kind, y - 2, y + 3, k / 10) for y, k, s, kind in cuts]
        want += [(image, *g) for g in _merged_by_anchor(cuts, 25)]
    df = spark.createDataFrame(rows, "image_id int, ord long, y int, strength double, kind string, span_y1 int, span_y2 int, meta_e double")
    got = bands.merge_cuts(df, ["image_id"]).select("image_id", "y", "strength", "kind", "meta_e", "merged").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bands.merge_cuts(df.limit(0), ["image_id"]).count() == 0


def test_a_dense_image_is_merged_by_many_tasks(spark):
    df = spark.range(50_000).select(F.lit(1).alias("image_id"), F.col("id").alias("ord"), F.col("id").cast("int").alias("y"), F.lit(0.5).alias("strength"), F.lit("gutter").alias("kind"), *[F.col("id").cast("int").alias(c) for c in ("span_y1", "span_y2")], F.lit(0.0).alias("meta_e"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one task
    try:
        anchors = bands._anchors(df, ["image_id"], 25).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert anchors > 1
    got = bands.merge_cuts(df, ["image_id"]).agg(F.count("*"), F.sum("merged"), F.max(F.col("y") % 26)).first()
    assert tuple(got) == (-(-50_000 // 26), 50_000, 0)
