"""Line runs, vector codes and the Shallot search against plain models."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm.integer_vectors import LONG_MOST, magnitude
from panelweave.llm.line_dedup import LineRuns, drop_common_lines, line_key
from panelweave.llm.shallot import Search, cluster
from panelweave.llm.vector_codes import compress, exact_products, limbs, nearest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def without_common(rows, chars, docs):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= chars:
                held[key_of(line)].add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key_of(x), ())) >= docs and max(held[key_of(x)]) != (-(2**63) if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def line_rows(seed, n):
    rng = random.Random(seed)
    pool = [f"Line {i} " + "É" * (i % 5) + "x" * rng.randint(20, 40) for i in range(25)]
    rows = [(rng.choice([d, d // 2]), "\n".join(rng.choice([x, x.upper(), f" {x}\t", "short", ""]) for x in rng.choices(pool, k=rng.randint(0, 9)))) for d in range(n)]
    return [*rows, (None, None), (None, pool[0]), (None, pool[0]), (n, ""), (n + 1, pool[1] + "\r"), (n + 2, "\n" + pool[1] + "\n\n" + pool[1]), rows[3], rows[3], (-7, pool[2])]


def as_docs(spark, rows):
    table = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], DOCS)
    return table.withColumns({c: F.lit(3) for c in ("doc", "t1", "h1", "h2", "pos", "batch", "gone", "last", "key", "line")})


@pytest.mark.parametrize("batches,fanout,docs", [(4, 3, 5), (7, 2, 3), (1, 2, 5)])
def test_common_lines_stay_with_the_largest_id(spark, batches, fanout, docs):
    rows = line_rows(batches, 60)
    got = drop_common_lines(as_docs(spark, rows), 30, docs, batches, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == without_common(rows, 30, docs)


def test_lines_of_hot_ids_long_texts_and_empty_tables(spark):
    long_ = "\n".join(f"this is line number {i % 4000} of a long text that goes on" for i in range(9000))
    rows = [(1, long_), (2, long_), (2, long_), (9, long_.upper()), *[(None, "boilerplate " * 5)] * 60, *[(i, "boilerplate " * 5) for i in range(4, 8)], (8, None)]
    got = drop_common_lines(as_docs(spark, rows), 40, 3)
    assert sorted(map(tuple, got.collect()), key=str) == without_common(rows, 40, 3)
    assert drop_common_lines(as_docs(spark, rows[:0])).count() == 0


def test_line_key_lowers_ascii_only(spark):
    lines = [" \x0bÀB c\r", "ABC ", "", " x Y"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(line_key(F.col("line"))).collect()
    assert [r[0] for r in got] == [key_of(x) for x in lines]


def test_runs_are_compacted_by_level_and_leave_settled_lines_out(spark):
    runs = LineRuns(spark, least_docs=2, fanout=2)
    sizes = []
    for b in range(5):
        rows = [(h, h, 100 - b * 10 - i) for h in range(b + 1) for i in range(2)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc long"))
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert spark.table(runs.levels[0][0][0]).count() == 1, "only the line that is new in the last batch"
    assert sorted(map(tuple, runs.common().collect())) == [(h, h, 100 - h * 10) for h in range(5)]
    paths = [path for _, path in runs._all()]
    runs.close()
    for path in paths:
        with pytest.raises(Exception):
            spark.read.parquet(path)


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(4)
    for bits in (3, 8, 24):
        x = rng.integers(-(2**27), 2**27, (50, 7))
        assert (sum(part.astype(np.int64) << (bits * i) for i, part in enumerate(limbs(x, bits))) == x).all()
    for exact_bits in (20, 40, 53):
        x, c = rng.integers(-(2**27), 2**27, (40, 16)), rng.integers(-(2**27), 2**27, (9, 16))
        assert (exact_products(x, c, exact_bits) == x @ c.T).all()
    best, distance = nearest(x, np.concatenate([c, c]))
    plain = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all()


def codes_of(rows, entries, rounds, width):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    parts = np.array([r[1] for r in rows]).reshape(len(rows), 4, width // 4)
    books = [parts[:entries, p].copy() for p in range(4)]

    def found(p):
        d = ((parts[:, p][:, None] - books[p][None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(4):
            a, _ = found(p)
            for k in np.unique(a):
                books[p][k] = parts[a == k, p].sum(0) // (a == k).sum()
    ends = [found(p) for p in range(4)]
    error = sum(d for _, d in ends)
    by_label = defaultdict(int)
    for r, e in zip(rows, error):
        by_label[r[2]] += int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{ends[p][0][i]:02x}" for p in range(4)), int(error[i]), by_label[r[2]], sha) for i, r in enumerate(rows)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("ints", "code", "error", "cluster", "kind")})


def test_codes_against_a_plain_model(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 250), (rng.integers(-900, 900, 8) / 1024).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(None, rows[0][1], None), (7, [2.0] * 8, 1), (999, [1e30, -1e300, *[0.5] * 6], 4)]
    bad = [(1, None, 1), (2, [None, *[1.0] * 7], 1), (3, [float("nan")] * 8, 2), (4, [float("inf")] * 8, 2)]
    most = magnitude(8)
    ints = [(i, np.clip(np.floor(np.array(v) * 1024), -most, most).astype(np.int64), label) for i, v, label in rows]
    got = compress(vectors(spark, rows + bad).repartition(5), entries=20, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == codes_of(ints, 20, 3, 8)


def test_codes_of_odd_lengths_few_rows_and_empty_tables(spark):
    rows = [(1, [0.5, 0.25], 1), (2, [], 1), (3, [1.0] * 6, None)]
    ints = [(i, np.array([int(x * 1024) for x in v] + [0] * (8 - len(v))), label) for i, v, label in rows]
    assert sorted(map(tuple, compress(vectors(spark, rows)).collect()), key=str) == codes_of(ints, 256, 4, 8)
    assert compress(vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("spread,k", [(3, 12), (400, 40), (2**20, 7), (1, 5)])
def test_shallot_search_finds_nearest_and_second_with_ties(spread, k):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (600, 6))
    c, before = x[:k].copy(), None
    n = len(x)
    first, second, upper, lower = np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n)
    spent = []
    for _ in range(8):
        search = Search(c, before)
        search.assign(x, first, second, upper, lower)
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        assert (first == d.argmin(1)).all()
        true = np.sqrt(d.astype(float))
        others = np.where(np.arange(k)[None] == first[:, None], np.inf, true).min(1)
        assert (upper >= true[np.arange(n), first] * (1 - 1e-9)).all() and (lower <= others * (1 + 1e-9)).all()
        spent.append(search.seen)
        before = c
        c = np.stack([x[first == j].sum(0) // (first == j).sum() if (first == j).any() else c[j] for j in range(k)])
    assert spent[-1] < n * k / 2 or spread <= 3, "bounds must save most distances"


def clusters_of(rows, k, rounds):
    x = np.array([r[1] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), x[i].astype("<i4").tobytes()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        a = d.argmin(1)
        for j in np.unique(a) if r < rounds else ():
            c[j] = x[a == j].sum(0) // (a == j).sum()
    d = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((r[0], int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), sha[a[i]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("n,k", [(400, 40), (30, 40), (50, 1)])
def test_clusters_against_a_plain_model(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(int(i), (rng.integers(-3, 4, 64) / 256 + (i % 5) / 64 + 1 / 512).tolist(), 0) for i in range(n)]
    rows += [(None, rows[1][1], 0), (5, rows[2][1], 0), (5, rows[2][1], 0)]
    bad = [(900, [0.5] * 63, 0), (901, None, 0), (902, [None] * 64, 0), (903, [float("nan")] * 64, 0)]
    ints = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v, _ in rows]
    got = cluster(vectors(spark, rows + bad).repartition(3), clusters=k, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == clusters_of(ints, k, 3)


def test_huge_components_and_empty_tables(spark):
    rows = [(i, [(-1e300 if i % 2 else 1e38)] * 64, 0) for i in range(4)]
    got = cluster(vectors(spark, rows), clusters=2, rounds=1).collect()
    assert len(got) == 4 and all(0 <= r.distance <= LONG_MOST for r in got)
    assert cluster(vectors(spark, rows[:0])).count() == 0
