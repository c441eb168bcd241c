"""The pipeline's stages, each on what the one before it kept."""

from collections import Counter as Tally

import pytest

import corpus_pipeline
from panelweave.llm.mixture import mix_sources
from panelweave.llm.order_minhash import near_duplicates
from panelweave.llm.personal_data import base_spans

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "12 3 !", "en", None, 6), (-3, "", None, "s", 0)], docs.schema)
    seen = {"raw": docs.unionByName(odd).cache()}
    now = seen["raw"]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, FOLDER).cache()
        assert name == corpus_pipeline.STAGES[-1][0] or now.dtypes == docs.dtypes
        seen[name] = now
    ids = {k: Tally(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert ids["raw"] - ids["language_id"] == Tally([-1, -2, -3])
    groups = near_duplicates(seen["language_id"]).collect()
    assert ids["near_dedup"] == Tally({r.class_id for r in groups}) and len(ids["near_dedup"]) < len(ids["language_id"])
    assert ids["personal_data"] == ids["near_dedup"]
    assert not any(any(base_spans(r.text)) for r in seen["personal_data"].collect())
    assert all(r.n_chars == len(r.text) for r in seen["personal_data"].collect())
    mixed = mix_sources(seen["personal_data"]).collect()
    due = {r.doc_id: r.taken / r["size"] if r["size"] else 0 for r in mixed}
    assert all(abs(ids["mix"][d] - n) < 1 for d, n in due.items()) and ids["mix"].keys() <= due.keys()
    words = {r.doc_id: r["size"] for r in mixed}
    assert sum(ids["mix"][d] * n for d, n in words.items()) == pytest.approx(sum(r.taken for r in mixed), rel=0.2)
    assert ids["byte_bpe"] == ids["mix"] and seen["byte_bpe"].where("not exact").isEmpty()


def test_run_reads_documents(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids", "exact"]


def test_mix_keeps_the_share_of_sources_of_long_documents(spark):
    text = lambda d, n: " ".join(f"w{d}x{k}" for k in range(n))
    rows = [(d, text(d, 380 + d % 40), "en", source, 0) for d, source in enumerate(["a", "b", "c"] * 150)]
    rows += [(None, text(d, 400), "en", "b", 0) for d in range(1000, 1150)]
    rows += [(None, "same words " * 200, "en", "c", 0)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.mix(spark, docs, FOLDER).collect()
    assert {(r.doc_id, r.text) for r in kept} <= {(r[0], r[1]) for r in rows}
    words = Tally()
    for r in kept:
        words[r.source] += len(r.text.split())
    target = {r.source: r.target for r in mix_sources(docs).select("source", "target").distinct().collect()}
    assert set(target) == {"a", "b", "c"} and all(abs(words[s] / t - 1) < 0.2 for s, t in target.items())
    without = [r for r in kept if r.doc_id is None and r.source == "b"]
    assert 0 < len({r.text for r in without}) and corpus_pipeline.mix(spark, docs.repartition(3), FOLDER).count() == len(kept)


def test_one_row_of_each_near_duplicate_class_stays(spark):
    base = {k: [f"{k}{i}" for i in range(60)] for k in "abcd"}
    text = lambda k, *more: " ".join([*base[k], *more])
    rows = [(None, text("a")), (None, text("a", "x")), (None, text("a", "y")), (1, text("b")), (None, text("b", "x")), (None, text("b"))]
    rows += [(2, text("c")), (2, text("c", "x")), (2, text("d")), (3, text("d", "x")), (2, text("d")), (4, text("b", "z"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert Tally((r.doc_id, r.text[0]) for r in kept) == Tally([(None, "a"), (1, "b"), (2, "c"), (2, "d")])
    assert all((r.doc_id, r.text) in rows for r in kept)
