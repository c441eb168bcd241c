"""A corpus from raw documents to token ids: each stage is one operator of ``panelweave.llm`` put to work."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.byte_bpe import encode_documents
from panelweave.llm.common import documents, kept_table
from panelweave.llm.language_id import UNDECIDED, learn, predict
from panelweave.llm.mixture import mix_sources, word_count
from panelweave.llm.order_minhash import digest, near_classes
from panelweave.llm.personal_data import learn as learn_field
from panelweave.llm.personal_data import redact, spans_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.35
MIX_SEED = 23


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters or that no language fits: its mean probability stays below ``LEAST_SCORE``."""
    docs = docs.select(*COLUMNS)
    found = predict(docs, learn(docs), COLUMNS)
    return found.where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id, then smallest digest of its text, of each near-duplicate class; repeated rows of it count once.

    A null id stays only where its class has no other id.
    """
    docs = docs.select(*COLUMNS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    kept = near_classes(docs).groupBy("component").agg(first).select(F.col("first.doc_id").alias("_kept"), F.col("first.node").alias("_node"))
    told = docs.withColumn("_digest", digest("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_node"))
    return told.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    found = spans_of(docs, learn_field(docs), COLUMNS)
    told = found.withColumn("text", redact(F.col("text"), F.col("spans")))
    return told.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over size, whole copies and one more by chance for what is left.

    The chance is a seeded hash of the row, so a source of long documents, each taken at the same ratio, keeps its share
    of words. Rows equal in all columns are one row with a number.
    """
    docs = docs.select(*COLUMNS)
    keys = {"doc_id": "_id", "source": "_source", "size": "_words"}
    taken = mix_sources(docs).where("taken > 0").groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg((F.sum("taken") / F.sum("size")).alias("_ratio"))
    rows = docs.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_size", word_count("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words"))
    due = F.col("_rows") * F.col("_ratio")
    chance = F.pmod(F.xxhash64(F.lit(MIX_SEED), *COLUMNS), F.lit(1 << 53)) / F.lit(float(1 << 53))
    often = rows.join(taken, same).withColumn("_times", (F.floor(due) + (chance < due - F.floor(due)).cast("long")).cast("int")).where("_times > 0")
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids, and whether they decode to the text again."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix", mix),
    ("byte_bpe", byte_bpe),
]

#: Sketches, trained models and merges have no SQL form; ``tests/llm/test_pipeline.py`` holds the stages against models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), name)
    return docs
