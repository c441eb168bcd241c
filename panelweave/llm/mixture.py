"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are shares of the whole size, stopped at a multiple of the source. The whole size is a number of equal blocks, of
which even the smallest target holds many; sources get blocks by highest quotients, then each source's blocks go to its
shards in the same way. A shard orders its documents by a seeded hash, which makes one stream of words, and cuts it into
equal pieces. It takes whole passes first, then pieces by seeded rank, the last in part, until its quota is filled.
Sources are split into shards of some thousand documents, so no source is worked on by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, kept_table

PIECES_PER_SHARD = 512
#: So many blocks the smallest target has, unless a block would be less than a word.
BLOCKS_OF_LEAST = 64


def word_count(text: str) -> Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def highest_quotients(votes: DataFrame, keys: list[str], vote: str, seats: str, order: list[Column]) -> DataFrame:
    """Add ``quota``: seats by Sainte-Laguë within ``keys``, ties by ``order``.

    Of v/1, v/3, v/5, ... the ``seats`` highest of a group win. With q the exact share of seats and n rivals, a rival's
    result lies within q -/+ (q share * n + 1) / 2, so only the quotients of that range, n in all beside two for each
    rival, are ranked; what lies below is certain.
    """
    group = Window.partitionBy(*keys)
    share = F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(0.0)
    ranged = (
        votes.withColumn("_all", F.sum(vote).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_reach", F.ceil((share * F.col("_n") + 1) / 2) + 1)
        .withColumn("_sure", F.greatest(F.lit(0), F.round(share * F.col(seats)).cast("long") - F.col("_reach")))
    )
    free = F.col(seats) - F.sum("_sure").over(group)
    tried = ranged.withColumn("_free", free).withColumn("_seat", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + 2 * F.col("_reach"))))
    ranked = tried.where(F.col(vote) > 0).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy((F.col(vote) / (2 * F.col("_seat") + 1)).desc(), *order, "_seat")))
    return ranked.groupBy(*votes.columns).agg((F.first("_sure") + F.count(F.when(F.col("_rank") <= F.col("_free"), 1))).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, n_docs, weight, target): weights repeat over sources by code point, null last.

    A target stops at ``most`` times its source; what it leaves is shared by weight among those below their stop. Each
    round stops every source above its bound; only two sums come to the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cycle = F.array(*map(F.lit, map(float, weights)))
    sources = kept_table(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))),
        "sources",
    )
    stop = F.col("source_size") * F.lit(float(most))
    whole, rate = sources.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        full = stop <= F.col("weight") * F.lit(rate)
        taken, open_ = sources.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        following = (whole - (taken or 0.0)) / open_ if open_ else rate
        if following <= rate:
            return sources.withColumn("target", F.least(stop, F.col("weight") * F.lit(max(rate, 0.0))))
        rate = following


def _topped_up(taken: Column, spans: Column, whole: Column, left: Column) -> Column:
    """``taken`` and what is ``left`` of the quota, from the next one or two pieces: only the last piece is shorter than others."""
    first, second = F.get(spans, whole), F.get(spans, whole + 1)
    some = F.least(left, first.b - first.a)
    more = F.array(F.struct(first.a.alias("a"), (first.a + some).alias("b")), F.struct(second.a.alias("a"), (second.a + left - some).alias("b")))
    return F.concat(taken, F.filter(more, lambda x: x.b > x.a))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, shard_docs: int = 2048) -> DataFrame:
    """(doc_id, size, source_size, target, taken, ...): words of each document the mix takes, repeats counted.

    ``size`` counts the words of a text (null: 0). ``taken`` lies between 0 and ``most`` times ``size``; a document at
    the border of a piece may be taken in part. Null sources are one source, last in order. Repeated rows are rows of
    their own; rows equal in id and size are interchangeable, so a rerun gives the same result. Other columns are
    ignored; an empty table gives an empty result. ``weights`` must be positive.
    """
    sizes = kept_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size")), "sizes")
    sources = source_targets(sizes, weights, most)
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs))
    n_shards, whole, least = sources.agg(F.sum(shards_of), F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, int((least or 0.0) / BLOCKS_OF_LEAST))
    piece = max(1, int((whole or 0.0) / ((n_shards or 1) * PIECES_PER_SHARD)))
    seats = sources.withColumn("_blocks", F.lit(round((whole or 0.0) / block)).cast("long"))
    quotas = highest_quotients(seats, [], "target", "_blocks", [F.col("source").isNull(), F.col("source")])
    plan = kept_table(
        sources.alias("s").join(quotas.select(F.col("source").alias("_source"), "quota"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        .select(F.col("source").alias("_source"), "source_size", "target", shards_of.alias("shards"), F.coalesce("quota", F.lit(0)).alias("source_quota")),
        "plan",
    )
    draw = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = sizes.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(draw, F.col("shards"))).drop("_source", "shards")
    cells = dealt.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    shared = highest_quotients(cells, ["source"], "words", "source_quota", [F.xxhash64(F.lit(seed), "shard")])
    budget = F.least(F.col("quota") * block, F.col("words") * most)
    filled = (
        shared.withColumn("passes", F.floor(budget / F.col("words")))
        .withColumn("left", budget - F.col("passes") * F.col("words"))
        .withColumn("length", F.ceil(F.col("words") / F.greatest(F.lit(1), F.round(F.col("words") / F.lit(piece)))))
        .withColumn("pieces", F.ceil(F.col("words") / F.col("length")).cast("int")).withColumn("whole", F.floor(F.col("left") / F.col("length")).cast("int"))
    )
    by_hash = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("shard"), j).alias("h"), j.cast("long").alias("j")))
    spans = F.transform(F.array_sort(by_hash), lambda x: F.struct((x.j * F.col("length")).alias("a"), F.least((x.j + 1) * F.col("length"), "words").alias("b")))
    drawn = filled.withColumn("spans", spans).withColumn("taken", F.slice("spans", F.lit(1), F.col("whole")))
    drawn = drawn.withColumn("left", F.col("left") - F.aggregate("taken", F.lit(0).cast("long"), lambda n, x: n + x.b - x.a))
    chosen = drawn.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "passes", _topped_up(F.col("taken"), F.col("spans"), F.col("whole"), F.col("left")).alias("chosen"))
    ahead = Window.partitionBy("source", "shard").orderBy(draw, "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_to", F.sum("size").over(ahead)).withColumn("_from", F.col("_to") - F.col("size"))
    joined = placed.join(chosen, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")
    part = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.col("_to"), x.b) - F.greatest(F.col("_from"), x.a))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    inside = F.aggregate(F.coalesce("chosen", none), F.lit(0).cast("long"), lambda n, x: n + part(x))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.coalesce("passes", F.lit(0)) * F.col("size") + inside).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard")
