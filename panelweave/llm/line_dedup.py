"""Lines that many documents share stay in one of them; SQL expressions and joins only.

Every batch of documents gives a run: its line hashes in hash order, each with how many documents hold the line and the
largest id among them. Runs lie in levels; when a level has ``fanout`` of them they are merged into one of the next
level. A new batch is merge-anti-joined with the runs: a line that a run already knows to be common, with a larger id
than any of the batch, can change nothing and is left out; the rest becomes the batch's own run. Runs are bucketed and
sorted by hash, so the joins read them in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import kept_table, remove
from panelweave.session import shared_folder

BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long, last long"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, CAPITALS.lower()))


def hashes(key: Column) -> list[Column]:
    """128 bits by which two keys are taken for the same."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(11), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, last) in the shared folder."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.levels: list[list[tuple[str, str]]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = shared_folder(self.spark, "line_run")
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Runs are read as plain files here: a union of bucketed scans groups wrongly in Spark 4.1."""
        rows = self.spark.read.schema(RUN).parquet(*[path for _, path in runs])
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def _all(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """A batch of (h1, h2, doc): no document may lie in two batches."""
        held = lines.groupBy(*HASH, "doc").agg(F.lit(1).alias("_one"))
        own = held.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
        for name, _ in self._all():
            settled = self.spark.table(name).where(F.col("docs") >= self.least_docs).select(*HASH, F.col("last").alias("_last")).hint("merge")
            same = [own[h] == settled[h] for h in HASH]
            own = own.join(settled, [*same, own["last"] <= settled["_last"]], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(own))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._merged(level)))
            self.levels[k] = []
            self._drop(level)

    def common(self) -> DataFrame:
        """(h1, h2, last) of lines that at least ``least_docs`` documents hold."""
        return self._merged(self._all()).where(F.col("docs") >= self.least_docs).select(*HASH, "last")

    def close(self) -> None:
        self._drop(self._all())
        self.levels = []


def _told(docs: DataFrame) -> DataFrame:
    """Documents with ``doc``, their place in id order (none first), and two hashes that tell rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(F.col("doc_id"), text.alias("text"), place.alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(5), text).alias("t2"))


ROW = ["doc", "t1", "t2"]


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row.

    A line's key is ``line_key``; keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose
    their lines everywhere but in the document of largest id. Rows of one id are one document: they count once, and all
    of them keep what it keeps. Rows without id are one document before all others. A null or empty text is one empty
    line. A line may stand in a text many times: all of them go, or all stay. An empty table gives an empty result.

    Batches go from large ids to small, so that what is common by then is settled with its last holder.
    """
    spark = docs.sparkSession
    told = _told(docs)
    cuts = [b for b in told.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []]
    number = sum([(F.col("doc") <= F.lit(b).cast("long")).cast("int") for b in sorted(set(cuts))], F.lit(0))
    lines = told.select(*ROW, number.alias("batch"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(*ROW, "batch", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    path = shared_folder(spark, "line_hashes")
    lines.select(*ROW, "pos", *hashes(F.col("key")), "batch").write.parquet(path)
    lines = spark.read.schema("doc long, t1 long, t2 long, pos int, h1 long, h2 long, batch int").parquet(path)

    runs = LineRuns(spark, least_docs, fanout)
    for b in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == b))
    common = kept_table(runs.common(), "common_lines")
    runs.close()
    gone = lines.join(common, HASH).where("doc <> last").groupBy(*ROW).agg(F.collect_set("pos").alias("gone"))
    gone = kept_table(gone, "dropped_lines")
    remove(spark, path)

    split = F.split("text", "\n")
    left = told.join(gone, ROW, "left").withColumn("_lines", split)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    return left.select(
        "doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
