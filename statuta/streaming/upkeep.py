"""Incremental index upkeep: a store of segments in key buckets that are merged by and by.

Each batch is written as one segment, its rows dealt to buckets by a hash of the key. `FAN` segments of one
size are merged into one of `FAN` times the buckets, so a bucket keeps its size however large the store is.
A batch reads the buckets its keys fall into and no others: at most (keys of the batch) x (rows a bucket) x
`FAN` for each size, and the sizes number the logarithm of the batches. A row is rewritten once a size.

A row holds all of a unit: digest, vector, and its words with their counts in one list. A batch makes it from the
text in one pass and writes it where it stands; its document frequencies are then read from what was written. They
are kept as differences: a batch adds one for each word of a new text and takes one off for each word of the text
it replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.constants import HASH_BUCKETS
from statuta.functions.text import FOLDED
from statuta.operators.bm25 import postings, text_counts
from statuta.operators.encode import ROWS, dense_lists
from statuta.sources.index_io import content_hash

MODEL = "hashing-256"
#: Buckets of a fresh segment, and segments of one size that are merged into the next.
BUCKETS, FAN = 4, 4
#: Tasks a core in which the rows of a batch are made.
TASKS = 3
#: Buckets up to which a batch names those it reads.
LISTED = 10_000

_PLACE = ", buckets INT, first BIGINT, last BIGINT"
TABLES = {
    "units": "unit_key STRING, content STRING, version BIGINT, replaced BIGINT, embedding ARRAY<DOUBLE>, len INT, "
    "hits ARRAY<STRUCT<word: STRING, tf: BIGINT>>" + _PLACE + ", bucket INT",
    "df": "word STRING, df BIGINT" + _PLACE,
}
ROW = ("unit_key", "content", "version", "replaced", "embedding", "len", "hits")


@dataclass(frozen=True, order=True)
class Segment:
    """All batches from the version `first` to `last`."""

    buckets: int
    first: int
    last: int

    def folder(self, path: str, table: str) -> str:
        return f"{path}/{table}/buckets={self.buckets}/first={self.first}/last={self.last}"

    def mark(self, path: str) -> str:
        return f"{path}/segments/{self.buckets}_{self.first}_{self.last}"

    def covers(self, other: Segment) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


def _located(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _marked(spark: SparkSession, path: str) -> list[Segment]:
    """Segments that were written to their end, merged ones and their parts alike."""
    files, folder = _located(spark, f"{path}/segments")
    if not files.exists(folder):
        return []
    return sorted(Segment(*map(int, f.getPath().getName().split("_"))) for f in files.listStatus(folder))


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """Segments that count: those that were not merged into another one."""
    found = _marked(spark, path)
    return [s for s in found if not any(t.covers(s) for t in found)]


def _read(spark: SparkSession, path: str, table: str, chosen: list[Segment]) -> DataFrame:
    reader = spark.read.schema(TABLES[table]).option("basePath", f"{path}/{table}")
    if not chosen:
        return spark.createDataFrame([], TABLES[table])
    return reader.parquet(*[s.folder(path, table) for s in chosen])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("unit_key"), F.lit(buckets)).cast("int")


def _split(spark: SparkSession, buckets: int):
    """A part of a bucket, so that there is work for all cores however few the buckets are."""
    parts = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / buckets))
    return F.pmod(F.shiftright(F.xxhash64("unit_key"), 32), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, segment: Segment) -> None:
    """The units of a segment, in its buckets; rows are written by the tasks that have them."""
    placed = rows.select(*ROW, _bucket(segment.buckets).alias("bucket"))
    placed.sortWithinPartitions("bucket", "unit_key").write.mode("overwrite").partitionBy("bucket").parquet(segment.folder(path, "units"))


def _finish(df: DataFrame, path: str, segment: Segment) -> None:
    """The differences of a segment; it counts from its mark on, which is made last."""
    df.select("word", "df").write.mode("overwrite").parquet(segment.folder(path, "df"))
    files, mark = _located(df.sparkSession, segment.mark(path))
    files.create(mark).close()


def _newest(units: DataFrame, *place: str) -> DataFrame:
    """The newest row of every unit; `place` are columns that follow from its key and by which the rows lie together."""
    order = W.partitionBy(*place, "unit_key").orderBy(F.desc("version"))
    return units.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def merge(spark: SparkSession, path: str) -> None:
    """Merge sizes that have `FAN` segments; parts of earlier merges go, those of this one still stay.

    Readers that have listed the store keep their files until the next call.
    """
    found = _marked(spark, path)
    for old in found:
        if any(s.covers(old) for s in found):
            for place in (old.mark(path), *(old.folder(path, table) for table in TABLES)):
                files, target = _located(spark, place)
                files.delete(target, True)
    while True:
        sizes: dict[int, list[Segment]] = {}
        for s in segments(spark, path):
            sizes.setdefault(s.buckets, []).append(s)
        full = [group for _, group in sorted(sizes.items()) if len(group) >= FAN]
        if not full:
            return
        parts = full[0]
        whole = Segment(parts[0].buckets * FAN, min(s.first for s in parts), max(s.last for s in parts))
        units = _read(spark, path, "units", parts).withColumn("bucket", _bucket(whole.buckets))
        units = units.withColumn("split", _split(spark, whole.buckets)).repartition("bucket", "split")
        _write(_newest(units, "bucket", "split"), path, whole)
        _finish(_read(spark, path, "df", parts).groupBy("word").agg(F.sum("df").alias("df")).where("df != 0"), path, whole)


def met(spark: SparkSession, path: str, table: str, keys: DataFrame) -> DataFrame:
    """Rows of a table in the buckets that the keys (unit_key) fall into; other buckets are not opened.

    Numbers of buckets divide one another, so the buckets of the largest size tell those of the others.
    """
    chosen = segments(spark, path)
    rows = _read(spark, path, table, chosen)
    if not chosen:
        return rows
    sizes = sorted({s.buckets for s in chosen})
    listed = keys.select(_bucket(sizes[-1]).alias("b")).distinct().limit(LISTED + 1).collect()
    if len(listed) > LISTED:
        return rows
    numbers = {size: sorted({r["b"] % size for r in listed}) for size in sizes}
    return rows.where(reduce(lambda a, b: a | b, [(F.col("buckets") == n) & F.col("bucket").isin(of) for n, of in numbers.items()]))


def _made(named: DataFrame) -> DataFrame:
    """(row, text) → (row, embedding, len, hits), from one reading of the text; what belongs to a unit passes along."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                row, texts = batch.slice(at, ROWS).columns
                folded = reduce(lambda t, pair: pc.replace_substring(t, *pair), FOLDED, texts)
                sizes, hits = map(pa.concat_arrays, zip(*text_counts(folded)))
                yield pa.RecordBatch.from_arrays([row, dense_lists(texts, HASH_BUCKETS, known), sizes, hits], ["row", "embedding", "len", "hits"])

    kind = named.schema["row"].dataType.simpleString()
    return named.select("row", F.lower("text").alias("text")).mapInArrow(
        make, f"row {kind}, embedding ARRAY<DOUBLE>, len INT, hits ARRAY<STRUCT<word: STRING, tf: BIGINT>>"
    )


def add_units(units: DataFrame, path: str, version: int) -> None:
    """Add the units (unit_key, text) whose newest stored form is another one, as the segment `version`.

    Versions grow with each batch (a stream passes its batch id). A batch that broke off has no mark and is
    written again, whole; one that has its mark changes nothing when it is repeated, also after a merge.
    Of several texts of a unit in one batch the greatest is kept, so that a repeat chooses the same. A null
    text is a text without words; rows without a key are left out, as no later batch could replace them.
    """
    spark = units.sparkSession
    if any(s.first <= version <= s.last for s in _marked(spark, path)):
        return
    merge(spark, path)
    segment, units = Segment(BUCKETS, version, version), units.where("unit_key IS NOT NULL")
    # a number of tasks of its own: making the rows is long work, also where the texts are few bytes
    dealt = units.repartition(TASKS * spark.sparkContext.defaultParallelism, "unit_key")
    given = dealt.groupBy("unit_key").agg(F.max("text").alias("text")).withColumn("content", F.coalesce(content_hash(), F.lit("")))
    stored = met(spark, path, "units", units).groupBy("unit_key").agg(F.max_by(F.struct("content", "version"), "version").alias("held"))
    live = given.join(stored, "unit_key", "left").where("held IS NULL OR held.content != content")
    named = live.select(F.struct("unit_key", "content", F.col("held.version").alias("replaced")).alias("row"), "text")
    _write(_made(named).select("row.*", F.lit(version).cast("bigint").alias("version"), "embedding", "len", "hits"), path, segment)
    written = _read(spark, path, "units", [segment])
    gone = written.where("replaced IS NOT NULL").select("unit_key", F.col("replaced").alias("version"))
    out = met(spark, path, "units", gone).join(gone, ["unit_key", "version"], "left_semi")
    changes = postings(written).select("word", F.lit(1).alias("n")).unionByName(postings(out).select("word", F.lit(-1).alias("n")))
    _finish(changes.groupBy("word").agg(F.sum("n").alias("df")).where("df != 0"), path, segment)


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of the newest version of every unit: its digest and vector (`units`), or its words (`tf`)."""
    rows = _newest(_read(spark, path, "units", segments(spark, path)))
    if table == "units":
        return rows.select("unit_key", "content", "version", "embedding")
    return rows.select("unit_key", "version", "len", F.explode("hits").alias("h")).select("unit_key", "version", "h.word", "h.tf", "len")


def document_frequency(spark: SparkSession, path: str) -> DataFrame:
    """(word, df) from the stored differences, never from texts or term counts."""
    return _read(spark, path, "df", segments(spark, path)).groupBy("word").agg(F.sum("df").alias("df")).where("df > 0")


def maintain(stream: DataFrame, path: str) -> None:
    """Drain a stream of units into the store; store and checkpoint belong together."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: add_units(batch, path, batch_id))
        .option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
