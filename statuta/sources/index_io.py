"""The search index as tables: building, resuming, storing, guarded loading."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.text import settled
from statuta.operators.bm25 import counted_texts, postings, saturation, totals
from statuta.operators.encode import Encoder, encode, hashing_dense
from statuta.operators.scale import BROADCAST_ROWS
from statuta.plans.search import searchable


def content_hash(text: str = "text"):
    return F.md5(F.col(text).cast("binary"))


def pending(units: DataFrame, written: DataFrame, model: str) -> DataFrame:
    """Units whose (key, content, model) has no vector yet: what a resumed build still has to do."""
    live = units.withColumn("content", content_hash()).withColumn("model", F.lit(model))
    return live.join(
        written.select("unit_key", "content", "model"), ["unit_key", "content", "model"], "left_anti"
    )


def manifest(units: DataFrame, model: str, dimensions: int) -> DataFrame:
    """One row: model, size, and an order-free digest of the keys.

    Sums of hashes are combined in parallel; no list of all keys is ever built.
    """
    return units.agg(
        F.lit(model).alias("model"),
        F.lit(dimensions).alias("dimensions"),
        F.count(F.lit(1)).alias("units"),
        F.sum(F.xxhash64("unit_key").cast("decimal(38,0)")).cast("string").alias("key_sum"),
        F.bit_xor(F.xxhash64(F.reverse("unit_key"))).alias("key_xor"),
    )


def key_differences(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(unit_key, side) of keys that only one side has; repeated keys count."""
    a, b = stored.select("unit_key"), live.select("unit_key")
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("live"))
    )


#: Postings in a part, about; a part is one folder and one file, ordered by word and unit.
PART = 2_000_000
#: Parts up to which they are named in the plan; beyond, the order of the words alone prunes.
PARTS = 10_000
TF_DDL = "unit_key STRING, word STRING, tf BIGINT, len INT, part INT"
#: Words up to which the scan's filter lists them.
IN_PLAN = 5_000


@dataclass(frozen=True)
class Index:
    vectors: DataFrame
    tf: DataFrame  # part, word, unit_key, tf, len: by part, ordered by word and unit
    blocks: DataFrame  # word, part, n, first_unit, last_unit, impact: one row a word and part
    totals: DataFrame
    manifest: DataFrame

    def postings(self, asked: list[str] | None) -> DataFrame:
        """(unit_key, word, tf, len) of the asked words, read from the parts that hold them; all without a list.

        The blocks name the parts, so other files are not opened; inside a part the words are ordered, so
        only the row groups whose range meets an asked word are decoded.
        """
        columns = ["unit_key", "word", "tf", "len"]
        if asked is None:
            return self.tf.select(columns)
        if len(asked) > IN_PLAN:
            words = self.tf.sparkSession.createDataFrame([(w,) for w in asked], "word string")
            return self.tf.join(F.broadcast(words), "word", "left_semi").select(columns)
        wanted = F.col("word").isin(asked)
        parts = self.blocks.where(wanted).select("part").distinct().limit(PARTS + 1).collect()
        rows = self.tf.where(wanted)
        if len(parts) <= PARTS:
            rows = rows.where(F.col("part").isin([r["part"] for r in parts]))
        return rows.select(columns)

    @property
    def df(self) -> DataFrame:
        """(word, df), from the blocks alone."""
        return self.blocks.groupBy("word").agg(F.sum("n").alias("df"))


def write_postings(spark: SparkSession, units: DataFrame, path: str, part: int = PART) -> None:
    """Postings ordered by word, the blocks of every word, and the totals, from one pass over the texts.

    A word that many units hold goes on through several parts, split by unit; a block tells its first and
    last unit, its postings and the most that one of them can add to a score.
    """
    rows = _written(counted_texts(units, "text"), f"{path}/_words")
    totals(rows).write.mode("overwrite").parquet(f"{path}/totals")
    row = spark.read.parquet(f"{path}/totals").first()
    parts = max(1, math.ceil((row["words"] or 0) / part))
    ordered = postings(rows).repartitionByRange(parts, "word", "unit_key").sortWithinPartitions("word", "unit_key")
    ordered.select("unit_key", "word", F.col("tf").cast("bigint"), F.col("len").cast("int"), F.spark_partition_id().alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/tf")
    impact = saturation(F.col("tf"), F.col("len"), F.lit(row["avg_len"] or 1.0))
    blocks = (
        spark.read.schema(TF_DDL).parquet(f"{path}/tf").groupBy("word", "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("unit_key").alias("first_unit"),
            F.max("unit_key").alias("last_unit"),
            F.max(impact).alias("impact"),
        )
    )
    blocks.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/blocks")
    _drop(spark, f"{path}/_words")


def build_index(spark: SparkSession, units: DataFrame, path: str, encoder: Encoder | None = None, part: int = PART) -> None:
    """Compute what is missing and write all tables, over the searched text (citation, title, chapter, text).

    Vectors are appended, so a run that was cut short continues where it stopped; term statistics are
    rewritten from the texts. Composed texts and counted words lie beside the tables while these are made."""
    units = _written(searchable(units).select("unit_key", settled(F.col("text")).alias("text")), f"{path}/_texts")
    model = encoder.name if encoder else "hashing-256"
    size = encoder.dimensions if encoder else 256
    target = f"{path}/vectors"
    if _exists(spark, target):
        todo = pending(units, spark.read.parquet(target), model)
    else:
        todo = units.withColumn("content", content_hash()).withColumn("model", F.lit(model))
    if encoder:
        coded = todo.select("unit_key", "content", "model").join(encode(todo, "unit_key", "text", encoder), "unit_key")
    else:  # what belongs to a vector passes the encoder with the key, so no vector is exchanged
        named = todo.select(F.struct("unit_key", "content", "model").alias("row"), "text")
        coded = hashing_dense(named, "row", "text").select("row.*", "embedding")
    coded.write.mode("append").parquet(target)
    write_postings(spark, units, path, part)
    manifest(units, model, size).write.mode("overwrite").parquet(f"{path}/manifest")
    _drop(spark, f"{path}/_texts")


def load_index(spark: SparkSession, path: str, units: DataFrame, model: str) -> Index:
    """Refuses an index of another model or another corpus, naming the first three keys apart."""
    stored = spark.read.parquet(f"{path}/manifest")
    row = stored.first()
    if row["model"] != model:
        raise ValueError(f"index was built with {row['model']}, not {model}")
    live = manifest(units, model, row["dimensions"]).first()
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("model") == model)
    if row != live:
        apart = key_differences(vectors, units).select("unit_key").distinct().orderBy("unit_key").limit(3)
        first = ", ".join(r["unit_key"] for r in apart.collect())
        raise ValueError(f"index belongs to another corpus: {row['units']} / {live['units']} units, first {first}")
    current = searchable(units).select("unit_key", content_hash().alias("content"))
    return Index(
        _current(vectors, current),
        spark.read.schema(TF_DDL).parquet(f"{path}/tf"),
        spark.read.parquet(f"{path}/blocks"),
        spark.read.parquet(f"{path}/totals"),
        stored,
    )


def _current(vectors: DataFrame, current: DataFrame) -> DataFrame:
    """The vectors whose key and content are those of a unit. Only keys are exchanged to find the others."""
    keys = ["unit_key", "content"]
    other = vectors.select(keys).join(current, keys, "left_anti").distinct()
    known = vectors.where("unit_key IS NOT NULL AND content IS NOT NULL")
    some = other.limit(BROADCAST_ROWS + 1).count()
    if some > BROADCAST_ROWS:
        return vectors.join(current, keys, "left_semi")
    return known.join(F.broadcast(other), keys, "left_anti") if some else known


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _located(spark, path)
    return files.exists(target)


def _drop(spark: SparkSession, path: str) -> None:
    files, target = _located(spark, path)
    files.delete(target, True)
