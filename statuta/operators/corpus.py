"""Corpus assembly: source precedence, first-wins de-duplication, counts, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """First row per key. The group limit is applied before the shuffle, so a key with very many
    copies sends at most one row per task."""
    ranked = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(ranked)).where("_r = 1").drop("_r")


def duplicate_report(df: DataFrame, key: str = "unit_key", text: str = "text") -> DataFrame:
    """(key, dropped, same): how many rows fall away and whether all of them say the same.

    Digests are compared through their minimum and maximum: fixed-size state per key, combined
    before the shuffle.
    """
    digest = F.xxhash64(text)
    return (
        df.groupBy(key)
        .agg(
            (F.count(F.lit(1)) - 1).alias("dropped"),
            (F.min(digest) == F.max(digest)).alias("same"),
        )
        .where("dropped > 0")
    )


def with_fallback(official: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fallback rows only for acts without any official unit, and only for keys not yet present.

    The list of acts is a handful of names; keys are compared by a shuffled anti-join.
    """
    have = official.select("act").distinct()
    extra = fallback.join(have, "act", "left_anti").join(
        official.select("unit_key"), "unit_key", "left_anti"
    )
    return official.unionByName(extra.select(*official.columns))


def complement(base: DataFrame, extra: DataFrame, key: str = "unit_key") -> DataFrame:
    """Rows of `extra` whose key is not in `base`."""
    return extra.join(base.select(key), key, "left_anti")


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def corpus_counts(units: DataFrame) -> DataFrame:
    """Units and characters per act and kind."""
    return units.groupBy("act", "kind").agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


def split_counts(units: DataFrame) -> DataFrame:
    """Numbers of a split act in one row: articles, their parts, annexes, points, recitals."""
    kind, part = F.col("kind"), F.col("paragraph").isNotNull()
    return units.agg(
        F.count(F.lit(1)).alias("einheiten"),
        F.count_if((kind == "artikel") & ~part).alias("artikel"),
        F.count_if((kind == "artikel") & part).alias("absaetze"),
        F.count_if((kind == "anhang") & ~part).alias("anhang"),
        F.count_if((kind == "anhang") & part).alias("anhangspunkte"),
        F.count_if(kind == "erwaegungsgrund").alias("erwaegungsgrund"),
    )


def build_report(units: DataFrame) -> DataFrame:
    """One JSON row: totals and counts by act and by kind, names in order."""
    counts = corpus_counts(units)

    def by(column: str) -> DataFrame:
        return counts.groupBy(column).agg(F.sum("units").alias("n")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("m")
        )

    total = counts.agg(F.sum("units").alias("u"), F.sum("chars").alias("c"))
    return total.select(
        F.to_json(
            F.struct(
                F.col("u").alias("einheiten"),
                F.col("c").alias("zeichen"),
                by("act").scalar().alias("je_rechtsakt"),
                by("kind").scalar().alias("je_art"),
            )
        ).alias("report")
    )
