"""Accuracy, coverage and published numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(log: DataFrame) -> DataFrame:
    """log (index, soll, ist, schritte) → hits, total, share, mean steps in one row."""
    hit = F.col("soll") == F.col("ist")
    return log.agg(
        F.count_if(hit).alias("hits"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("share"),
        F.round(F.avg("schritte"), 1).alias("mean_steps"),
    )


def misses(log: DataFrame) -> DataFrame:
    """Rows that miss their gold label, with the reason given."""
    return log.where(~F.col("soll").eqNullSafe(F.col("ist"))).select(
        "index", "soll", "ist", F.coalesce("reason", F.lit("")).alias("reason")
    )


def confusion(log: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Gold × predicted counts; the label set is given, so no pass over the data finds it."""
    return log.groupBy("soll").agg(
        *[F.count_if(F.col("ist") == label).alias("ist_" + label) for label in labels]
    )


def set_accuracy(rows: DataFrame, expected: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Share of rows whose expected class is among the predicted ones, per group."""
    hit = F.coalesce(F.array_contains(predicted, expected), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("hits"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("share"),
    )


def check_numbers(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, value) against (name, expected): every published number recomputed."""
    return expected.join(found, "name", "left").select(
        "name", "value", "expected", F.col("value").eqNullSafe(F.col("expected")).alias("agrees")
    )


def named_numbers(frames: dict[str, DataFrame]) -> DataFrame:
    """One-value frames under their names."""
    rows = [
        df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("value"))
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def inventory(units: DataFrame, manifest: DataFrame, minimum: int) -> DataFrame:
    """Units per act, a warning flag for thin acts, and the index size."""
    counts = units.groupBy("act").agg(F.count(F.lit(1)).alias("units"))
    return counts.select(
        "act",
        "units",
        (F.col("units") < minimum).alias("thin"),
        manifest.select(F.col("dimensions").cast("string")).scalar().alias("dimensions"),
    )
