"""Comparing two sources, two measurements, two implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(unit_key, status): same, different, only_left, only_right. Digests travel, not texts."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select("unit_key", F.xxhash64("text").alias(name), F.lit(True).alias(name + "_in"))

    joined = digest(left, "l").join(digest(right, "r"), "unit_key", "full_outer")
    status = (
        F.when(F.col("r_in").isNull(), "only_left")
        .when(F.col("l_in").isNull(), "only_right")
        .when(F.col("l").eqNullSafe(F.col("r")), "same")
        .otherwise("different")
    )
    return joined.select("unit_key", status.alias("status"))


def overlay(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """The later measurement replaces the earlier one row by row."""
    columns = [c for c in base.columns if c != key]
    renamed = update.select(key, F.lit(True).alias("_new"), *[F.col(c).alias("_" + c) for c in columns])
    joined = base.join(renamed, key, "full_outer")
    return joined.select(
        key, *[F.when(F.col("_new"), F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in columns]
    )


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, status, step): the first step at which two traces part, then the class."""
    joined = left.select("case_id", F.col("class").alias("lc"), F.col("trace").alias("lt")).join(
        right.select("case_id", F.col("class").alias("rc"), F.col("trace").alias("rt")),
        "case_id",
        "full_outer",
    )
    apart = F.filter(
        F.transform(
            F.zip_with("lt", "rt", lambda a, b: ~a.eqNullSafe(b)), lambda d, i: F.when(d, i + 1)
        ),
        lambda i: i.isNotNull(),
    )
    step = F.try_element_at(apart, F.lit(1))
    return joined.select(
        "case_id",
        F.when(F.col("lt").isNull() | F.col("rt").isNull(), "missing")
        .when(step.isNotNull(), "path")
        .when(~F.col("lc").eqNullSafe(F.col("rc")), "class")
        .otherwise("same")
        .alias("status"),
        step.alias("step"),
    )


def first_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Long traces (run, step, value): per run the first step whose values differ."""
    joined = left.select("run", "step", F.col("value").alias("l")).join(
        right.select("run", "step", F.col("value").alias("r")), ["run", "step"], "full_outer"
    )
    return (
        joined.where(~F.col("l").eqNullSafe(F.col("r")))
        .groupBy("run")
        .agg(F.min("step").alias("step"), F.count(F.lit(1)).alias("differing"))
    )
