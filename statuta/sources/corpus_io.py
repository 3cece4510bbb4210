"""Corpus files and measurement logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.quality import key_problem
from statuta.tables import LOG_DDL, UNITS_DDL


def write_corpus(units: DataFrame, path: str, lines: bool = True) -> None:
    """JSON Lines in key order (range-partitioned, so the order holds across files), or parquet by act."""
    if lines:
        units.orderBy("unit_key").write.mode("overwrite").json(path)
    else:
        units.write.mode("overwrite").partitionBy("act").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid units, rejected rows with a reason). Blank lines are not rows."""
    rows = spark.read.schema(UNITS_DDL + ", _corrupt STRING").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    return validate(rows)


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    reason = (
        F.when(corrupt, "unlesbar")
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, "text_leer")
        .otherwise(key_problem(F.col("unit_key")))
    )
    judged = rows.withColumn("reason", reason)
    valid = judged.where("reason IS NULL").drop("reason", "_corrupt")
    return valid, judged.where("reason IS NOT NULL").select("unit_key", "reason")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def read_logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Measurement logs (JSON arrays), concatenated."""
    return spark.read.schema(LOG_DDL).option("multiLine", True).json(paths)
