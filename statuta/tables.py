"""Table schemas and parquet loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNITS_DDL = (
    "unit_key STRING, act STRING, kind STRING, number STRING, paragraph STRING, title STRING, "
    "chapter STRING, section STRING, text STRING, valid_from DATE, source STRING, as_of DATE, "
    "refs ARRAY<STRING>"
)
ANSWERS_DDL = "case_id BIGINT, question_id STRING, answer STRING, ts TIMESTAMP"
FINDINGS_DDL = "rule STRING, subject STRING, detail STRING"
ARTICLE_JSON_DDL = (
    "einheit STRING, nummer STRING, titel STRING, kapitel STRING, abschnitt STRING, text STRING, "
    "quelle STRING, absaetze ARRAY<STRUCT<nummer: STRING, text: STRING, "
    "buchstaben: ARRAY<STRUCT<buchstabe: STRING, text: STRING>>>>, _corrupt STRING"
)
LOG_DDL = (
    "index INT, soll STRING, ist STRING, getroffen BOOLEAN, schritte INT, fragen INT, "
    "fundstellen ARRAY<STRING>, warum_abweichung STRING, anmerkung STRING"
)


# tables whose rows cost much computing: long texts, pages, cases with a whole questionnaire each
HEAVY = ("documents", "pages", "conversations", "orders")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than cores (one small file).

    A table of many splits, as on a cluster, is left as it is. Filters and column selections still
    reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
