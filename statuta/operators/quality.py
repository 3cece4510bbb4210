"""Quality findings: long tables (rule, subject, detail) of what a corpus or catalogue violates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the agreed forms of a unit key ----------------------------
KEY_FORMS = (
    r"^(?:KI-VO|DSGVO)/art-\d{1,3}(?:/(?:abs-\d{1,2}(?:-(?:ua\d+-)?[a-z])?|nr-\d{1,3}))?$",
    r"^KI-VO/anh-[IVXLC]+(?:/nr-[0-9A-Za-z-]+)?$",
    r"^(?:KI-VO|DSGVO)/erw-\d{1,3}$",
    r"^BDSG/par-\d{1,3}[a-z]?(?:/abs-\d{1,2})?$",
    r"^fall/\S+$",
    r"^Leitlinie/\S+$",
)


def key_problem(key: Column) -> Column:
    """Name of the first form rule a key breaks, else NULL."""
    return (
        F.when(key.isNull() | (F.length(key) < 3), "zu_kurz")
        .when(F.length(key) > 120, "zu_lang")
        .when(key.rlike(r"\s"), "leerzeichen")
        .when(~F.contains(key, F.lit("/")), "ohne_trenner")
        .when(~key.rlike("|".join(KEY_FORMS)), "form")
    )


def key_findings(units: DataFrame) -> DataFrame:
    return units.select(
        F.concat(F.lit("schluessel_"), key_problem(F.col("unit_key"))).alias("rule"),
        F.col("unit_key").alias("subject"),
    ).where("rule IS NOT NULL")


def row_findings(units: DataFrame, markers: tuple[str, ...], minimum: int = 10) -> DataFrame:
    """Empty or tiny text, boilerplate left in the text, missing source, duplicate key."""
    text, source = F.col("text"), F.col("source")
    checks = F.array_compact(
        F.array(
            F.when(text.isNull() | (F.length(F.trim(text)) == 0), "text_leer"),
            F.when(F.length(text).between(1, minimum - 1), "text_winzig"),
            F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers]), "beiwerk"),
            F.when(source.isNull() | (source == ""), "ohne_quelle"),
        )
    )
    rows = units.select(F.explode(checks).alias("rule"), F.col("unit_key").alias("subject"))
    doubled = (
        units.groupBy("unit_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("doppelt").alias("rule"), F.col("unit_key").alias("subject"))
    )
    return rows.unionByName(doubled)


def expected_counts(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that differ from an expected, non-zero number."""
    return (
        expected.join(counts, keys, "left")
        .withColumn("found", F.coalesce("units", F.lit(0)))
        .where("expected <> 0 AND found <> expected")
        .select(*keys, "found", "expected")
    )


def unresolved(citations: DataFrame, units: DataFrame, key: str = "unit_key") -> DataFrame:
    """Citations (… , unit_key) that no unit carries."""
    return citations.join(units.select(key), key, "left_anti")


def orphans(units: DataFrame) -> DataFrame:
    """Sub-units whose stem is missing."""
    stem = F.array_join(F.slice(F.split("unit_key", "/"), 1, 2), "/")
    parts = units.where(F.size(F.split("unit_key", "/")) > 2).select("unit_key", stem.alias("stem"))
    stems = units.where(F.size(F.split("unit_key", "/")) == 2).select(F.col("unit_key").alias("stem"))
    return parts.join(stems, "stem", "left_anti")


def catalogue_findings(entries: DataFrame, lines: DataFrame, rules: DataFrame) -> DataFrame:
    """entries (entry, class, rule), lines (entry, text), rules (class, rule): missing fields,
    entries without a line, doubled lines, unknown class/rule pairs."""
    missing = entries.where("class IS NULL OR class = '' OR rule IS NULL OR rule = ''").select(
        F.lit("feld_fehlt").alias("rule_id"), F.col("entry").alias("subject")
    )
    empty = entries.join(lines.select("entry"), "entry", "left_anti").select(
        F.lit("ohne_zweck").alias("rule_id"), F.col("entry").alias("subject")
    )
    doubled = (
        lines.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("subject"))
        .where("n > 1").select(F.lit("satz_doppelt").alias("rule_id"), "subject")
    )
    unknown = entries.join(rules, ["class", "rule"], "left_anti").select(
        F.lit("regel_unbekannt").alias("rule_id"), F.col("entry").alias("subject")
    )
    return missing.unionByName(empty).unionByName(doubled).unionByName(unknown)


def coverage_findings(gold: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """gold (index, soll, hit, reason): gaps, repeats, misses without a reason, unknown labels.

    The expected indices are made by `range`, not collected.
    """
    spark = gold.sparkSession
    size = gold.agg(F.coalesce(F.max("index") + 1, F.lit(0)).cast("bigint").alias("n")).first()["n"]
    wanted = spark.range(size).withColumnRenamed("id", "index")
    gap = wanted.join(gold.select(F.col("index").cast("bigint").alias("index")), "index", "left_anti").select(
        F.lit("luecke").alias("rule"), F.col("index").cast("string").alias("subject")
    )
    repeat = gold.groupBy("index").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("doppelt").alias("rule"), F.col("index").cast("string").alias("subject")
    )
    silent = gold.where("NOT hit AND coalesce(reason, '') = ''").select(
        F.lit("ohne_grund").alias("rule"), F.col("index").cast("string").alias("subject")
    )
    strange = gold.where(~F.col("soll").isin(*labels)).select(
        F.lit("soll_unbekannt").alias("rule"), F.col("index").cast("string").alias("subject")
    )
    return gap.unionByName(repeat).unionByName(silent).unionByName(strange)


def dead_fields(conditions: DataFrame, known: DataFrame) -> DataFrame:
    """Fields a condition names but nothing can ever set: conditions (rule, field), known (field)."""
    return conditions.join(known, "field", "left_anti").select("rule", "field")
