"""Descriptions: derived roles and budgets, explicit attributes, how much is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.citations import compute_budget, roles_from_text
from statuta.functions.text import parse_truth, strip

BOOLEANS = (*K.BOOLEAN_FIELDS, *K.EXTRA_BOOLEAN_FIELDS)


def describe(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, free_text, roles, flop) from free text; every other attribute unknown."""
    flat = strip(F.regexp_replace(F.col(text), r"\s+", " "))
    return df.select(
        key,
        F.substring(flat, 1, K.MAX_DESCRIPTION).alias("free_text"),
        roles_from_text(flat).alias("roles"),
        compute_budget(flat).alias("rechenaufwand_flop"),
        *[F.lit("").alias(f) for f in K.TEXT_FIELDS],
        *[F.lit(None).cast("boolean").alias(f) for f in BOOLEANS],
        F.lit(None).cast("int").alias("anzahl_beschaeftigte"),
        F.lit("").alias("markt"),
    )


def latest_attributes(attributes: DataFrame, key: str) -> DataFrame:
    """One value per (key, name): the last one by ts."""
    order = W.partitionBy(key, "name").orderBy(F.desc("ts"), F.desc("value"))
    return attributes.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pivot_attributes(attributes: DataFrame, key: str) -> DataFrame:
    """Long (key, name, value) → one row per key with typed columns and the names nobody knows.

    A single aggregation with one conditional maximum per known field; unknown names, and numbers
    that do not parse, come back sorted and distinct.
    """
    name, value = F.col("name"), F.col("value")
    known = (*BOOLEANS, *K.TEXT_FIELDS, "rechenaufwand_flop", "anzahl_beschaeftigte", "markt", "rollen")
    number = value.try_cast("double")
    bad_number = name.isin("rechenaufwand_flop", "anzahl_beschaeftigte") & number.isNull()
    return attributes.groupBy(key).agg(
        *[F.bool_or(F.when(name == f, parse_truth(value))).alias(f) for f in BOOLEANS],
        *[
            F.max(F.when((name == f) & (value != ""), F.substring(value, 1, 500))).alias(f)
            for f in (*K.TEXT_FIELDS, "markt")
        ],
        F.max(F.when(name == "rechenaufwand_flop", number)).alias("rechenaufwand_flop"),
        F.max(F.when(name == "anzahl_beschaeftigte", number.cast("int"))).alias(
            "anzahl_beschaeftigte"
        ),
        F.array_sort(F.collect_set(F.when(~name.isin(*known) | bad_number, name))).alias("unknown"),
    )


def override_attributes(described: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Explicit values win over derived ones; both sides are partitioned by the description."""
    given = pivot_attributes(attributes, key)
    fields = [c for c in given.columns if c not in (key, "unknown")]
    renamed = given.select(key, "unknown", *[F.col(f).alias("_" + f) for f in fields])
    kept = [c for c in described.columns if c not in fields]
    return described.join(renamed, key, "left").select(
        *kept,
        *[F.coalesce(F.col("_" + f), F.col(f)).alias(f) for f in fields],
        F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"),
    )


def filled_count(columns: list[str]) -> Column:
    """How many attributes hold something (text and market do not count)."""
    flags = []
    for c in columns:
        if c in ("free_text", "markt"):
            continue
        col = F.col(c)
        if c == "roles":
            flags.append((F.coalesce(F.size(col), F.lit(0)) > 0).cast("int"))
        elif c in K.TEXT_FIELDS:
            flags.append((F.length(F.coalesce(col, F.lit(""))) > 0).cast("int"))
        else:
            flags.append(col.isNotNull().cast("int"))
    return sum(flags[1:], flags[0])
