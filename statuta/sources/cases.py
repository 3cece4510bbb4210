"""Worked cases: reading them and composing their searchable document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.text import normalise_space

CASE_DDL = (
    "kennung STRING, titel STRING, lage STRING, rolle STRING, einstufung STRING, begruendung STRING, "
    "pflichten ARRAY<STRING>, lernhinweis STRING, stolperstein STRING, rechtsgrundlage ARRAY<STRING>, "
    "verwandt ARRAY<STRING>, datei STRING"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files as JSON documents holding a list `faelle`; rows without id are skipped."""
    fields = CASE_DDL.replace(" STRING", ": STRING").replace(" ARRAY<STRING>", ": ARRAY<STRING>")
    reader = spark.read.schema(f"faelle ARRAY<STRUCT<{fields}>>").option("multiLine", True)
    files = reader.option("recursiveFileLookup", True).json(path)
    return (
        files.select(F.explode("faelle").alias("f"), F.col("_metadata.file_path").alias("_path"))
        .select("f.*", "_path")
        .where(F.col("kennung").isNotNull())
        .withColumn("datei", F.coalesce("datei", "_path"))
        .drop("_path")
    )


def case_document(
    title: Column,
    situation: Column,
    role: Column,
    klass: Column,
    reason: Column,
    duties: Column,
    lesson: Column,
    pitfall: Column,
) -> Column:
    """Labelled sections joined by empty lines; empty sections are dropped."""
    given = {
        "titel": title,
        "lage": situation,
        "rolle": role,
        "einstufung": klass,
        "begruendung": reason,
        "pflichten": F.array_join(F.filter(duties, lambda d: F.length(d) > 0), "; "),
        "lernhinweis": lesson,
        "stolperstein": pitfall,
    }
    parts = [
        F.when(F.length(given[name]) > 0, F.concat(F.lit(text), given[name]))
        for name, text in K.CASE_LABELS
    ]
    return normalise_space(F.array_join(F.array_compact(F.array(*parts)), "\n\n"))


def case_units(cases: DataFrame) -> DataFrame:
    """Cases as corpus units with key `fall/<id>`."""
    return cases.select(
        F.concat(F.lit("fall/"), "kennung").alias("unit_key"),
        F.lit(K.ACT_GUIDE).alias("act"),
        F.lit(K.KIND_CASE).alias("kind"),
        F.col("kennung").alias("number"),
        F.lit(None).cast("string").alias("paragraph"),
        F.coalesce("titel", "kennung").alias("title"),
        F.lit("").alias("chapter"),
        F.lit("").alias("section"),
        case_document(
            F.col("titel"),
            F.col("lage"),
            F.col("rolle"),
            F.col("einstufung"),
            F.col("begruendung"),
            F.col("pflichten"),
            F.col("lernhinweis"),
            F.col("stolperstein"),
        ).alias("text"),
        F.lit(None).cast("date").alias("valid_from"),
        F.col("datei").alias("source"),
        F.lit(None).cast("date").alias("as_of"),
        F.coalesce("rechtsgrundlage", F.array().cast("array<string>")).alias("refs"),
    )


def lesson(text: Column) -> Column:
    """The lesson section of a case text."""
    section = F.try_element_at(
        F.filter(F.split(text, "\n\n"), lambda s: F.startswith(s, F.lit(K.LESSON_LABEL))), F.lit(1)
    )
    return F.trim(F.substr(section, F.lit(len(K.LESSON_LABEL) + 1)))


def lessons_from_hits(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Per query: the lesson of the best case that has one, and the titles of up to five cases.

    The cases behind the fifth leave before anything is collected.
    """
    cases = units.where(F.col("kind") == K.KIND_CASE).select(
        "unit_key",
        F.coalesce(F.nullif("title", F.lit("")), "number").alias("title"),
        lesson(F.col("text")).alias("lesson"),
    )
    found = cases.join(hits.select("query_id", "place", "unit_key"), "unit_key")
    lessons = found.groupBy("query_id").agg(
        F.min_by("lesson", F.when(F.length("lesson") > 0, F.col("place"))).alias("lesson")
    )
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "title"))
    titles = (
        found.select(F.col("query_id").alias("_query"), "place", "title", first.alias("_no"))
        .where(F.col("_no") <= 5)
        .groupBy("_query")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda s: s.title).alias("cases"))
    )
    return lessons.join(titles, F.col("query_id").eqNullSafe(F.col("_query"))).select("query_id", "lesson", "cases")
