"""Inquiries: question (and description) → classification, evidence, lesson, report, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.attributes import describe
from statuta.functions.text import length_status, sanitise
from statuta.operators.rulebook import RuleBook
from statuta.plans.classify import classify
from statuta.plans.report import evidence_arrays, report_text
from statuta.plans.search import evidence, hybrid_search
from statuta.session import cut_lineage
from statuta.sources.cases import lessons_from_hits

WITHOUT_MODEL = "ohne Sprachmodell formuliert"


def accepted(inquiries: DataFrame) -> DataFrame:
    """Sanitised inquiries with a status: ok, leer or zu_lang."""
    clean = inquiries.select(
        "inquiry_id",
        sanitise(F.col("question")).alias("question"),
        sanitise(F.coalesce("description", F.lit(""))).alias("description"),
    )
    asked = length_status(F.col("question"), K.MAX_QUESTION)
    told = length_status(F.col("description"), K.MAX_DESCRIPTION, allow_empty=True)
    return clean.withColumn("status", F.when(asked != "ok", asked).otherwise(told))


def answer(
    inquiries: DataFrame, units: DataFrame, book: RuleBook, n: int = K.DEFAULT_HITS, purposes=None
) -> DataFrame:
    """One row per inquiry; a rejected one has its status (leer, zu_lang) and nothing else.

    Classification and search fork from the same sanitised rows and meet again on the inquiry id;
    hits are written once because evidence, lesson and report all read them.
    """
    judged_inputs = accepted(inquiries)
    ok = judged_inputs.where("status = 'ok'")
    told = ok.select(
        "inquiry_id",
        F.coalesce(F.nullif("description", F.lit("")), F.col("question")).alias("text"),
    )
    described = describe(told, "inquiry_id", "text")
    judged = classify(described, book, purposes, key="inquiry_id")
    queries = ok.select(
        F.col("inquiry_id").alias("query_id"),
        F.substring(
            F.concat(F.col("question"), F.lit("\n"), F.col("description")), 1, K.INQUIRY_SEARCH_TEXT
        ).alias("text"),
    )
    hits = cut_lineage(hybrid_search(units, queries, n), "hits")
    proof = evidence_arrays(evidence(hits, units)).withColumnRenamed("query_id", "inquiry_id")
    lessons = lessons_from_hits(hits, units).withColumnRenamed("query_id", "inquiry_id")
    return (
        judged.withColumn("text", report_text())
        .select("inquiry_id", "heaviest", "classes", "text", "open_questions")
        .join(proof, "inquiry_id", "left")
        .join(lessons, "inquiry_id", "left")
        .select(
            "inquiry_id",
            "heaviest",
            "classes",
            "text",
            F.coalesce(F.transform("evidence", lambda e: e["unit_key"]), F.array().cast("array<string>")).alias("evidence"),
            F.col("evidence").alias("records"),
            F.coalesce("lesson", F.lit("")).alias("lesson"),
            F.coalesce("cases", F.array().cast("array<string>")).alias("cases"),
            F.array(F.lit(WITHOUT_MODEL)).alias("warnings"),
        )
        .join(judged_inputs.select("inquiry_id", "status"), "inquiry_id", "right")
    )
