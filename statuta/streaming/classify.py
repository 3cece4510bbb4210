"""Classification of a stream of descriptions: stateless, the rule book is compiled in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statuta.operators.rulebook import RuleBook
from statuta.plans.classify import classify


def classify_stream(descriptions: DataFrame, book: RuleBook, key: str = "desc_id") -> DataFrame:
    return classify(descriptions, book, key=key)
