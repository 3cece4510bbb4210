"""Sparse dot product of lexical weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.operators.bm25 import SCORE_DIGITS, top_per_query
from statuta.operators.listed import few, listed_scores
from statuta.operators.scale import fits, salted_join


def weights_to_rows(df: DataFrame, key: str, weights: str = "weights") -> DataFrame:
    return df.select(key, F.explode(weights).alias("token", "weight"))


def sparse_scores(units: DataFrame, queries: DataFrame) -> DataFrame:
    """units (unit_key, token, weight) × queries (query_id, token, weight) → positive sums.

    The words of a unit may also stand in one row: (unit_key, items ARRAY<STRUCT<token, value>>).
    """
    if "items" in units.columns:
        units = units.select("unit_key", F.explode("items").alias("i")).select("unit_key", "i.token", F.col("i.value").alias("weight"))
    asked = queries.select("query_id", "token", F.col("weight").alias("query_weight"))
    if fits(asked):
        pairs = units.join(F.broadcast(asked), "token")
    else:
        pairs = salted_join(units, asked, ["token"])
    return (
        pairs.groupBy("query_id", "unit_key")
        .agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), SCORE_DIGITS).alias("score"))
        .where(F.col("score") > 0)
    )


def sparse_search(units: DataFrame, queries: DataFrame, k: int = K.PER_WAY) -> DataFrame:
    asked = few(queries) if "items" in units.columns else None
    if asked is not None:
        q_type = queries.schema["query_id"].dataType.simpleString()
        return top_per_query(listed_scores(units, asked, q_type, k, SCORE_DIGITS).where("score > 0"), k)
    return top_per_query(sparse_scores(units, queries), k)
