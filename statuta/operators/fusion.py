"""Citation lookup, reciprocal-rank fusion, candidate cut and the category cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.citations import cited_keys
from statuta.operators.scale import lookup_join


def parent_key(key: Column) -> Column:
    """The key without its last segment."""
    return F.regexp_replace(key, "/[^/]*$", "")


def citation_candidates(queries: DataFrame) -> DataFrame:
    """(query_id, pos, unit_key, score): the cited key (1.0) and its parent (0.9)."""
    named = queries.select("query_id", F.posexplode(cited_keys(F.col("text"))).alias("pos", "cited"))
    return named.select(
        "query_id",
        "pos",
        F.explode(
            F.array(
                F.struct(F.col("cited").alias("unit_key"), F.lit(1.0).alias("score")),
                F.struct(parent_key(F.col("cited")).alias("unit_key"), F.lit(0.9).alias("score")),
            )
        ).alias("c"),
    ).select("query_id", "pos", "c.unit_key", "c.score")


def citation_search(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Units named in a query: exact key, else its parent; rank is the order of naming."""
    found = (
        lookup_join(units.select("unit_key"), citation_candidates(queries), ["unit_key"])
        .groupBy("query_id", "pos")
        .agg(F.max_by("unit_key", "score").alias("unit_key"), F.max("score").alias("score"))
    )
    order = W.partitionBy("query_id").orderBy("pos")
    return found.select(
        "query_id", "unit_key", "score", F.row_number().over(order).alias("rank")
    )


def union_ways(ways: dict[str, DataFrame]) -> DataFrame:
    """Ranked ways under each other with the way's name."""
    return reduce(
        DataFrame.unionByName,
        [
            df.select("query_id", "unit_key", "rank", F.lit(name).alias("way"))
            for name, df in ways.items()
        ],
    )


def fuse(ranked: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """Σ weight/(k+rank) over all list positions; a unit listed twice in a way counts twice."""
    weight = F.create_map(*[F.lit(x) for pair in K.WAY_WEIGHT.items() for x in pair])
    part = F.coalesce(weight[F.col("way")], F.lit(1.0)) / (F.lit(float(k)) + F.col("rank"))
    return ranked.groupBy("query_id", "unit_key").agg(
        F.round(F.sum(part), 9).alias("score"),
        F.array_sort(F.collect_set("way")).alias("ways"),
        *[
            F.max(F.when(F.col("way") == way, F.col("rank"))).alias("rank_" + way)
            for way in K.WAY_WEIGHT
        ],
    )


def candidate_cut(
    fused: DataFrame, n: int | Column = K.DEFAULT_HITS, acts: tuple[str, ...] = ()
) -> DataFrame:
    """Act filter on the fused list, then the first max(n, 30) per query.

    The filter must not move below the per-way lists: it would change which units are fused.
    """
    if acts:
        fused = fused.where(F.col("act").isin(*acts))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("unit_key"))
    return fused.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= (max(n, K.RESCORE) if isinstance(n, int) else F.greatest(n, F.lit(K.RESCORE)))
    )


def cap_cases(ranked: DataFrame, n: int | Column = K.DEFAULT_HITS) -> DataFrame:
    """At most a third of cases among n hits; skipped cases fill up a list that is too short."""
    cap = max(1, n // 3) if isinstance(n, int) else F.greatest(F.lit(1), F.floor(n / 3))
    is_case = F.col("kind") == K.KIND_CASE
    in_kind = W.partitionBy("query_id", is_case).orderBy("rank")
    order = W.partitionBy("query_id").orderBy(F.col("_late"), "rank")
    return (
        ranked.withColumn("_late", is_case & (F.row_number().over(in_kind) > cap))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .drop("_late")
    )
