"""Hybrid search: every way for a whole table of queries, fused in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.citations import label
from statuta.functions.text import excerpt, search_text, settled
from statuta.functions.tokens import words
from statuta.operators.bm25 import TextStatistics, asked_statistics, asked_words, bm25_top, postings
from statuta.operators.dense import dense_search
from statuta.operators.encode import hashing_dense
from statuta.operators.fusion import candidate_cut, cap_cases, citation_search, fuse, union_ways
from statuta.operators.rescore import rescore
from statuta.operators.scale import lookup_join
from statuta.operators.sparse import sparse_search
from statuta.session import cut_lineage


def searchable(units: DataFrame) -> DataFrame:
    """The units with the text that is searched: citation, title and chapter above the text.

    A column a unit table does not have counts as empty; without kind and act the text stands alone.
    """
    have = set(units.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    cited = label(*[col(c) for c in ("kind", "act", "number", "paragraph", "title")]) if {"kind", "act"} <= have else F.lit(None).cast("string")
    return units.withColumn("text", search_text(cited, col("title"), col("chapter"), F.col("text")))


def ranked_ways(
    units: DataFrame,
    queries: DataFrame,
    unit_vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    unit_weights: DataFrame | None = None,
    query_weights: DataFrame | None = None,
    statistics: TextStatistics | None = None,
) -> dict[str, DataFrame]:
    """The ranked lists that can be computed from what is given; words are those of the searched text."""
    statistics = statistics or asked_statistics(searchable(units), queries)
    ways = {
        "fundstelle": citation_search(units, queries),
        "stichwort": bm25_top(statistics, queries),
    }
    if unit_vectors is not None and query_vectors is not None:
        ways["vektor"] = dense_search(unit_vectors, query_vectors)
    if unit_weights is not None and query_weights is not None:
        ways["wortgewichte"] = sparse_search(unit_weights, query_weights)
    return ways


def fused_ways(units: DataFrame, queries: DataFrame, **vectors: DataFrame | TextStatistics | None) -> DataFrame:
    """The fused list, written: it is small, and what reads it (a count, a join) must not search again."""
    return cut_lineage(fuse(union_ways(ranked_ways(units, queries, **vectors))), "fused")


def hybrid_search(
    units: DataFrame,
    queries: DataFrame,
    n: int = K.DEFAULT_HITS,
    acts: tuple[str, ...] = (),
    scorer: Callable | None = None,
    **vectors: DataFrame | TextStatistics | None,
) -> DataFrame:
    """units (unit_key, act, kind, text …) × queries (query_id, text[, acts, n]) → n hits per query.

    A query may bring its own list of acts and its own number of hits; null or empty means the arguments.
    Without given vectors the dense way uses the hashing encoder. The fused list holds at most
    4 × 50 units per query plus the cited ones.
    """
    if vectors.get("unit_vectors") is None:
        vectors["unit_vectors"] = hashing_dense(searchable(units), "unit_key", "text")
    if vectors.get("query_vectors") is None:
        vectors["query_vectors"] = hashing_dense(queries, "query_id", "text")
    fused = fused_ways(units, queries, **vectors)
    named = lookup_join(units.select("unit_key", "act", "kind"), fused, ["unit_key"])
    if "acts" in queries.columns or "n" in queries.columns:
        own = F.col("acts") if "acts" in queries.columns else F.lit(None).cast("array<string>")
        most = F.col("n") if "n" in queries.columns else F.lit(None).cast("int")
        given = F.array(*[F.lit(a) for a in acts]).cast("array<string>")
        options = queries.select(
            "query_id",
            F.when(F.size(own) > 0, own).otherwise(given).alias("_acts"),
            F.coalesce(most.cast("int"), F.lit(n)).alias("_n"),
        )
        named = named.join(options, "query_id").where((F.size("_acts") == 0) | F.array_contains("_acts", F.col("act")))
        ranked, n = candidate_cut(named.drop("_acts"), F.col("_n")), F.col("_n")
    else:
        ranked = candidate_cut(named, n, acts)
    if scorer is not None:
        ranked = rescore(ranked, queries, units, scorer)
    return cap_cases(ranked, n).drop("_n")


def indexed(index, queries: DataFrame) -> dict:
    """What a search reads of a stored index, for `hybrid_search`: the blocks of the asked words alone.

    The asked words of a unit are put into one row, the only exchange; both word searches score it where it stands and
    exchange no pairs of query and unit.
    """
    asked = asked_words(queries)
    statistics = TextStatistics(None, index.totals, index.postings(asked))
    if asked is not None:
        hits = F.collect_list(F.struct("word", "tf")).alias("hits")
        rows = cut_lineage(statistics.stored.groupBy("unit_key", "len").agg(hits), "words")
        statistics = TextStatistics(None, index.totals, postings(rows), rows)
    return {
        "statistics": statistics,
        "unit_vectors": index.vectors.select("unit_key", "embedding"),
        "unit_weights": statistics.weights() if asked is None else statistics.listed_weights(),
        "query_weights": word_weights(queries),
    }


def from_texts(units: DataFrame, queries: DataFrame) -> dict:
    """The same from the texts themselves, which are composed and cut into words once and written."""
    texts = cut_lineage(searchable(units).select("unit_key", settled(F.col("text")).alias("text")), "texts")
    statistics = asked_statistics(texts, queries)
    return {
        "statistics": statistics,
        "unit_vectors": hashing_dense(texts, "unit_key", "text"),
        "query_vectors": hashing_dense(queries, "query_id", "text"),
        "unit_weights": statistics.listed_weights(),
        "query_weights": word_weights(queries),
    }


def word_weights(queries: DataFrame) -> DataFrame:
    """(query_id, token, weight): the distinct search words of a query in equal parts."""
    asked = queries.select("query_id", F.array_distinct(words(F.col("text"))).alias("w"))
    return asked.select("query_id", F.explode("w").alias("token"), (F.lit(1.0) / F.size("w")).alias("weight"))


def evidence(hits: DataFrame, units: DataFrame, chars: int = K.EXCERPT) -> DataFrame:
    """Hits as they appear in an answer: citation, title and the first characters of the text."""
    cited = units.select(
        "unit_key",
        label(
            F.col("kind"), F.col("act"), F.col("number"), F.col("paragraph"), F.col("title")
        ).alias("citation"),
        "title",
        excerpt(F.col("text"), chars).alias("excerpt"),
    )
    hits = cut_lineage(hits.select("query_id", "place", "unit_key", "act", "kind", F.round("score", 4).alias("score"), "ways"), "hits")
    return lookup_join(cited, hits, ["unit_key"])
