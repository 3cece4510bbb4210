"""Search over rows that hold all words of a unit."""

import numpy as np
from pyspark.sql import functions as F

from statuta.functions.tokens import words
from statuta.operators import bm25, encode, listed, sparse
from statuta.plans import search

ODD = ["Co-Operate mit KI-System und a1b-cd--ef- -x", "ﬁne Café-Crème ½ … naïve™ straße", None, "", "東京 étude Ａbc-Ｄef ghi", "der die das ab", "x" * 50 + "-yy-zzz " * 3]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def units_of(spark, n=400):
    text = "concat_ws(' ', 'alpha', concat('w', id % 7), concat('w', id % 23), repeat('beta-gamma ', cast(id % 4 AS int)), ucase(concat('Ü', id % 5)))"
    return spark.range(n).selectExpr("concat('u', id) AS unit_key", f"{text} AS text").repartition(5)


def test_words_cut_in_the_batch_are_those_of_the_column(spark, monkeypatch):
    units = spark.createDataFrame(list(enumerate(ODD)), "unit_key long, text string").coalesce(1)
    cut = units.select("unit_key", words(F.col("text")).alias("words"), F.size(words(F.col("text"))).alias("len"))
    want = rows(cut.select("unit_key", F.explode("words").alias("word")).groupBy("unit_key", "word").agg(F.count("word").alias("tf")), "unit_key", "word", "tf")
    sizes = {r["unit_key"]: r["len"] for r in cut.collect()}
    for size in (bm25.SLICE, 40):
        monkeypatch.setattr(bm25, "SLICE", size)
        found = bm25.counted_texts(units, "text")
        assert rows(bm25.postings(found), "unit_key", "word", "tf") == want
        assert {r["unit_key"]: r["len"] for r in found.collect()} == sizes
        assert rows(bm25.postings(bm25.counted_texts(units, "text", ["ef", "cafe", "none"])), "unit_key", "word", "tf") == [w for w in want if w[1] in ("ef", "cafe")]


def test_scores_of_rows_equal_exchanged_scores(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "alpha w3 beta"), (2, "gamma w5 w5 w22"), (3, "nowhere"), (4, "ue1 beta-gamma")], "query_id long, text string")
    stats = bm25.asked_statistics(units_of(spark), queries)
    want = rows(bm25.top_per_query(bm25.bm25_scores(stats, queries), 9), "query_id", "rank", "unit_key", "score")
    asked, weights = search.word_weights(queries), stats.listed_weights()
    sums = rows(bm25.top_per_query(sparse.sparse_scores(stats.weights(), asked), 9), "query_id", "rank", "unit_key", "score")
    assert len(want) > 20 and len(sums) == len(want)
    for cells, products in ((listed.CELLS, listed.PRODUCTS), (40, 3)):
        monkeypatch.setattr(listed, "CELLS", cells)
        monkeypatch.setattr(listed, "PRODUCTS", products)
        found = bm25.bm25_top(stats, queries, 9)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert rows(found, "query_id", "rank", "unit_key", "score") == want
        assert rows(sparse.sparse_search(weights, asked, 9), "query_id", "rank", "unit_key", "score") == sums
    monkeypatch.setattr(listed, "QUERIES", 1)
    assert rows(bm25.bm25_top(stats, queries, 9), "query_id", "rank", "unit_key", "score") == want
    assert rows(sparse.sparse_search(weights, asked, 9), "query_id", "rank", "unit_key", "score") == sums


def test_a_fused_list_is_read_and_not_searched_again(spark):
    queries = spark.createDataFrame([(1, "alpha w3 beta")], "query_id long, text string")
    units = units_of(spark, 60).selectExpr("*", "'KI-VO' AS act", "'artikel' AS kind", "'1' AS number", "CAST(NULL AS STRING) AS paragraph", "'' AS title", "'' AS chapter")
    found = search.fused_ways(units, queries, **search.from_texts(units, queries))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "MapInArrow" not in plan and found.count() > 0
    assert bm25.bm25_top(bm25.asked_statistics(units.limit(0), queries), queries).count() == 0
    assert bm25.bm25_top(bm25.asked_statistics(units, queries.limit(0)), queries.limit(0)).count() == 0


def test_empty_words_get_no_bucket(spark):
    texts = spark.createDataFrame([(0, " Ab  cd\tab "), (1, "ab cd ab"), (2, "  "), (3, None)], "k long, text string")
    found = {r["k"]: np.array(r["embedding"]) for r in encode.hashing_dense(texts, "k", "text").collect()}
    assert (found[0] == found[1]).all() and found[0].any() and not found[2].any() and not found[3].any()
