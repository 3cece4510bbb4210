import numpy as np
from pyspark.sql import functions as F

from statuta.operators import bm25, dense, fusion
from statuta.operators.scale import lookup_join, salted_join


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = rows(big.join(small, "k", how), "k", "id")
        assert rows(salted_join(big, small, ["k"], how), "k", "id") == want
    assert rows(lookup_join(big, small, ["k"], limit=5), "id", "v") == rows(big.join(small, "k"), "id", "v")


def test_bm25_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    units = spark.createDataFrame([(f"u{i}", "alpha beta " * (i % 3 + 1) + f"w{i % 7}") for i in range(60)], "unit_key string, text string")
    queries = spark.createDataFrame([(1, "alpha w3"), (2, "beta gamma")], "query_id long, text string")
    near = rows(bm25.bm25_scores(bm25.text_statistics(units), queries), "query_id", "unit_key", "score")
    monkeypatch.setattr(bm25, "fits", lambda df: False)
    assert rows(bm25.bm25_scores(bm25.text_statistics(units), queries), "query_id", "unit_key", "score") == near


def test_dense_search_equals_numpy_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(80, 6)).round(3)
    asked = rng.normal(size=(7, 6)).round(3)
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "unit_key long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    scores = np.round(asked @ vectors.T, 9)
    want = sorted((q, int(u), r + 1) for q in range(7) for r, u in enumerate(np.lexsort((np.arange(80), -scores[q]))[:4]))
    assert rows(dense.dense_search(units, queries, 4), "query_id", "unit_key", "rank") == want
    assert rows(dense.dense_search(units, queries, 4, block=2), "query_id", "unit_key", "rank") == want


def walk(kinds, n):
    """Sequential cap with back-fill."""
    cap, taken, skipped = max(1, n // 3), [], []
    for i, kind in enumerate(kinds):
        if len(taken) == n:
            break
        if kind == "fallbeispiel" and sum(kinds[t] == "fallbeispiel" for t in taken) >= cap:
            skipped.append(i)
        else:
            taken.append(i)
    return (taken + skipped)[:n]


def test_case_cap_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    lists = [["fallbeispiel" if x else "artikel" for x in rng.random(rng.integers(1, 15)) < p] for p in (0.2, 0.5, 0.9, 1.0) for _ in range(5)]
    data = [(q, f"u{i}", k, i + 1) for q, ks in enumerate(lists) for i, k in enumerate(ks)]
    ranked = spark.createDataFrame(data, "query_id long, unit_key string, kind string, rank int")
    got = fusion.cap_cases(ranked, 6).orderBy("query_id", "place").collect()
    for q, kinds in enumerate(lists):
        assert [r["unit_key"] for r in got if r["query_id"] == q] == [f"u{i}" for i in walk(kinds, 6)]


def test_fusion_counts_a_unit_listed_twice_twice(spark):
    ranked = spark.createDataFrame([(1, "a", 1, "fundstelle"), (1, "a", 2, "fundstelle"), (1, "b", 1, "stichwort")], "query_id long, unit_key string, rank int, way string")
    got = {r["unit_key"]: r["score"] for r in fusion.fuse(ranked).collect()}
    assert got == {"a": round(3 / 61 + 3 / 62, 9), "b": round(1 / 61, 9)}


def test_few_queries_go_to_the_units_and_many_in_blocks(spark, monkeypatch):
    units = spark.range(300).selectExpr("id AS unit_key", "array(cast(id % 17 AS double), cast(id % 5 AS double)) AS embedding")
    queries = spark.range(7).selectExpr("id AS query_id", "array(1D, cast(id AS double)) AS embedding")
    found = dense.dense_search(units, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slot" not in plan and plan.count("Exchange") == 1
    few = rows(found, "query_id", "unit_key", "rank")
    monkeypatch.setattr(dense, "PASSED", 6)
    assert rows(dense.dense_search(units, queries, 4), "query_id", "unit_key", "rank") == few
    assert dense.dense_search(units, queries.limit(0), 4).count() == 0
