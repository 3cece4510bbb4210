import random

from pyspark.sql import functions as F

from statuta.operators import purposes
from statuta.registry.demo_rules import PURPOSES

DDL = "desc_id long, sentence_no int, sentence string, line_id int, value double"


def pairs(spark, texts=60, sentences=30):
    draw = random.Random(3)
    rows = [(d, s, f"{d}-{s}", p.id, round(draw.random(), 2)) for d in range(texts) for s in range(sentences) for p in PURPOSES]
    return rows, spark.createDataFrame(rows, DDL)


def test_only_the_best_pairs_are_exchanged(spark):
    rows, df = pairs(spark)
    key = {p.id: p.key for p in PURPOSES if not p.counter}
    want = {}
    for d, s, text, line, value in rows:
        if line in key:
            want.setdefault((d, key[line]), []).append((-value, s, line, text))
    found = purposes.best_purposes(df, PURPOSES, "desc_id")
    assert {(r["desc_id"], r["unit_key"]): (-r["value"], r["sentence"]) for r in found.collect()} == {
        k: (min(v)[0], min(v)[3]) for k, v in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(desc_id") < plan.index("MapInArrow")


def test_null_values_and_keys_are_left_to_the_aggregate(spark):
    rows = [(None, 0, "a", 0, 0.7), (None, 1, "b", 0, 0.9), (1, 0, "c", 0, None), (1, 1, "d", 0, 0.1)]
    found = purposes.best_purposes(spark.createDataFrame(rows, DDL), PURPOSES, "desc_id").collect()
    assert {(r["desc_id"], r["sentence"]) for r in found} == {(None, "b"), (1, "d")}


def test_pairs_that_cannot_carry_and_texts_are_not_exchanged(spark):
    _, df = pairs(spark, 5, 4)
    texts = spark.range(5).select(F.col("id").alias("desc_id"), F.lit("x" * 500 + "Est").alias("text"))
    found = purposes.decide(df.withColumn("value", F.col("value") * 0.6), PURPOSES, texts, "desc_id", "text")
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lower(text" not in plan.split("Exchange")[0] and "_text" not in plan


def test_a_key_is_taken_through_a_later_line_of_another_rule(spark):
    lines = tuple(purposes.PurposeLine(i, word, key, "k", rule) for i, (word, key, rule) in enumerate(
        [("a b c", "k1", "r1"), ("a b", "k2", "r1"), ("a", "k3", "r1"), ("a d", "k3", "r2"), ("z", "k4", "r3")]))
    rows = spark.createDataFrame([(1, 0, "a b c"), (2, 0, " ")], "desc_id long, sentence_no int, sentence string")
    found = purposes.candidate_pairs(rows, lines, "desc_id").collect()
    assert sorted(r["line_id"] for r in found if r["desc_id"] == 1) == [0, 1, 2, 3, 4]
    assert {r["similarity"] for r in found if r["desc_id"] == 2} == {0.0}
