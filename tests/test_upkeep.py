"""The store of units: any order of batches, repeats and merges gives the counts of the latest texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statuta.streaming import upkeep


@pytest.fixture(autouse=True)
def small_sizes(monkeypatch):
    """Two segments make a merge, so few batches pass through several sizes."""
    monkeypatch.setattr(upkeep, "BUCKETS", 2)
    monkeypatch.setattr(upkeep, "FAN", 2)


def units(spark, rows):
    return spark.createDataFrame(rows, "unit_key string, text string")


def counts(spark, path):
    return {r["word"]: r["df"] for r in upkeep.document_frequency(spark, path).collect()}


def latest_counts(texts):
    return Counter(w for t in texts.values() for w in set((t or "").split()))


def test_many_batches_with_merges_give_the_counts_of_the_latest_texts(spark, tmp_path):
    path, draw, texts = str(tmp_path / "store"), random.Random(5), {}
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega"]
    for version in range(9):
        batch = {f"u{draw.randrange(20)}": " ".join(draw.sample(vocabulary, draw.randrange(1, 4))) for _ in range(6)}
        upkeep.add_units(units(spark, list(batch.items())), path, version)
        texts.update(batch)
    assert counts(spark, path) == latest_counts(texts)
    sizes = [s.buckets for s in upkeep.segments(spark, path)]
    assert max(sizes) == 16 and len(sizes) == 2
    rows = upkeep.current(spark, path, "units").groupBy("unit_key").count().collect()
    assert {r["unit_key"]: r["count"] for r in rows} == dict.fromkeys(texts, 1)
    tf = upkeep.current(spark, path, "tf").groupBy("unit_key").agg(F.sum("tf").alias("n")).collect()
    assert {r["unit_key"]: r["n"] for r in tf} == {k: len(t.split()) for k, t in texts.items()}


def test_a_batch_repeated_after_a_merge_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    for version in range(5):
        upkeep.add_units(units(spark, [("u", f"text{version}"), (f"v{version}", "same")]), path, version)
    before, held = counts(spark, path), upkeep.segments(spark, path)
    upkeep.add_units(units(spark, [("u", "text2"), ("w", "other")]), path, 2)
    assert counts(spark, path) == before == {"text4": 1, "same": 5} and upkeep.segments(spark, path) == held


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    path = str(tmp_path / "store")
    upkeep.add_units(units(spark, [("u", "alpha")]), path, 0)
    half = upkeep.Segment(upkeep.BUCKETS, 1, 1)
    spark.createDataFrame([("beta", 7)], "word string, df bigint").write.parquet(half.folder(path, "df"))
    assert counts(spark, path) == {"alpha": 1}
    upkeep.add_units(units(spark, [("u", "beta")]), path, 1)
    assert counts(spark, path) == {"beta": 1}


def test_rows_read_by_a_batch_do_not_grow_with_the_store(spark, tmp_path):
    path, batch, opened = str(tmp_path / "store"), 40, {}
    for version in range(9):
        rows = [(f"k{version}-{i}", f"word{i}") for i in range(batch)]
        upkeep.add_units(units(spark, rows), path, version)
        if version in (2, 8):  # one merged segment and one fresh one
            opened[version] = upkeep.met(spark, path, "units", units(spark, [("k0-1", "x")])).count()
    assert opened[8] <= 2 * opened[2] and opened[8] < 9 * batch / 4


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    upkeep.add_units(units(spark, []), path, 0)
    assert counts(spark, path) == {}
    upkeep.add_units(units(spark, [("u", None), ("e", ""), (None, "lost"), ("t", "beta"), ("t", "alpha")]), path, 1)
    upkeep.add_units(units(spark, [("u", None), ("e", "")]), path, 2)
    assert counts(spark, path) == {"beta": 1}
    assert {(r["unit_key"], r["version"]) for r in upkeep.current(spark, path, "units").collect()} == {("u", 1), ("e", 1), ("t", 1)}


def test_a_batch_keeps_its_texts_and_words_in_no_cache_and_writes_from_many_tasks(spark, tmp_path, monkeypatch):
    """All of a unit is one row, made in one pass; a merge gives each bucket to several tasks."""
    path, cached = str(tmp_path / "store"), spark.sparkContext._jsc.getPersistentRDDs
    before = len(cached())
    monkeypatch.setattr(upkeep, "TASKS", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for version in range(3):
        rows = [(f"k{version}-{i}", f"alpha word{i}") for i in range(200)]
        upkeep.add_units(units(spark, [*rows, ("k0-1", f"beta{version}")]), path, version)
        assert len(cached()) == before
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts(spark, path)["alpha"] == 599 and counts(spark, path)["beta2"] == 1 and "beta0" not in counts(spark, path)
    merged = next(s for s in upkeep.segments(spark, path) if s.buckets > upkeep.BUCKETS)
    stored = spark.read.parquet(merged.folder(path, "units"))
    assert stored.count() == stored.select("unit_key").distinct().count() == 400
    files = stored.select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count().collect()
    assert max(r["count"] for r in files) > 1


def test_made_rows_are_those_of_the_encoder_and_the_counts(spark):
    from statuta.operators.bm25 import text_statistics
    from statuta.operators.encode import hashing_dense

    texts = ["Größe über ÄRGER ﬁn cafe\u0301", "ab-cde-f x-y ab ab", "", None, "Ⅳ ½ und die Straße"]
    df = units(spark, [(f"u{i}", t) for i, t in enumerate(texts)])
    made = upkeep._made(df.select(F.struct("unit_key").alias("row"), "text")).select("row.*", "embedding", "len", "hits")
    vectors = {r["unit_key"]: r["embedding"] for r in hashing_dense(df, "unit_key", "text").collect()}
    assert {r["unit_key"]: r["embedding"] for r in made.collect()} == vectors
    rows = lambda d: sorted(tuple(r) for r in d.select("unit_key", "word", "tf", "len").collect())
    assert rows(upkeep.postings(made)) == rows(text_statistics(df).term_frequency())
