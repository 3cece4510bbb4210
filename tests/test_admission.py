import random
from datetime import datetime, timedelta, timezone

from statuta.streaming import admission
from statuta.streaming.run import drain, use_rocksdb

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def data(seed, n=400, hot=0.6):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice((0.0, 1.0, 5.0, 30.0, 60.0, 61.0, 400.0)) / rng.choice((1, 1, 8))
        rows.append((i, "heiss" if rng.random() < hot else f"a{rng.randrange(4)}", round(t, 3)))
    return rows


def brute(rows, limit, window):
    kept, out = {}, {}
    for i, address, t in sorted(rows, key=lambda r: (r[2], r[0])):
        times = [x for x in kept.get(address, []) if t - x <= window]
        out[i] = len(times) < limit
        kept[address] = [*times, t] if out[i] else times
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, a, START + timedelta(seconds=t)) for i, a, t in rows], "request_id long, address string, ts timestamp")


def test_batch_equals_the_sequential_rule(spark):
    for seed, limit in ((1, 3), (2, 5)):
        rows = data(seed)
        got = admission.admit(frame(spark, rows), limit, 60.0).collect()
        assert len(got) == len(rows)
        assert {r["request_id"]: r["admitted"] for r in got} == brute(rows, limit, 60.0)
        assert all((r["wait_seconds"] == 0) == r["admitted"] for r in got)


def test_edge_of_the_window_still_counts(spark):
    rows = [(0, "a", 0.0), (1, "a", 60.0), (2, "a", 60.5), (3, "b", 60.0)]
    got = {r["request_id"]: r["admitted"] for r in admission.admit(frame(spark, rows), 1, 60.0).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_stream_equals_batch(spark, tmp_path):
    use_rocksdb(spark)
    rows = data(7, 120)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, address string, ts timestamp").parquet(str(tmp_path / "in"))
    got = {r["request_id"]: r["admitted"] for r in drain(admission.admit_stream(stream, 3, 60.0)).collect()}
    assert got == brute(rows, 3, 60.0)


def test_a_stretch_is_walked_in_one_piece_when_a_join_is_planned_anew(spark):
    rows = data(11, 600, 0.9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large table: the join turns small only when it runs
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["request_id"]: r["admitted"] for r in admission.admit(frame(spark, rows), 3, 60.0).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 3, 60.0)
