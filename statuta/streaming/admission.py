"""Request admission: at most n admitted requests per address in a sliding window.

Denied requests do not count, so whether a request is admitted depends on the decisions before it.
Batch: most rows are settled by counting alone. A row with fewer than n requests (admitted or not)
in its window is certainly admitted; these counts are taken in slices of (address, time), so a busy
address is spread over many tasks. Only busy stretches that contain a contested row are walked in
order, streamed through a worker that remembers n timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K

MICROS = 1_000_000
SLICE_WINDOWS = 16


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliced(requests: DataFrame, window: int) -> DataFrame:
    """Every request in its time slice, and once more as context of the next slice when it is
    younger than one window at that slice's start."""
    width = window * SLICE_WINDOWS
    own = F.floor(F.col("us") / width).cast("bigint")
    last = F.col("us") >= (own + 1) * width - window
    slices = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    return requests.select("*", own.alias("_own"), F.explode(slices).alias("slice"))


def trailing_counts(requests: DataFrame, window: int) -> DataFrame:
    """Adds `recent`: requests of the address in [us - window, us], itself and peers included."""
    order = W.partitionBy("address", "slice").orderBy("us").rangeBetween(-window, 0)
    counted = sliced(requests, window).withColumn("recent", F.count(F.lit(1)).over(order))
    return counted.where("slice = _own").drop("_own")


def busy_stretches(counted: DataFrame, window: int) -> DataFrame:
    """Adds `stretch`: time of the first request after an idle window. Carried inside a slice by a
    window, across slices over one row per slice."""
    seen = W.partitionBy("address", "slice").orderBy("us", "request_id").rowsBetween(W.unboundedPreceding, 0)
    peers = W.partitionBy("address", "slice", "us").orderBy("request_id")
    same = W.partitionBy("address", "slice", "us")
    alone = (F.col("recent") == F.count(F.lit(1)).over(same)) & (F.row_number().over(peers) == 1)
    marked = counted.withColumn("_start", F.when(alone, F.col("us")))
    inner = marked.withColumn("_inner", F.last("_start", ignorenulls=True).over(seen))
    per_slice = marked.groupBy("address", "slice").agg(F.max("_start").alias("_last"))
    before = W.partitionBy("address").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(
        "address", "slice", F.last("_last", ignorenulls=True).over(before).alias("_before")
    )
    return inner.join(carried, ["address", "slice"]).select(
        *[c for c in counted.columns if c != "slice"],
        F.coalesce("_inner", "_before").alias("stretch"),
    )


def admit(
    requests: DataFrame, limit: int = K.ADMIT_LIMIT, seconds: float = K.ADMIT_WINDOW_SECONDS
) -> DataFrame:
    """requests (address, ts, request_id) → (request_id, address, admitted, wait_seconds)."""
    window = int(seconds * MICROS)
    base = requests.select("request_id", "address", micros(F.col("ts")).alias("us"))
    stretched = busy_stretches(trailing_counts(base, window), window)
    contested = stretched.where(F.col("recent") > limit).select("address", "stretch").distinct()
    calm = stretched.join(contested, ["address", "stretch"], "left_anti").select(
        "request_id", "address", F.lit(True).alias("admitted"), F.lit(0).alias("wait_seconds")
    )
    walked = (
        stretched.join(contested, ["address", "stretch"], "left_semi")
        .select("address", "stretch", "us", "request_id")
        # by a column of its own: a repartition by the keys of the join is left out as done, and a join that
        # is planned anew at run time then deals the rows of a stretch to several tasks
        .withColumn("_deal", F.xxhash64("address", "stretch"))
        .repartition("_deal")
        .sortWithinPartitions("address", "stretch", "us", "request_id")
        .drop("_deal")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, []
        for batch in batches:
            flags, waits = [], []
            for key, us in zip(zip(batch["address"], batch["stretch"]), batch["us"]):
                if key != current:
                    current, admitted = key, []
                admitted = [t for t in admitted if us - t <= window]
                free = len(admitted) < limit
                flags.append(free)
                waits.append(0 if free else max(1, int((window - (us - admitted[0])) / MICROS) + 1))
                if free:
                    admitted.append(us)
            yield pd.DataFrame(
                {
                    "request_id": batch["request_id"],
                    "address": batch["address"],
                    "admitted": flags,
                    "wait_seconds": waits,
                }
            )

    schema = base.select("request_id", "address").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    decided = walked.mapInPandas(walk, f"{ddl}, admitted boolean, wait_seconds int")
    return calm.unionByName(decided)


def request_rate(requests: DataFrame, seconds: float) -> DataFrame:
    """Requests of the same address in the trailing window, denied ones included."""
    window = int(seconds * MICROS)
    base = requests.select("request_id", "address", micros(F.col("ts")).alias("us"))
    return trailing_counts(base, window).select("request_id", "address", F.col("recent").alias("n"))


def admit_stream(
    requests: DataFrame, limit: int = K.ADMIT_LIMIT, seconds: float = K.ADMIT_WINDOW_SECONDS
) -> DataFrame:
    """The same decision on a stream (address STRING, ts, request_id BIGINT).

    The state of an address is at most `limit` timestamps; it is dropped by a timer once the
    watermark has passed the newest by a window.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    window = int(seconds * MICROS)

    class Admission(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.times = handle.getValueState("times", "us array<bigint>")

        def handleInputRows(self, key, rows, timerValues):
            kept = list(self.times.get()[0]) if self.times.exists() else []
            pdf = pd.concat(list(rows)).sort_values(["us", "request_id"])
            flags, waits = [], []
            for us in pdf["us"]:
                kept = [t for t in kept if us - t <= window]
                free = len(kept) < limit
                flags.append(free)
                waits.append(0 if free else max(1, int((window - (us - kept[0])) / MICROS) + 1))
                if free:
                    kept.append(int(us))
            self.times.update((kept,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer((kept[-1] + window) // 1000 + 1)
            yield pd.DataFrame(
                {"request_id": pdf["request_id"].to_numpy(), "address": key[0], "admitted": flags, "wait_seconds": waits}
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.times.clear()
            return iter([])

        def close(self) -> None:
            pass

    timed = requests.withColumn("us", micros(F.col("ts"))).withWatermark("ts", f"{int(seconds)} seconds")
    return timed.groupBy("address").transformWithStateInPandas(
        statefulProcessor=Admission(),
        outputStructType="request_id bigint, address string, admitted boolean, wait_seconds int",
        outputMode="Append",
        timeMode="EventTime",
    )
