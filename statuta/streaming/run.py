"""Running a stream over what is there, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State operators with timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, name: str = "stream", clock_timers: bool = False) -> DataFrame:
    """Process everything available into parquet and return the written table.

    An operator with processing-time timers always asks for one more batch; for such a stream
    batches without data are switched off, else it would never come to its end.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)
    before = spark.conf.get(NO_DATA_BATCHES)
    if clock_timers:
        spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", out + "-checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    return spark.read.schema(stream.schema).parquet(out)
