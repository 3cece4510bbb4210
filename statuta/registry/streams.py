"""Streaming queries: the given tables replayed as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.registry import rules as R
from statuta.registry import survey as S
from statuta.registry.base import query
from statuta.registry.demo_rules import BOOK
from statuta.registry.demo_survey import SURVEY
from statuta.plans.search import searchable
from statuta.registry.frames import UNITS_SQL, as_text, units
from statuta.registry.search import TOKENS_CTE
from statuta.session import scratch
from statuta.streaming import admission, upkeep
from statuta.streaming.classify import classify_stream
from statuta.streaming.run import drain, use_rocksdb
from statuta.streaming.sessions import live_questionnaire
from statuta.tables import load

# events are sparse, so the window is hours
LIMIT, SECONDS = 3, 6 * 3600.0


def requests(spark, sf):
    return load(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("address"), F.col("ts").cast("timestamp").alias("ts"))


def replay(spark, df, parts=3):
    """A frame written in some files and read back one file per micro-batch."""
    path = scratch(spark, "quelle")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("r01_admission")
def r01(spark, sf):
    return admission.admit(requests(spark, sf), LIMIT, SECONDS)


@query("r01_admission_bounds", f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {int(SECONDS * 1e6)} PRECEDING AND CURRENT ROW) AS n FROM e)
    SELECT CAST(user_id AS VARCHAR) AS address, CAST(count(*) AS BIGINT) AS requests, TRUE AS calm_admitted, TRUE AS within_limit FROM c GROUP BY user_id""")
def r01_bounds(spark, sf):
    """What must hold for every address: calm requests are admitted, and no window of admitted
    requests exceeds the limit."""
    window = int(SECONDS * admission.MICROS)
    base = requests(spark, sf).select("request_id", "address", admission.micros(F.col("ts")).alias("us"))
    counted = admission.trailing_counts(base, window).select("request_id", "recent")
    decided = admission.admit(requests(spark, sf), LIMIT, SECONDS)
    kept = base.join(decided.where("admitted").select("request_id"), "request_id")
    load_now = admission.trailing_counts(kept, window).groupBy("address").agg((F.max("recent") <= LIMIT).alias("within_limit"))
    return decided.join(counted, "request_id").groupBy("address").agg(
        F.count(F.lit(1)).alias("requests"),
        F.bool_and((F.col("recent") > LIMIT) | F.col("admitted")).alias("calm_admitted")).join(load_now, "address")


@query("r01_admission_stream")
def r01_stream(spark, sf):
    """The whole event table as one stream; equal to the batch decision."""
    use_rocksdb(spark)
    stream = replay(spark, requests(spark, sf), 1)
    return drain(admission.admit_stream(stream, LIMIT, SECONDS), "zulassung")


@query("r02_request_rate", f"""SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS address, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
    RANGE BETWEEN {int(SECONDS * 1e6)} PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events""")
def r02(spark, sf):
    return admission.request_rate(requests(spark, sf), SECONDS)


# events → answers of a user to the catalogue question the event's number falls on
def event_answers(spark, sf):
    ids = F.array(*[F.lit(q.id) for q in S.C.questions])
    n = len(S.C.questions)
    return load(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.element_at(ids, (F.col("event_id") % n + 1).cast("int")).alias("question_id"),
        F.when(F.col("event_type").isin("click", "view"), "yes").when(F.col("event_type") == "error", "na").otherwise("no").alias("answer"),
        F.col("ts").cast("timestamp").alias("ts"))


@query("r03_live_questionnaire")
def r03(spark, sf):
    """The last output of every case equals the batch evaluation of its latest answers."""
    use_rocksdb(spark)
    stream = replay(spark, event_answers(spark, sf).withColumn("us", admission.micros(F.col("ts"))), 2)
    out = drain(live_questionnaire(stream, SURVEY), "sitzung", clock_timers=True)
    last = out.groupBy("case_id").agg(F.max_by(F.struct("answered", "sheet", "class"), "answered").alias("o"))
    return last.select("case_id", F.col("o.answered").cast("bigint").alias("answered"), F.array_join("o.sheet", "|").alias("sheet"), "o.class")


@query("r04_stream_classification", R.HINTS + " SELECT desc_id, classes[1] AS heaviest, array_to_string(classes, '|') AS classes FROM cls")
def r04(spark, sf):
    stream = replay(spark, R.descriptions(spark, sf))
    return drain(classify_stream(stream, BOOK), "einstufung").select("desc_id", "heaviest", as_text("classes"))


@query("r05_index_upkeep", TOKENS_CTE + " SELECT word, CAST(df AS BIGINT) AS df FROM df")
def r05(spark, sf):
    """Units arrive in ten batches; term statistics from the store equal those of the whole."""
    path = scratch(spark, "bestand")
    upkeep.maintain(replay(spark, searchable(units(spark, sf)).select("unit_key", "text"), 10), path)
    return upkeep.document_frequency(spark, path)
