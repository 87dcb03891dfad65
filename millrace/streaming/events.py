"""Event-time windows over the events stream, as a stream run to its end and as the same plan in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query
from millrace.sources.files import Files, fresh_dir

C = F.col


def stream_of(t: Tables, name: str) -> DataFrame:
    """A table as a stream with ts in UTC as event time, whether it is one file or a folder of part files."""
    schema = getattr(t, name).schema
    reader = t.spark.readStream.schema(schema)
    if any(folder for p, _, folder in Files(t.spark).list(t.sf_dir) if p.endswith(f"/{name}.parquet")):
        stream = reader.parquet(f"{t.sf_dir}/{name}.parquet")
    else:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", C("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming plan over all that is there, exactly once, into files of the shared folder; in complete mode each batch has a folder of its own and the last one counts."""
    spark = stream.sparkSession
    checkpoint, out = fresh_dir(spark, "stream"), fresh_dir(spark, "stream-out")
    start = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        start.format("parquet").start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    start.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/{k:012d}")).start().awaitTermination()
    done = sorted(p for p, _, folder in Files(spark).list(out) if folder)
    return spark.read.schema(stream.schema).parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)


def _ntz(c: str):
    return C(c).cast("timestamp_ntz")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    w = stream_of(t, "events").withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(w.select(C("w.start").alias("start"), "event_type", "n"), "complete").select(_ntz("start").alias("start"), "event_type", "n")


@query("SELECT s AS start, round(sum(value), 2) AS a, count(*) AS n FROM (SELECT value, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s FROM events) GROUP BY s")
def sliding_sum(t: Tables) -> DataFrame:
    x = t.events.withColumn("ts", C("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.round(F.sum("value"), 2).alias("a"), F.count("*").alias("n"))
    return x.select(C("w.start").cast("timestamp_ntz").alias("start"), "a", "n")


_SESSIONS = "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"


@query(_SESSIONS)
def session_windows(t: Tables) -> DataFrame:
    x = t.events.withColumn("ts", C("ts").cast("timestamp")).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", C("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT s AS start, count(*) AS n, count(DISTINCT user_id) > 0 AS some FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s")
def sliding_stream(t: Tables) -> DataFrame:
    w = stream_of(t, "events").withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), (F.approx_count_distinct("user_id") > 0).alias("some"))
    return run_to_end(w.select(C("w.start").alias("start"), "n", "some"), "complete").select(_ntz("start").alias("start"), "n", "some")


@query(_SESSIONS)
def session_stream(t: Tables) -> DataFrame:
    """The stream's sessions are those of the batch form."""
    w = stream_of(t, "events").withWatermark("ts", "30 minutes").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run_to_end(w.select("user_id", C("w.start").alias("start"), "n"), "complete").select("user_id", _ntz("start").alias("start"), "n")


@query("SELECT event_id, event_type FROM events")
def dedup_within_watermark(t: Tables) -> DataFrame:
    """Each event is delivered twice and kept once; a key's state goes when the watermark has passed it by an hour."""
    twice = stream_of(t, "events").select("event_id", "event_type", "ts").withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_to_end(twice.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(t: Tables) -> DataFrame:
    return run_to_end(stream_of(t, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events WHERE value > 10 GROUP BY event_type")
def stream_aggregate(t: Tables) -> DataFrame:
    x = stream_of(t, "events").where("value > 10").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return run_to_end(x, "complete")


@query("SELECT e.event_id AS event_id, c_mktsegment FROM events e JOIN customer ON e.user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(t: Tables) -> DataFrame:
    x = stream_of(t, "events").where("event_type = 'purchase'").join(t.customer, C("user_id") == C("c_custkey")).select("event_id", "c_mktsegment")
    return run_to_end(x, "append")
