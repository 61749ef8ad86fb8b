"""Streaming queries over the event table, run to the end of the available data."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.session import shared_folder
from touchline.streaming import activity as st
from touchline.streaming import state
from touchline.workload.registry import query
from touchline.workload.tables import rnd


def event_stream(t):
    """The event table as a stream, whether it is one file or a folder of files (a plain path must be a folder, a pattern may match either)."""
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def on_disk(t) -> None:
    """State of the streams that start from now on lies on disk: sixty days of keys need not fit in memory."""
    for name, value in state.ROCKSDB.items():
        t.spark.conf.set(name, value)


def run(t, stream, name: str):
    """Run to the end of the data into a folder of the shared checkpoint directory, then read it."""
    root = f"{shared_folder(t.spark)}/stream-{name}-{uuid.uuid4().hex}"
    on_disk(t)
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


DAY_SQL = """w AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events), lim AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)"""


@query("stream_daily_activity", "I03", f"""WITH {DAY_SQL} SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, {rnd('sum(value)')} AS total FROM w, lim WHERE d + INTERVAL 1 DAY <= wm GROUP BY 1, 2""")
def _(t):
    out = run(t, st.activity(event_stream(t), "ts", "10 minutes", "1 day", None, ["event_type"], "value"), "daily")
    return out.select(F.to_date("start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_mean", "I03, E03", f"""WITH lim AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events), s AS (SELECT date_trunc('hour', ts) - CAST(o AS INTEGER) * INTERVAL 1 HOUR AS st, value FROM events, generate_series(0, 4) g(o))
SELECT strftime(st, '%Y-%m-%d %H') AS start, count(*) AS n, {rnd('avg(value)', 6)} AS mean FROM s, lim WHERE st + INTERVAL 5 HOUR <= wm GROUP BY 1""")
def _(t):
    out = run(t, st.activity(event_stream(t), "ts", "10 minutes", "5 hours", "1 hour", [], "value"), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("stream_intake_once", "I01", "SELECT event_id, user_id, value FROM events")
def _(t):
    once = st.once_per_event(event_stream(t), ["user_id", "event_id"], "ts", "60 days")
    return run(t, once, "once").select("event_id", "user_id", "value")


@query("stream_history", "I02, E09", """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def _(t):
    root = f"{shared_folder(t.spark)}/stream-history-{uuid.uuid4().hex}"
    on_disk(t)
    lists = state.last_n(event_stream(t), ["user_id"], "event_id", "ts", ["value"], "60 days")
    schema = lists.schema
    q = lists.writeStream.outputMode("update").foreachBatch(state.updates_writer(f"{root}/updates")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return state.current(t.spark, f"{root}/updates", ["user_id"], schema).select("user_id", "event_id", "value")
