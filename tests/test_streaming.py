from pyspark.sql import functions as F

from touchline.streaming import activity as st

SCHEMA = "user_id long, event_id long, ts timestamp, value double"


def rows(spark, items):
    return spark.createDataFrame(items, "user_id long, event_id long, t string, value double").select("user_id", "event_id", F.to_timestamp("t").alias("ts"), "value")


def test_intake_drops_repeats_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")

    def run(items):
        rows(spark, items).write.mode("append").parquet(src)
        once = st.once_per_event(spark.readStream.schema(SCHEMA).parquet(src), ["user_id", "event_id"], "ts", "1 hour")
        q = once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([(1, 1, "2024-01-01 10:00:00", 1.0), (1, 2, "2024-01-01 11:00:00", 2.0), (1, 2, "2024-01-01 11:00:00", 2.0)]) == [(1, 1), (1, 2)]
    # a repeat, a row far behind the watermark, and a new one
    assert run([(1, 2, "2024-01-01 11:00:00", 2.0), (2, 9, "2023-12-01 00:00:00", 1.0), (1, 3, "2024-01-01 12:00:00", 3.0)]) == [(1, 1), (1, 2), (1, 3)]


def test_event_stream_reads_files_and_folders(spark, tmp_path):
    from touchline.workload.streams import event_stream, run
    from touchline.workload.tables import Tables

    events = spark.range(1000).selectExpr("id as event_id", "timestamp_seconds(id) as ts")
    events.repartition(2).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    for kind in ("folder", "file"):
        t = Tables(spark, str(tmp_path / kind))
        assert run(t, event_stream(t), kind).count() == 1000
