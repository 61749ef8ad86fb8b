import glob
import os

import pytest
from pyspark.sql import functions as F

from touchline.streaming import state as st

SCHEMA = "user_id long, event_id long, ts timestamp, value double"
OUT = "user_id long, update long, place int, event_id long, ts timestamp, value double"


@pytest.fixture
def feed(spark, tmp_path):
    """Append rows, run the stream over what is new, and give the table and the rows of the last batch."""
    for k, v in st.ROCKSDB.items():
        spark.conf.set(k, v)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(items, keep=2):
        rows = spark.createDataFrame(items, "user_id long, event_id long, t string, value double")
        rows.select("user_id", "event_id", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(src)
        stream = st.last_n(spark.readStream.schema(SCHEMA).parquet(src), ["user_id"], "event_id", "ts", ["value"], "1 hour", keep)
        q = stream.writeStream.outputMode("update").foreachBatch(st.updates_writer(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = st.current(spark, out, ["user_id"], OUT).collect()
        table = sorted(((r.user_id, r.place, r.event_id, r.value) for r in rows), key=lambda r: (r[0] or 0, r[1]))
        return table, out

    yield run
    for k in st.ROCKSDB:
        spark.conf.unset(k)


def touched(spark, out):
    last = max(glob.glob(f"{out}/batch=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    batches = sorted((int(os.path.basename(p).split("=")[1]) for p in glob.glob(f"{out}/batch=*")))
    rows = {b: {r.user_id for r in spark.read.parquet(f"{out}/batch={b}").collect()} for b in batches}
    return last, rows


def test_state_keeps_the_newest_and_restarts(spark, feed):
    table, _ = feed([(1, 1, "2024-01-01 10:00:00", 1.0), (1, 2, "2024-01-01 11:00:00", 2.0), (1, 2, "2024-01-01 11:00:00", 2.0), (2, 7, "2024-01-01 10:30:00", None)])
    assert table == [(1, 0, 2, 2.0), (1, 1, 1, 1.0), (2, 0, 7, None)]
    # a new stream on the same checkpoint: user 1 gets a newer event, a repeat changes nothing
    table, out = feed([(1, 3, "2024-01-01 12:00:00", 3.0), (2, 7, "2024-01-01 10:30:00", None)])
    assert table == [(1, 0, 3, 3.0), (1, 1, 2, 2.0), (2, 0, 7, None)]
    assert set().union(*[v for b, v in touched(spark, out)[1].items() if b > 0]) == {1}


def test_late_rows_drop_and_ties_go_to_the_greater_id(spark, feed):
    feed([(1, 1, "2024-01-02 10:00:00", 1.0)])
    table, _ = feed([(1, 9, "2024-01-01 00:00:00", 9.0), (3, 4, "2024-01-02 10:00:00", 4.0), (3, 5, "2024-01-02 10:00:00", 5.0), (3, 3, "2024-01-02 10:00:00", 3.0), (None, 6, "2024-01-02 11:00:00", 6.0)])
    assert table == [(None, 0, 6, 6.0), (1, 0, 1, 1.0), (3, 0, 5, 5.0), (3, 1, 4, 4.0)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = st.updates_writer(str(tmp_path / "o"))
    rows = spark.createDataFrame([(1, 1, 0, 5, None, 1.0)], OUT)
    write(rows, 0)
    write(rows, 0)
    assert st.current(spark, str(tmp_path / "o"), ["user_id"], OUT).count() == 1
    assert st.compact(spark, str(tmp_path / "o"), str(tmp_path / "into"), ["user_id"], OUT).count() == 1
