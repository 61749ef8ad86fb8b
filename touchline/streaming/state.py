"""Last-N histories as keyed state: a batch reads and writes only the entities it has events of."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from touchline.operators.ordered import same_keys

#: State stores on disk, with incremental checkpoints in the shared folder, in place of maps in executor memory.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def last_n(stream: DataFrame, keys: list[str], event: str, ts: str, values: list[str], delay: str, keep: int = 20) -> DataFrame:
    """The newest ``keep`` events of every entity that a batch touches, newest first.

    State holds, per entity, parallel lists of event ids, times (microseconds) and values, ``keep`` long at most, and the
    number of its updates. An event that is in the list already, or older than a full list, changes nothing; rows behind
    the watermark are dropped before. Returns keys, update, place (0 is newest), event, ``ts`` and values; an entity whose
    list did not change gives no rows. Ties in time go to the greater event id. The stream runs in update mode.
    """
    names = dict(stream.dtypes)
    micros = F.unix_micros(F.col(ts))
    rows = stream.withWatermark(ts, delay).where(F.col(event).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(*keys, F.col(event).alias("_event"), micros.alias("_at"), *[F.col(v).cast("double") for v in values], ts)
    state = ", ".join(["updates long", "events array<long>", "times array<long>", *[f"{v} array<double>" for v in values]])
    result = ", ".join([*[f"{k} {names[k]}" for k in keys], "update long", "place int", "_event long", "_at long", *[f"{v} double" for v in values]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        updates, events, times, *columns = held.get if held.exists else (0, [], [], *[[] for _ in values])
        before = set(events)
        newest = {e: (t, e, *v) for t, e, *v in zip(times, events, *columns)}
        for batch in batches:  # one batch of rows and ``keep`` events are in memory at a time
            for e, t, *v in zip(*[batch[c].tolist() for c in ("_event", "_at", *values)]):
                newest.setdefault(e, (t, e, *[None if pd.isna(x) else x for x in v]))
            newest = {r[1]: r for r in sorted(newest.values(), key=lambda r: r[:2], reverse=True)[:keep]}
        if set(newest) == before:
            return
        rows = list(newest.values())
        lists = [list(c) for c in zip(*rows)]
        held.update((updates + 1, lists[1], lists[0], *lists[2:]))
        yield pd.DataFrame({
            **{k: [x] * len(rows) for k, x in zip(keys, key)}, "update": updates + 1, "place": range(len(rows)), "_event": lists[1], "_at": lists[0],
            **{v: pd.Series(c, dtype="float64") for v, c in zip(values, lists[2:])},
        })

    out = rows.groupBy(*keys).applyInPandasWithState(update, result, state, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, "update", "place", F.col("_event").alias(event), F.timestamp_micros("_at").alias(ts), *values)


def updates_writer(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch's updates in a folder of its own, replaced when the batch is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def current(spark: SparkSession, root: str, keys: list[str], schema: str | StructType) -> DataFrame:
    """The latest list of every entity: the rows of its last update."""
    rows = spark.read.schema(schema).parquet(f"{root}/batch=*")
    last = rows.groupBy(*keys).agg(F.max("update").alias("update"))
    return same_keys(rows, last, [*keys, "update"])


def compact(spark: SparkSession, root: str, into: str, keys: list[str], schema: str | StructType) -> DataFrame:
    """Write the latest lists to ``into``, from where a later job can start."""
    current(spark, root, keys, schema).write.mode("overwrite").parquet(into)
    return spark.read.schema(schema).parquet(into)
