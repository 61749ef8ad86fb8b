"""Intermediate tables in the folder that all executors share."""
from __future__ import annotations

import uuid

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from touchline.session import CLEANUP, shared_folder


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and go on from the files.

    A lost executor costs its running tasks only, and later readers prune columns. ``codec`` is the session's if None.
    The shuffle files of the write go once it has ended, so they do not add up over the steps of an operator.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``rows`` rows, so that a task holds the texts of one part as Python strings."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType, kept: list[str]) -> DataFrame:
    """``df`` through ``run``, which passes on the columns ``kept`` as they come.

    A column of whole numbers with a null in a batch would turn into floats in pandas and lose digits beyond 2**53, so
    long columns among ``kept`` go through the worker as text.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    longs = [c for c in kept if isinstance(df.schema[c].dataType, LongType)]
    inside = StructType([StructField(f.name, StringType()) if f.name in longs else f for f in schema.fields])
    rows = df.select(*[quoted(c).cast("string").alias(c) if c in longs else quoted(c) for c in df.columns])
    out = rows.mapInPandas(run, inside)
    return out.select(*[quoted(f.name).cast("long").alias(f.name) if f.name in longs else quoted(f.name) for f in schema.fields])
