"""Session settings and durable cut points.

Joins are not hinted unless the small side is a literal table written in the code:
every data-derived side is left to Spark's own size check (the broadcast threshold
at planning time and again, on measured shuffle sizes, in adaptive execution).
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "touchline", cpus: str = "8") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Dderby.system.home=/tmp")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="touchline-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Spark's setting that deletes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and continue from the files; later reads prune columns.

    The shuffle files of the write go once it has ended, so they do not add up over the steps of a job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Parts in which a step with large shuffles is done.
SHARES = 4


def in_shares(step: Callable[[Callable[[Column], Column]], DataFrame]) -> DataFrame:
    """All rows of ``step``, done part by part, so that a fraction of its shuffle files is on disk at a time.

    ``step`` gets a function that tells whether a key (null too) is of the part; each row must belong to one part.
    """
    mine = lambda k: lambda key: F.pmod(F.xxhash64(F.lit(SHARES), key), F.lit(SHARES)) == k
    return reduce(DataFrame.union, [durable(step(mine(k))) for k in range(SHARES)])


#: Rows of a task for work that costs much a row, or holds rows in memory.
TASK_ROWS = 250_000


def task_count(df: DataFrame) -> int:
    """Tasks the rows need: all cores, and at most some TASK_ROWS rows a task."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows, by ``keys`` if there are any, over as many tasks as they need: all cores, and at most some TASK_ROWS rows a task.

    A scan has as many tasks as its files have bytes (or row groups) for, so one task's rows grow with the table.
    """
    return df.repartition(task_count(df), *keys)
