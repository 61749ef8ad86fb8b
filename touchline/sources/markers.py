"""Numbered marker files: each number is created once, whoever comes first."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 20


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there already.

    This is the one call of this library on the file system itself, since no DataFrame writer creates a file only where
    there is none: they look first and write later. HDFS creates exclusively; so does the operating system for plain
    files, where Hadoop's own local file system would look first too.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        place = target.toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            with open(place, "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(target, False)
    except Exception:
        if files.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """number, text of the markers in a folder; one that was created but never written is not seen."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="[0-9]" * WIDTH)
    return rows.select(F.col("_metadata.file_name").cast("long").alias("number"), F.col("value").alias("text")).where(F.length("text") > 0)


def last(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of the last written marker; 0 and None for an empty folder."""
    row = markers(spark, folder).agg(F.max(F.struct("number", "text")).alias("m")).first()["m"]
    return (row["number"], row["text"]) if row else (0, None)


def append(spark: SparkSession, folder: str, text: str, expected: str | None = None, check: bool = False) -> int:
    """Add the next marker and return its number; with ``check``, only while the last text is ``expected``.

    Where another writer has taken the number, all is read again. A number that a dead writer created and never wrote to
    stays unused: the next one is tried.
    """
    create_new(spark, f"{folder}/{0:0{WIDTH}d}", "")  # makes the folder
    number = 0
    while True:
        written, now = last(spark, folder)
        if check and now != expected:
            raise ValueError(f"{folder} is at {now}, not at {expected}")
        number = max(number, written) + 1
        if create_new(spark, f"{folder}/{number:0{WIDTH}d}", text):
            return number
