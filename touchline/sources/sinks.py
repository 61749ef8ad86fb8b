"""Writing, publishing and incremental updates."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources import markers


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """Ordered CSV with header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Canonical parquet; with ``partition`` only the partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition else "static")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, root: str, run: str) -> str:
    """Write a run folder, then point readers to it; earlier runs stay.

    A job that dies half way changes nothing for readers. Of several publishers at once all runs stay, and readers get the
    one that moved the pointer last.
    """
    target = f"{root}/runs/{run}"
    df.write.mode("errorifexists").parquet(target)
    point(df.sparkSession, root, run)
    return target


def point(spark: SparkSession, root: str, run: str, expected: str | None = None, check: bool = False) -> int:
    """Move the pointer to any written run, an earlier one too, and return the number of the move.

    With ``check`` the pointer moves only from ``expected`` (None: it was never set), else a ValueError is raised and
    nothing changes. Each move is a numbered marker that exactly one writer can create.
    """
    return markers.append(spark, f"{root}/pointer", run, expected, check)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The table of the run that the pointer was last moved to."""
    return spark.read.parquet(f"{root}/runs/{markers.last(spark, f'{root}/pointer')[1]}")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], empty=None) -> DataFrame:
    """Keys not processed yet; with ``empty`` (a predicate on ``done``) also keys present but empty."""
    filled = done if empty is None else done.where(~empty)
    return wanted.join(filled.select(*keys).distinct(), keys, "left_anti")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Merge by key: the row with the highest version wins, the new one on a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in [*keys, "_new"]]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_m"))
    return out.select(*keys, "_m.*")


def sync_members(current: DataFrame, snapshot: DataFrame, group: str, member: str) -> DataFrame:
    """Make membership equal the fresh snapshot: add new members, drop absent ones.

    A group whose snapshot is empty keeps its members. Kept members keep their current row.
    """
    seen = snapshot.select(group).distinct()
    stays = current.join(snapshot.select(group, member).distinct(), [group, member], "left_semi")
    untouched = current.join(seen, group, "left_anti")
    added = snapshot.join(current.select(group, member), [group, member], "left_anti")
    return stays.unionByName(untouched).unionByName(added, allowMissingColumns=True)


