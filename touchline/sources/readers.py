"""Reading landed JSON."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """A map column -> one row per key, its struct fields as columns."""
    rows = df.select(F.explode(column).alias(key, "_v"))
    return rows.select(key, "_v.*")


def array_rows(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """An array-of-structs column -> one row per element with its ordinal."""
    rows = df.select(*(keep or []), F.posexplode(column).alias("ordinal", "_v"))
    return rows.select(*(keep or []), "ordinal", "_v.*")


def read_keyed(spark: SparkSession, path: str, key: str, value_schema: str) -> DataFrame:
    """A file holding one object keyed by entity id.

    The file is one JSON document, so Spark reads it as one text value, parses it into a map
    with the given schema and explodes it; everything after is spread over the cluster.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"map<string, {value_schema}>").alias("m"))
    return keyed_rows(parsed, "m", key)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line: the splittable landing format to prefer."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_named_array(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """An array under a named key of one document."""
    doc = spark.read.schema(f"{name} array<{schema}>").option("multiLine", True).json(path)
    return array_rows(doc, name)


def optional(spark: SparkSession, path: str, schema: str | T.StructType, reader) -> DataFrame:
    """``reader(path)`` when the path exists on its file system, else a typed empty table."""
    try:
        return reader(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
