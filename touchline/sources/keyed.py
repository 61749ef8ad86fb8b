"""Large files of one keyed JSON object, read in byte ranges.

Spark's text source splits a file at any separator, so the file is cut at every closing brace and all its ranges are read
at once. Which braces close a value is then a matter of running totals over the pieces in file order: of quotes, to know
what stands in strings, then of depth, then of the values closed so far.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ordered import running_totals
from touchline.session import durable
from touchline.sources.readers import keyed_rows

ORDER = ["_start", "_row"]


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """_file, _start (of the byte range), _row (order in it) and the text up to the next closing brace."""
    rows = spark.read.text(path, lineSep="}")
    return durable(rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), "value"))


def values(parts: DataFrame) -> DataFrame:
    """_file, _nth and text of every value with its key, like ``"key": {...}``."""
    order = [F.col(c) for c in ORDER]
    bare = F.regexp_replace("value", r"\\.", "")  # an escaped character ends no string
    quoted = running_totals(parts.withColumn("_bare", bare), ["_file"], order, {"_quotes": _count(F.col("_bare"), '"')})
    own = _count(F.col("_bare"), '"')
    inside = (F.col("_quotes") - own) % 2 == 1  # the piece starts in a string
    outside = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), "_bare")).otherwise(F.col("_bare")), r'"[^"]*("|$)', "")
    opened = quoted.select("_file", *ORDER, "value", _count(outside, "{").alias("_opens"), F.when(F.col("_quotes") % 2 == 0, 1).otherwise(0).cast("long").alias("_closes"))
    deep = running_totals(opened, ["_file"], order, {"_depth": F.col("_opens") - F.col("_closes")})
    # the object itself has depth 1: a value is whole where a brace leads back to it
    whole = F.when((F.col("_closes") == 1) & (F.col("_depth") == 1), 1).otherwise(0).cast("long")
    nth = running_totals(deep.withColumn("_whole", whole), ["_file"], order, {"_nth": F.col("_whole")})
    nth = nth.where(F.col("_depth") >= 1).withColumn("_nth", F.col("_nth") - F.col("_whole"))
    text = F.array_sort(F.collect_list(F.struct(*ORDER, F.concat("value", F.lit("}")).alias("t"))))
    joined = nth.groupBy("_file", "_nth").agg(F.array_join(F.transform(text, lambda x: x["t"]), "").alias("text"))
    return joined.withColumn("text", F.regexp_replace("text", r"^\s*[{,]?\s*", ""))


def read_keyed_ranges(spark: SparkSession, path: str, key: str, value_schema: str) -> DataFrame:
    """One row for each key of the objects in the files, with the fields of its value, which must be an object.

    A file is read by as many tasks as it has splits; a value is put together from its pieces, wherever ranges cut it.
    Braces and quotes in strings count for nothing. A file of an empty object gives no rows.
    """
    parsed = values(pieces(spark, path)).select(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string, {value_schema}>").alias("m"))
    return keyed_rows(parsed.where(F.col("m").isNotNull()), "m", key)
