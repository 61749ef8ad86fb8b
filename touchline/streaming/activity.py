"""Streaming variants of intake, history and minute activity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import per90
from touchline.operators.aggregates import positional_decay


def once_per_event(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Exactly-once intake: repeats of a key inside the watermark and rows behind it are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, ts: str, delay: str, width: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Event-time aggregates: tumbling without ``slide``, sliding with it (pre-event means)."""
    windowed = stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys)
    out = windowed.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "mean")


def decayed_form(history: DataFrame, keys: list[str], newest_first: list[str], usable: Column, decay: float = 0.82, keep: int = 20) -> DataFrame:
    """Decayed rates of the kept histories (columns mins, xg, xa)."""
    values = {"form_xg_90": per90(F.col("xg"), F.col("mins")), "form_xa_90": per90(F.col("xa"), F.col("mins"))}
    return positional_decay(history, keys, [F.col(c).desc() for c in newest_first], values, usable, decay, keep)
