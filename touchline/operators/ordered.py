"""Ordered computations that never put one whole key into one task.

* ``top_n`` relies on the window group limit: each map task keeps n rows per key before
  the shuffle, so a hot key arrives already cut to n rows per upstream task.
* ``running_totals`` and ``carry_forward`` range-partition by key *and* order, so a hot
  key spreads over many slices; only one summary row per (key, slice) meets in a window.
* ``order_statistics`` finds exact ranks between pivots of a quantile sketch, whatever the distribution.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

from touchline.session import durable

SLICE = "_slice"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left copy of the keys."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key in a total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_n_overall(df: DataFrame, order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of the whole table, ranked; only those n rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def arg_max(df: DataFrame, keys: list[str], by: list[Column], columns: list[str]) -> DataFrame:
    """The row with the greatest ``by`` tuple per key, as a partial aggregate."""
    pick = F.max_by(F.struct(*columns), F.struct(*by)).alias("_m")
    return df.groupBy(*keys).agg(pick).select(*keys, "_m.*")


def arg_min(df: DataFrame, keys: list[str], by: list[Column], columns: list[str]) -> DataFrame:
    pick = F.min_by(F.struct(*columns), F.struct(*by)).alias("_m")
    return df.groupBy(*keys).agg(pick).select(*keys, "_m.*")


def sliced(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Range-partition by key and order, number the slices and write the result.

    Writing fixes the slice boundaries, so both later reads agree even after a lost executor.
    """
    parts = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return durable(parts.withColumn(SLICE, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums in a total order."""
    work = df.withColumns({f"_v_{n}": c for n, c in totals.items()})
    base = sliced(work, keys, order)
    per_slice = base.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, SLICE, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in totals})
    out = same_keys(local, offsets, [*keys, SLICE])
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_o_{n}") for n in totals})
    return out.drop(SLICE, *[f"_v_{n}" for n in totals], *[f"_o_{n}" for n in totals])


def positions(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """1-based row number over a total order, spread over slices."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last non-null ``value`` up to each row; ``order`` are ascending column names."""
    base = sliced(df, keys, [F.col(c) for c in order])
    last_of_slice = base.where(F.col(value).isNotNull()).groupBy(*keys, SLICE).agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_last")
    )
    slices = same_keys(base.select(*keys, SLICE).distinct(), last_of_slice, [*keys, SLICE], "left")
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, SLICE, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    out = same_keys(local, carried, [*keys, SLICE])
    return out.withColumn(name, F.coalesce("_local", "_carry")).drop("_local", "_carry", SLICE)


def _backwards(df: DataFrame, time: str) -> Column:
    """A value that falls as ``time`` rises, without losing digits."""
    kind, t = df.schema[time].dataType, F.col(time)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return -F.unix_micros(t.cast("timestamp"))
    if isinstance(kind, DateType):
        return -F.unix_date(t)
    return F.bitwise_not(t) if isinstance(kind, IntegralType) else -t


def next_after(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
    columns: list[str], tie: list[str], prefix: str = "next_",
) -> DataFrame:
    """As-of join forward: the first right row with ``right_time`` after ``left_time``.

    Both sides are merged and read from late to early, so no pairs are formed; left rows
    without a later right row keep nulls.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    a = left.select(*keys, F.struct(*left.columns).alias("_row"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"))
    b = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), payload.alias("_payload"), F.struct(*tie).alias("_tie")
    )
    # one row per (key, time): the first by tie order
    b = b.groupBy(*keys, "_t", "_side").agg(F.min_by("_payload", "_tie").alias("_payload"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_late", _backwards(both, "_t")).withColumn("_id", F.xxhash64("_row"))
    out = carry_forward(both, keys, ["_late", "_side", "_id"], "_payload", "_found")
    found = [F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in columns]
    return out.where(F.col("_side") == 0).select("_row.*", *found)


Rank = Callable[[Column], Column]

#: Equal shares of a group between two pivots.
PIVOTS = 200
#: Distinct values of one group that meet in one task to be counted one by one.
MOST = 1_000_000


def _narrowed(rank: Column, n: Column, pivots: Column) -> tuple[Column, Column]:
    """Pivots below and above the value at ``rank`` of ``n`` sorted ones, a step aside for the error of the sketch."""
    at = F.floor(rank * PIVOTS / F.nullif(n, F.lit(0)))
    return F.get(pivots, F.greatest(at - 1, F.lit(0)).cast("int")), F.get(pivots, F.least(at + 2, F.lit(PIVOTS)).cast("int"))


def _axis(rows: DataFrame) -> Column:
    """``_v`` as the sketch sees it: a double where it is a number, which keeps the order and may only join neighbours."""
    return F.col("_v").cast("double") if isinstance(rows.schema["_v"].dataType, NumericType) else F.col("_v")


def rank_intervals(rows: DataFrame, group: list[str], ranks: dict[str, Rank], most: int = MOST) -> DataFrame:
    """Per group and rank: ``_rank_*`` and an interval ``_lo_*`` .. ``_hi_*`` of values that holds it.

    Pivots come from a quantile sketch, a partial aggregate of fixed size whose error is a twentieth of the step between
    two of them, so however the values are spread, at most four steps' rows lie strictly inside an interval. While that
    may be more than ``most`` rows, the rows inside are counted and sketched again. ``rows`` has the group and ``_v``.
    """
    points = F.array(*[F.lit(i / PIVOTS) for i in range(PIVOTS + 1)])
    sketch = lambda v: F.percentile_approx(v, points, 20 * PIVOTS)
    axis = _axis(rows)
    start = rows.groupBy(*group).agg(F.count("*").alias("_n"), sketch(axis).alias("_p"))
    for name, rank in ranks.items():
        start = start.withColumn(f"_rank_{name}", rank(F.col("_n")).cast("long"))
        lo, hi = _narrowed(F.col(f"_rank_{name}"), F.col("_n"), F.col("_p"))
        start = start.withColumns({f"_lo_{name}": lo, f"_hi_{name}": hi})
    bounds = durable(start.drop("_p"))
    largest = (bounds.agg(F.max("_n")).first()[0] or 0) * 4 // PIVOTS
    while largest > most:
        inside = same_keys(rows, bounds, group)
        exprs = []
        for name in ranks:
            lo, hi, v = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), axis
            between = (v > lo) & (v < hi)
            exprs += [F.count_if(v <= lo).alias(f"_below_{name}"), F.count_if(between).alias(f"_in_{name}"), sketch(F.when(between, v)).alias(f"_p_{name}")]
        seen = same_keys(bounds, inside.groupBy(*group).agg(*exprs), group)
        for name in ranks:
            rank = F.col(f"_rank_{name}") - F.col(f"_below_{name}")  # among the rows strictly inside
            lo, hi = _narrowed(rank, F.col(f"_in_{name}"), F.col(f"_p_{name}"))
            old_lo, old_hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            is_lo, is_hi = rank < 0, rank >= F.col(f"_in_{name}")
            # past the first or last pivot the old bound still holds
            at = F.floor(rank * PIVOTS / F.nullif(F.col(f"_in_{name}"), F.lit(0)))
            lo = F.when(is_lo, old_lo).when(is_hi, old_hi).when(at < 1, old_lo).otherwise(lo)
            hi = F.when(is_lo, old_lo).when(is_hi, old_hi).when(at + 2 >= PIVOTS, old_hi).otherwise(hi)
            seen = seen.withColumns({f"_new_{name}": lo, f"_hi_{name}": hi}).withColumn(f"_lo_{name}", F.col(f"_new_{name}")).drop(f"_new_{name}")
        size = F.greatest(F.lit(0), *[F.col(f"_in_{name}") for name in ranks])
        rows_inside = seen.agg(F.max(size)).first()[0] or 0
        bounds = durable(seen.select(*bounds.columns))
        largest = rows_inside * 4 // PIVOTS
    return bounds


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Rank], most: int = MOST) -> DataFrame:
    """Exact values at 0-based ranks (functions of the group size) per key, in the type of ``value``.

    One pass narrows each rank to an interval (``rank_intervals``); another counts the rows below it and the distinct
    values inside. Both are partial aggregates, so a key holding most of the rows costs no more than its share, and at
    most about ``most`` counted values of it meet in one task, however skewed the values are.
    """
    group = keys or ["_g"]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows if keys else rows.withColumn("_g", F.lit(0))
    bounds = rank_intervals(rows, group, ranks, most)
    axis = _axis(rows)
    between = [(axis >= F.col(f"_lo_{n}")) & (axis <= F.col(f"_hi_{n}")) for n in ranks]
    counted = same_keys(rows, bounds, group).groupBy(*group, F.when(reduce(lambda a, b: a | b, between), F.col("_v")).alias("_v")).agg(
        F.count("*").alias("_c"), *[F.count_if(axis < F.col(f"_lo_{n}")).alias(f"_b_{n}") for n in ranks]
    )
    whole, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counted = same_keys(counted, bounds, group)
    placed = counted.withColumns({
        f"_at_{n}": F.sum(f"_b_{n}").over(whole) + F.coalesce(F.sum(F.when(between[i], F.col("_c"))).over(before), F.lit(0)) for i, n in enumerate(ranks)
    })
    hit = lambda i, n: between[i] & (F.col(f"_rank_{n}") >= F.col(f"_at_{n}")) & (F.col(f"_rank_{n}") < F.col(f"_at_{n}") + F.col("_c"))
    out = placed.groupBy(*group).agg(*[F.max(F.when(hit(i, n), F.col("_v"))).alias(n) for i, n in enumerate(ranks)])
    return out if keys else out.drop("_g")


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Element n // 2 of the sorted values, without interpolation."""
    return order_statistics(df, keys, value, {name: lambda n: F.floor(n / 2)})


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, exact."""
    ranks: dict[str, Rank] = {}
    for name, p in points.items():
        ranks[f"_a_{name}"] = lambda n, p=p: F.floor((n - 1) * p)
        ranks[f"_b_{name}"] = lambda n, p=p: F.least(F.floor((n - 1) * p) + 1, n - 1)
    stats = order_statistics(df, keys, value, ranks)
    size = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = same_keys(stats, size, keys) if keys else stats.withColumn("_n", size.select("_n").scalar())
    for name, p in points.items():
        pos = (F.col("_n") - 1) * p
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        joined = joined.withColumn(name, a + (b - a) * (pos - F.floor(pos)))
    return joined.select(*keys, *points)


def dense_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Dense rank of the whole table by ``value`` descending.

    Distinct values are numbered in slices and joined back, so no task sees all rows.
    """
    distinct = df.select(value).distinct()
    numbered = positions(distinct, [], [F.col(value).desc()], name)
    return same_keys(df, numbered, [value])
