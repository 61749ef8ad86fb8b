"""Minute series and event studies.

A series is a long table (series id, t, value). Once densified it has at most ``last - first + 1``
rows per series, so windows over (series, t) are bounded by the grid, whatever the raw volume.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.probability import one_sample_t, t_two_sided, two_sample_t
from touchline.functions.scalars import side_sign
from touchline.operators.joins import event_offsets
from touchline.operators.ordered import percentiles


def densify(points: DataFrame, series_id: str, minute: Column, order: list[str], value: str, first: int = 1, last: int = 90) -> DataFrame:
    """Fixed grid with forward fill, 0 before the first point; the last point of a floored minute wins."""
    t = F.floor(minute).cast("int")
    kept = points.withColumn("t", t).where(F.col("t").between(first, last))
    by_minute = kept.groupBy(series_id, "t").agg(F.max_by(F.col(value).cast("double"), F.struct(*order)).alias("_v"))
    grid = points.select(series_id).distinct().withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last))))
    so_far = Window.partitionBy(series_id).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(by_minute, [series_id, "t"], "left").select(
        series_id, "t", F.coalesce(F.last("_v", ignorenulls=True).over(so_far), F.lit(0.0)).alias("value")
    )


def autocorrelation(series: DataFrame, series_id: str, lags: list[int]) -> DataFrame:
    """Biased autocorrelation per series and lag: full-series mean, 0 for a constant series."""
    whole = Window.partitionBy(series_id)
    ordered = whole.orderBy("t")
    c = series.withColumn("_c", F.col("value") - F.avg("value").over(whole))
    c = c.withColumns({f"_l{k}": F.lag("_c", k).over(ordered) for k in lags})
    sums = c.groupBy(series_id).agg(
        F.count("*").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags],
    )
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in lags]))
    long = sums.select(series_id, "_n", "_v", each.alias("_x")).where(F.col("_n") > F.col("_x.lag"))
    ac = F.when(F.col("_v") > 1e-12, F.col("_x.s") / F.col("_v")).otherwise(0.0)
    return long.select(series_id, F.col("_x.lag").alias("lag"), ac.alias("ac"))


def mean_with_test(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error (population), t against 0 and its two-sided p-value."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"), F.var_samp(value).alias("_v")
    )
    stats = stats.withColumn("t_stat", one_sample_t(F.col("n"), F.col("mean"), F.col("_v")))
    return stats.select(
        *keys, "n", "mean", (F.col("_s") / F.sqrt("n")).alias("se"), "t_stat",
        t_two_sided(F.col("t_stat"), F.col("n") - 1).alias("p_value"),
    )


def profile(series: DataFrame) -> DataFrame:
    """Mean, population deviation and quartiles by grid point."""
    base = series.groupBy("t").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return base.join(percentiles(series, ["t"], "value", {"p25": 0.25, "p75": 0.75}), "t")


def pre_mean(series: DataFrame, series_id: str, width: int = 5) -> DataFrame:
    """Mean of the ``width`` grid points before each point, clipped at the start."""
    w = Window.partitionBy(series_id).orderBy("t").rowsBetween(-width, -1)
    return series.withColumn("pre_mean", F.avg("value").over(w))


def signed_windows(events: DataFrame, series: DataFrame, series_id: str, pre: int, post: int) -> DataFrame:
    """Every (event, offset) with the value seen from the acting side.

    ``events``: event_id, series id, minute, is_home and whatever else is to be kept.
    """
    joined = event_offsets(events, series, series_id, "minute", pre, post)
    return joined.withColumn("signed", side_sign(F.col("value"), F.col("is_home")))


def event_means(windows: DataFrame, keys: list[str], min_points: int) -> DataFrame:
    """Pre and post means per event with the completeness gate."""
    before = F.avg(F.when(F.col("offset") < 0, F.col("signed")))
    after = F.avg(F.when(F.col("offset") > 0, F.col("signed")))
    out = windows.groupBy(*keys).agg(F.count("*").alias("points"), before.alias("pre_mean"), after.alias("post_mean"))
    gate = (F.col("points") >= min_points) & F.col("pre_mean").isNotNull() & F.col("post_mean").isNotNull()
    return out.where(gate).withColumn("delta", F.col("post_mean") - F.col("pre_mean"))


def paired_test(means: DataFrame, keys: list[str]) -> DataFrame:
    """Paired t-test of post against pre: a one-sample test of the deltas."""
    tested = mean_with_test(means, keys, "delta").withColumnRenamed("mean", "mean_delta").drop("se")
    sides = means.groupBy(*keys).agg(F.avg("pre_mean").alias("mean_pre"), F.avg("post_mean").alias("mean_post"))
    return tested.join(sides, keys)


def select_events(events: DataFrame, selectors: dict[str, tuple[Column, bool]]) -> DataFrame:
    """All selectors in one pass: a row per (event, selector whose predicate holds).

    A selector is (predicate, flip): ``flip`` studies the rival's side.
    """
    items = [
        F.when(pred, F.struct(F.lit(n).alias("selector"), (F.col("is_home") != F.lit(flip)).alias("side")))
        for n, (pred, flip) in selectors.items()
    ]
    out = events.withColumn("_s", F.explode(F.array_compact(F.array(*items))))
    return out.withColumn("selector", F.col("_s.selector")).withColumn("is_home", F.col("_s.side")).drop("_s")


def event_study(events: DataFrame, series: DataFrame, series_id: str, selectors: dict[str, tuple[Column, bool]],
                pre: int = 5, post: int = 10, min_points: int | None = None) -> DataFrame:
    """Effect of each trigger: n, means before and after, delta and p-value."""
    chosen = select_events(events, selectors)
    means = event_means(signed_windows(chosen, series, series_id, pre, post), ["selector", "event_id"], min_points or pre + post)
    return paired_test(means, ["selector"])


def trajectory(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and standard error by offset."""
    return windows.groupBy(*keys, "offset").agg(
        F.count("*").alias("n"), F.avg("signed").alias("mean"), (F.stddev_pop("signed") / F.sqrt(F.count("*"))).alias("se")
    )


def half_life(traj: DataFrame) -> DataFrame:
    """First offset after the event at or below baseline + half of the peak over it.

    ``traj`` holds one row per offset, a grid of fixed size.
    """
    after = F.col("offset") > 0
    stats = traj.agg(
        F.avg(F.when(F.col("offset") < 0, F.col("mean"))).alias("baseline"),
        F.max(F.when(after, F.col("mean"))).alias("peak"),
        F.sort_array(F.collect_list(F.when(after, F.struct("offset", "mean")))).alias("_path"),
    )
    level = F.col("baseline") + (F.col("peak") - F.col("baseline")) * 0.5
    hit = F.filter("_path", lambda s: s["mean"] <= F.col("_level"))
    return stats.withColumn("_level", level).select(
        "baseline", "peak", F.array_min(F.transform(hit, lambda s: s["offset"])).alias("half_life")
    )


def goal_context(is_home: Column, home_after: Column, away_after: Column) -> Column:
    """Lead of the scorer before the goal, from the score after it."""
    return F.when(is_home, home_after - 1 - away_after).otherwise(away_after - 1 - home_after)


def context_label(lead_before: Column) -> Column:
    return (
        F.when(lead_before == 0, "go_ahead").when(lead_before == -1, "equalizer")
        .when(lead_before > 0, "extend_lead").otherwise("pull_one_back")
    )


def compare_groups(df: DataFrame, flag: str, value: str, min_rows: int = 5) -> DataFrame:
    """Two-sample equal-variance test between the rows where ``flag`` holds and the rest."""
    f = F.col(flag)
    v = F.col(value)
    s = df.agg(
        F.count(F.when(f, v)).alias("n_1"), F.avg(F.when(f, v)).alias("mean_1"), F.var_samp(F.when(f, v)).alias("_v1"),
        F.count(F.when(~f, v)).alias("n_2"), F.avg(F.when(~f, v)).alias("mean_2"), F.var_samp(F.when(~f, v)).alias("_v2"),
    )
    t = two_sample_t(F.col("n_1"), F.col("mean_1"), F.col("_v1"), F.col("n_2"), F.col("mean_2"), F.col("_v2"))
    enough = (F.col("n_1") >= min_rows) & (F.col("n_2") >= min_rows)
    p = F.when(enough, t_two_sided(F.col("t_stat"), F.col("n_1") + F.col("n_2") - 2)).otherwise(1.0)
    return s.withColumn("t_stat", F.when(enough, t)).select("n_1", "mean_1", "n_2", "mean_2", "t_stat", p.alias("p_value"))


def bucket_rates(df: DataFrame, value: str, outcome: str, edges: list[float], min_rows: int = 5) -> DataFrame:
    """Outcome rate per half-open bucket, buckets with more than ``min_rows`` rows only."""
    label = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (F.col(value) >= lo) & (F.col(value) < hi)
        label = F.when(cond, F.lit(i)) if label is None else label.when(cond, F.lit(i))
    out = df.withColumn("bucket", label).where(F.col("bucket").isNotNull()).groupBy("bucket")
    return out.agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate")).where(F.col("n") > min_rows)
