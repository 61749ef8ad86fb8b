"""Group summaries. All are partial aggregates unless a docstring says otherwise."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import clamp, consistency, shrink
from touchline.operators.ordered import arg_max, arg_min, same_keys, top_n, upper_median
from touchline.session import durable


def nested_top(df: DataFrame, keys: list[str], order: list, n: int, columns: list[str], name: str) -> DataFrame:
    """Top ``n`` rows per key as an array of structs in rank order (at most n per key)."""
    best = top_n(df, keys, order, n, "_rk")
    packed = F.array_sort(F.collect_list(F.struct("_rk", *columns)))
    plain = F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in columns]))
    return best.groupBy(*keys).agg(plain.alias(name))


def share(cond: Column, digits: int = 1) -> Column:
    """Percentage of rows satisfying ``cond``."""
    return F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100, digits)


def truthy_mean(value: Column, default: float) -> Column:
    """Mean over non-zero, non-null entries."""
    return F.coalesce(F.avg(F.nullif(value, F.lit(0))), F.lit(default))


def weighted_mean(value: Column, weight: Column) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def schedule_quality(score: Column, low=0.60, high=0.92, opp_low=12, opp_high=75) -> Column:
    """Mean opponent score weighted by score^1.5, mapped to [low, high]."""
    mean = F.coalesce(weighted_mean(score, F.pow(score, F.lit(1.5))), F.lit(30.0))
    return F.round(clamp(low + (mean - opp_low) / (opp_high - opp_low) * (high - low), low, high), 3)


def ratio_per90(total: Column, minutes: Column) -> Column:
    """Ratio of sums per 90 minutes."""
    return F.sum(total) / F.greatest(F.sum(minutes), F.lit(1)) * 90


def shrink_to_group(df: DataFrame, group: list[str], value: str, n: str, k: float, out: str, prior: DataFrame, prior_col: str) -> DataFrame:
    """Shrink each row to the prior of its group."""
    joined = same_keys(df, prior.select(*group, F.col(prior_col).alias("_prior")), group, "left")
    return joined.withColumn(out, shrink(F.col(value), F.col(n), F.coalesce("_prior", value), k)).drop("_prior")


def relative_deviation(df: DataFrame, value: str, out: str, floor: float = 0.01) -> DataFrame:
    """(x - mean) / max(mean, floor) over the whole table, unclamped."""
    mean = df.agg(F.avg(value)).scalar()
    m = F.col("_mean")
    return df.withColumn("_mean", mean).withColumn(out, (F.col(value) - m) / F.greatest(m, F.lit(floor))).drop("_mean")


def largest_label(parts: dict[str, Column], minimum: float = 0.05) -> Column:
    """Name of the largest deviation when it exceeds ``minimum``; first name wins ties."""
    items = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(parts.items())]
    top = F.array_max(F.array(*items))
    return F.when(top["v"] > minimum, top["n"])


def mode_rows(df: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """Most frequent ``value`` tuple per key; ties by smallest tuple."""
    counts = df.groupBy(*keys, *value).agg(F.count("*").alias("n"))
    return arg_min(counts, keys, [-F.col("n"), *[F.col(v) for v in value]], [*value, "n"])


def nested_mode(df: DataFrame, keys: list[str], outer: list[str], inner: str) -> DataFrame:
    """Most frequent (tournament, season), then the most frequent team inside it."""
    best = mode_rows(df, keys, outer).withColumnRenamed("n", "n_outer")
    inside = df.join(best, [*keys, *outer])
    return best.join(mode_rows(inside, keys, [inner]).withColumnRenamed("n", "n_inner"), keys)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by key, keeping the first row in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return arg_min(df, keys, [*[F.col(o) for o in order], *[F.col(c) for c in rest if c not in order]], rest)


def most_complete(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by key, keeping the record with most non-null fields."""
    rest = [c for c in df.columns if c not in keys]
    filled = sum((F.col(c).isNotNull().cast("int") for c in rest), F.lit(0))
    return arg_min(df, keys, [-filled, *[F.col(o) for o in order]], rest)


def merge_partial(df: DataFrame, keys: list[str], ordinal: str, fields: list[str]) -> DataFrame:
    """Merge partial records of one id: per field, the latest non-missing value wins."""
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in fields]
    )


def all_and_each(df: DataFrame, group: str, aggs: list[Column], min_rows: int = 20, label: str = "ALL") -> DataFrame:
    """One row for ALL and one per group, groups under ``min_rows`` dropped (grouping sets)."""
    out = df.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("n"), *aggs)
    named = F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(group))
    return out.where(F.col("n") >= min_rows).withColumn(group, named).drop("_all")


def bag_weights(df: DataFrame, weight: str) -> DataFrame:
    """Literal multiplicity: each row repeated ``weight`` times. Prefer weighted sums."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))))


def normalised_to_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """value / mean of the positive values, over a per-team table."""
    mean = df.where(F.col(value) > 0).agg(F.avg(value)).scalar()
    m = F.col("_mean")
    return df.withColumn("_mean", mean).withColumn(out, F.when(m > 0, F.round(F.col(value) / m, 4)).otherwise(1.0)).drop("_mean")


def consistency_by(df: DataFrame, keys: list[str], output: Column, active: Column) -> DataFrame:
    """Consistency score over active rows."""
    kept = df.where(active).withColumn("_o", output)
    stats = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_o").alias("_m"), F.stddev_pop("_o").alias("_s"))
    return stats.select(*keys, "n", consistency(F.col("n"), F.col("_m"), F.col("_s")).alias("consistency"))


def positional_decay(df: DataFrame, keys: list[str], newest_first: list, values: dict[str, Column], usable: Column,
                     decay: float, history: int = 20, weight: Column | None = None) -> DataFrame:
    """Mean weighted by decay^i, i counting every row of the kept history, skipped ones too."""
    ranked = top_n(df, keys, newest_first, history, "_i").where(usable)
    w = F.pow(F.lit(decay), F.col("_i") - 1) * (weight if weight is not None else F.lit(1.0))
    ranked = ranked.withColumn("_w", w)
    return ranked.groupBy(*keys).agg(
        *[(F.sum(c * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias(n) for n, c in values.items()],
        F.count("*").alias("n"),
    )


def zone_shares(shots: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """Share of shots per zone."""
    n = F.count("*")
    part = lambda z: F.round(F.sum(F.when(F.col(zone) == z, 1).otherwise(0)) / n, 3)
    return shots.groupBy(*keys).agg(
        n.alias("shots"), part("left").alias("left_share"), part("center").alias("center_share"), part("right").alias("right_share")
    )


def group_against_total(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the largest group value as a denominator (games of the busiest player)."""
    top = df.groupBy(group).agg(F.max(value).alias("group_max"))
    return same_keys(df, top, [group])


def portfolio_summary(players: DataFrame, agency: str, value: str, fees: str, exported: Column, age: Column, since: Column,
                      name: str, club: str) -> DataFrame:
    """Per-agency counts, sums, means, upper median, shares and nested top five."""
    mv = F.nullif(F.col(value), F.lit(0))
    fee = F.when(F.col(fees) > 0, F.col(fees))
    flat = players.select(agency, F.col(name).alias("_name"), F.col(club).alias("_club"), fee.alias("_fee"), exported.alias("_exp"), age.alias("_age"), since.isNotNull().alias("_since"), mv.alias("_mv"))
    flat = durable(flat)  # read three times from here on, and derived once
    fee = F.col("_fee")
    base = flat.groupBy(agency).agg(
        F.count("*").alias("n_players"),
        F.count_if("_exp").alias("n_exported"),
        share(F.col("_exp")).alias("pct_exported"),
        F.coalesce(F.sum("_mv"), F.lit(0)).alias("total_mv"),
        F.coalesce(F.round(F.avg("_mv")), F.lit(0)).alias("avg_mv"),
        F.coalesce(F.max("_mv"), F.lit(0)).alias("top_player_mv"),
        F.coalesce(F.sum(fee), F.lit(0)).alias("total_fees_generated"),
        F.round(F.coalesce(F.sum(fee), F.lit(0)) / F.count("*")).alias("avg_fees_per_player"),
        F.count(fee).alias("n_with_fees"),
        F.round(F.avg("_age"), 1).alias("avg_age"),
        share(F.col("_since")).alias("agency_since_coverage"),
    )
    median = upper_median(flat, [agency], "_mv", "median_mv")
    order = [F.coalesce(F.col("_mv"), F.lit(0)).desc(), F.col("_name")]
    top = nested_top(flat, [agency], order, 5, ["_name", "_mv", "_club"], "_top").withColumn(
        "players_top5_mv",
        F.transform("_top", lambda s: F.struct(s["_name"].alias("name"), s["_mv"].alias("mv"), s["_club"].alias("club"))),
    ).drop("_top")
    out = same_keys(same_keys(base, median, [agency], "left"), top, [agency], "left")
    return out.withColumn("median_mv", F.coalesce("median_mv", F.lit(0)))


def main_row(df: DataFrame, keys: list[str], by: str, tie: str, columns: list[str]) -> DataFrame:
    """Row with most of ``by`` per key (the main goalkeeper); ties by smallest id."""
    return arg_max(df, keys, [F.col(by), -F.col(tie)], columns)


def complete_quotes(quotes: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """Mean over bookmakers quoting every outcome."""
    full = quotes.where(sum((F.col(o).isNull().cast("int") for o in outcomes), F.lit(0)) == 0)
    return full.groupBy(*keys).agg(F.count("*").alias("n_books"), *[F.avg(o).alias(o) for o in outcomes])


def extra_time_scale(rows: DataFrame, match: list[str], side: str, minutes: str, xg: str) -> DataFrame:
    """Own xG per side on a 90-minute basis: longer matches are scaled by 90 / longest stay."""
    longest = rows.groupBy(*match).agg(F.max(minutes).alias("_max"))
    sides = rows.groupBy(*match, side).agg(F.sum(F.coalesce(F.col(xg), F.lit(0.0))).alias("_xg"))
    scale = F.when(F.col("_max") > 90, 90 / F.col("_max")).otherwise(1.0)
    return sides.join(longest, match).select(*match, side, (F.col("_xg") * scale).alias("xg90"))
