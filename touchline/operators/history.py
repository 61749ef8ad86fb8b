"""Per-entity histories: latest rows, bounded lists, snapshots, minutes on the pitch."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import SLICE, arg_min, sliced, top_n
from touchline.session import task_count


def latest_by_class(df: DataFrame, keys: list[str], classes: list[tuple[Column, str]], date: str, tie: str, columns: list[str]) -> DataFrame:
    """Latest row of the best class present, with the class label.

    ``classes`` are (predicate, label) from best to worst; rows in no class are ignored.
    """
    rank, label = None, None
    for i, (cond, name) in enumerate(classes):
        rank = F.when(cond, F.lit(i)) if rank is None else rank.when(cond, F.lit(i))
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    ranked = df.withColumn("_class", rank).withColumn("method", label).where(F.col("_class").isNotNull())
    newest = F.max_by(F.struct(*columns, "method"), F.struct(-F.col("_class"), F.col(date), -F.col(tie)))
    return ranked.groupBy(*keys).agg(newest.alias("_m")).select(*keys, "_m.*")


def first_where(df: DataFrame, keys: list[str], cond: Column, order: list[str], columns: list[str]) -> DataFrame:
    """First row in ``order`` satisfying the predicate."""
    return arg_min(df.where(cond), keys, [F.col(o) for o in order], columns)


def career_span(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """First and last date, years between them, greatest value."""
    years = F.round(F.datediff(F.max(date), F.min(date)) / 365.25, 1)
    return df.groupBy(*keys).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), years.alias("career_years"), F.max(value).alias("peak_value")
    )


def newest_usable(df: DataFrame, keys: list[str], newest_first: list, usable: Column, n: int, reach: int = 3) -> DataFrame:
    """Newest ``n`` usable rows among the newest ``reach * n`` candidates."""
    candidates = top_n(df, keys, newest_first, reach * n, "_cand").drop("_cand")
    return top_n(candidates.where(usable), keys, newest_first, n, "position")


def bounded_history(current: DataFrame, new: DataFrame, keys: list[str], event: str, newest_first: list, keep: int = 20) -> DataFrame:
    """Add events that are not in the history yet and keep the newest ``keep`` per entity.

    Running it again with the same events changes nothing.
    """
    tagged = current.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in [*keys, event, "_src"]]
    merged = arg_min(tagged, [*keys, event], [F.col("_src"), *[F.col(c) for c in rest]], rest)
    return top_n(merged, keys, newest_first, keep, "position")


def snapshot_gains(snapshots: DataFrame, player: str, round_col: str, total: str, points=(3, 2, 1)) -> DataFrame:
    """Rounds in which a cumulative count rose; the three largest totals of a round get points.

    ``snapshots`` has one row per (player, round), so a player's window is as long as the calendar.
    """
    w = Window.partitionBy(player).orderBy(round_col)
    gains = snapshots.withColumn("gained", F.col(total) - F.lag(total, 1, 0).over(w)).where(F.col("gained") > 0)
    best = top_n(gains, [round_col], [F.col(total).desc(), F.col(player)], len(points), "position")
    pts = F.element_at(F.array(*[F.lit(p) for p in points]), F.col("position"))
    return best.withColumn("points", pts)


def podium_totals(gains: DataFrame, player: str) -> DataFrame:
    return gains.groupBy(player).agg(
        *[F.count_if(F.col("position") == i).alias(f"place_{i}") for i in (1, 2, 3)],
        F.sum("points").alias("total_points"), F.count("*").alias("appearances"),
    )


def before_marker(df: DataFrame, keys: list[str], ordinal: str, marker: Column, counted: Column, name: str) -> DataFrame:
    """Rows satisfying ``counted`` before the first marker row; all of them when there is none.

    Rows are range-partitioned by key and ordinal and counted slice by slice; then one row a slice and key meets, and
    those behind the first slice with a marker drop out. No key is gathered or joined back.
    """
    base = sliced(df, keys, [F.col(ordinal)])
    mark = F.min(F.when(marker, F.col(ordinal))).over(Window.partitionBy(*keys, SLICE))
    inside = F.col("_mark").isNull() | (F.col(ordinal) < F.col("_mark"))
    per = base.withColumn("_mark", mark).groupBy(*keys, SLICE).agg(F.count_if(inside & counted).alias("_n"), F.max(F.col("_mark").isNotNull()).alias("_has"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    still = per.withColumn("_past", F.coalesce(F.max("_has").over(earlier), F.lit(False)))
    return still.groupBy(*keys).agg(F.sum(F.when(~F.col("_past"), F.col("_n")).otherwise(0)).alias(name))


def split_at_second(df: DataFrame, keys: list[str], ordinal: str, marker: Column, name: str = "is_second") -> DataFrame:
    """Split a flat list at the second marker row (the second goalkeeper starts the away list)."""
    two = top_n(df.where(marker).select(*keys, ordinal), keys, [F.col(ordinal)], 2, "_n").where(F.col("_n") == 2)
    cut = two.select(*keys, F.col(ordinal).alias("_cut"))
    return df.join(cut, keys, "left").withColumn(name, F.coalesce(F.col(ordinal) >= F.col("_cut"), F.lit(False))).drop("_cut")


def player_minutes(lineup: DataFrame, subs: DataFrame, periods: DataFrame, tasks: int | None = None) -> DataFrame:
    """Exact minutes on the pitch.

    ``lineup``: match_id, player_id, status (starter, bench, missing), is_home, name, reason.
    ``subs``: match_id, minute, added, player_out, player_in, is_home, ordinal.
    ``periods``: match_id, minute, added of FT / AET / AP markers.
    Players who came on without being listed are added.
    All rows of a match meet in one of ``tasks`` tasks; without that number the lineup is counted for it.
    """
    at = F.col("minute") + F.coalesce("added", F.lit(0)) * 0.5
    void = lambda c: F.lit(None).cast(subs.schema[c].dataType)
    entry = F.struct(F.col("player_in").alias("player_id"), at.alias("_came"), F.col("ordinal").alias("_ordinal"), F.col("is_home").alias("_home"), F.lit(None).cast("double").alias("_left"))
    leave = F.struct(F.col("player_out").alias("player_id"), F.lit(None).cast("double").alias("_came"), void("ordinal").alias("_ordinal"), void("is_home").alias("_home"), F.when(F.col("match_id").isNotNull(), at).alias("_left"))
    moves = subs.select("match_id", F.explode(F.array(entry, leave)).alias("_m")).select("match_id", "_m.*").where(F.col("player_id").isNotNull())
    ends = periods.select("match_id", (F.col("minute") + F.coalesce("added", F.lit(0))).alias("_end")).where(F.col("match_id").isNotNull())
    listed = lineup.select("match_id", "player_id", "status", "is_home", "name", "reason", F.lit(True).alias("_listed"))
    # a player's rows and a match's whistles meet by the match alone: one table, dealt once
    rows = listed.unionByName(moves, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True).repartition(tasks or task_count(lineup), "match_id")
    known = F.col("match_id").isNotNull() & F.col("player_id").isNotNull()
    s = F.col("status")
    entered = F.struct(F.when(s == "bench", 0).when(s == "starter", 1).when(s.isNull(), 2).otherwise(3).alias("_kind"), "status", "is_home", "name", "reason")
    stayed = F.struct(F.when(s == "starter", 1).otherwise(3).alias("_kind"), "status", "is_home", "name", "reason")
    players = rows.groupBy("match_id", "player_id").agg(
        F.min(F.when(F.col("_listed"), entered)).alias("_entered"),
        F.min(F.when(F.col("_listed") & s.isin("starter", "missing"), stayed)).alias("_stayed"),
        F.max_by("_came", "_ordinal").alias("_in"), F.max_by("_home", "_ordinal").alias("_side"), F.min("_left").alias("_out"), F.max("_end").alias("_end"),
    )
    final = F.when(F.col("match_id").isNotNull(), F.max("_end").over(Window.partitionBy("match_id")))
    players = players.withColumn("_final", final)
    # a substitute's entry replaces a starter's row, as the later record of the same player; a benched player who did not
    # come on leaves no row, a missing one does; rows without a match or player meet no substitution
    on = F.col("_in").isNotNull()
    alone = F.when(on & ~(known & F.col("_entered").isNotNull()), F.struct(F.lit(2).alias("_kind"), *[F.lit(None).cast(lineup.schema[c].dataType).alias(c) for c in ("status", "is_home", "name", "reason")]))
    best = players.withColumn("_best", F.least(F.when(on & known, F.col("_entered")).otherwise(F.col("_stayed")), alone)).where(F.col("_best").isNotNull())
    best = best.select("match_id", "player_id", "_in", "_out", "_final", "_best.*", F.when(known | (F.col("_best._kind") == 2), F.col("_side")).alias("_side"))
    end = F.greatest(F.lit(90), F.coalesce("_final", F.lit(90)))
    mins = (
        F.when(F.col("_kind") == 1, F.greatest(F.lit(1), F.round(F.coalesce("_out", end))))
        .when(F.col("_kind").isin(0, 2), F.greatest(F.lit(1), F.round(end - F.col("_in"))))
        .otherwise(0)
    )
    status = F.when(F.col("_kind") == 1, "starter").when(F.col("_kind") == 3, "missing").otherwise("sub_in")
    return best.select(
        "match_id", "player_id", mins.cast("int").alias("mins"), status.alias("status"),
        F.coalesce("is_home", "_side").alias("is_home"), F.coalesce("name", F.lit("")).alias("name"),
        F.when(status == "missing", F.coalesce("reason", F.lit("absent"))).alias("reason"),
    )


def starter_flags(minutes: DataFrame, player: str, weights: dict[int, float], threshold: int = 60) -> DataFrame:
    """Minutes per round side by side, starter flags and the weighted mean over starts.

    ``minutes``: player, round_num, mins; a round without a row counts 0 minutes.
    """
    r, m = F.col("round_num"), F.col("mins")
    usable = minutes.where((m > 0) & (m < 200) & r.isin(list(weights)))
    weight = None
    for k, v in weights.items():
        weight = F.when(r == k, F.lit(v)) if weight is None else weight.when(r == k, F.lit(v))
    start = m >= threshold
    return usable.groupBy(player).agg(
        *[F.coalesce(F.max(F.when(r == k, m)), F.lit(0)).alias(f"mins_{k}") for k in weights],
        *[F.coalesce(F.max(F.when(r == k, start)), F.lit(False)).alias(f"started_{k}") for k in weights],
        (F.sum(F.when(start, m * weight)) / F.sum(F.when(start, weight))).alias("start_minutes"),
    )


def first_eleven(played: DataFrame, keys: list[str], minutes: str, tie: str, size: int = 11) -> DataFrame:
    """Most-used eleven start, everyone else of the team is a substitute."""
    best = top_n(played, keys, [F.col(minutes).desc(), F.col(tie)], size, "_r").select(*keys, tie, F.lit("starter").alias("status"))
    return played.join(best, [*keys, tie], "left").withColumn("status", F.coalesce("status", F.lit("sub_in")))
