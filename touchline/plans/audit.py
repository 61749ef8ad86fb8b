"""Two-source audits, corrected scorer tables and the rating model."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import linkage
from touchline.operators.joins import reconcile
from touchline.operators.models import rescore, ridge
from touchline.operators.ordered import dense_ranks, positions, top_n
from touchline.session import durable, in_shares


def coverage(matches: DataFrame, rows: DataFrame, match: str, rating: str) -> DataFrame:
    """Does a match have lineup rows and ratings, and if not, why."""
    seen = rows.groupBy(match).agg(F.count("*").alias("n_rows"), F.count(rating).alias("n_rated"))
    out = matches.join(seen, match, "left").fillna(0, ["n_rows", "n_rated"])
    reason = F.when(F.col("n_rows") == 0, "no_lineup").when(F.col("n_rated") == 0, "no_ratings").otherwise("ok")
    return out.withColumn("reason", reason)


def scorer_totals(goals: DataFrame, player: list[str], occurrence: list[str]) -> DataFrame:
    """One row a goal: the player's total, the goal's position in the player's list and the occurrence columns.

    Rows and no nested list, so a player with any number of goals is spread over many tasks.
    """
    totals = goals.groupBy(*player).agg(F.count("*").alias("total"))
    return positions(goals.select(*player, *occurrence), player, [F.col(c) for c in occurrence]).join(totals, player)


def count_audit(incidents: DataFrame, lineups: DataFrame, stat: str) -> DataFrame:
    """Players whose count differs between event feed and lineup statistics.

    Own goals are not goals of the listed player and are left out of the feed side.
    """
    feed = incidents.where(F.coalesce(F.col("class") != "ownGoal", F.lit(True)) & ~F.coalesce("rescinded", F.lit(False)))
    a = feed.select("event_id", "player_id", F.lit(1).alias("n"))
    b = lineups.where(F.col(stat) > 0).select("event_id", "player_id", F.col(stat).alias("n"))
    return reconcile(a, b, ["event_id", "player_id"], "n").withColumn("stat", F.lit(stat))


def name_audit(provider: DataFrame, feed: DataFrame, provider_goals: DataFrame, feed_goals: DataFrame) -> DataFrame:
    """Link two fixture lists by fuzzy names and score, then report unmatched scorers per side.

    Fixtures: match_id, home, away, score_home, score_away, ordinal (names normalised);
    goals: match_id, side, ordinal, name, kind. Own goals are ignored.
    """
    unique = top_n(provider, ["match_id"], [F.col("ordinal")], 1).drop("rank")
    left = durable(unique.withColumnRenamed("match_id", "provider_id"))
    linked = durable(linkage.link_fixtures(left, feed, "provider_id", "match_id", "ordinal").where(F.col("match_id").isNotNull()))
    real = lambda g: g.where(F.col("kind") != "owngoal").drop("kind")
    here = linked.select("match_id").distinct()
    part = lambda g, mine: real(g).where(mine(F.col("match_id")))
    a = in_shares(lambda mine: part(provider_goals, mine).withColumnRenamed("match_id", "provider_id").join(linked, "provider_id").drop("provider_id"))
    b = in_shares(lambda mine: part(feed_goals, mine).join(here, "match_id", "left_semi"))
    return linkage.match_scorers(a, b, ["match_id", "side"])


def corrected_scorers(scorers: DataFrame, corrections: DataFrame) -> DataFrame:
    """Scorer table after manual corrections, with their trace and a dense rank.

    ``scorers``: player_id, name, goals. ``corrections``: player_id, kind, delta, note.
    """
    item = F.struct("kind", "delta", "note")
    trace = corrections.groupBy("player_id").agg(F.sum("delta").alias("_delta"), F.array_sort(F.collect_list(item)).alias("corrections"))
    out = scorers.join(trace, "player_id", "left").withColumn("corrected", F.col("goals") + F.coalesce("_delta", F.lit(0)))
    return dense_ranks(out.drop("_delta").where(F.col("corrected") > 0), "corrected", "place")


def rating_audit(rows: DataFrame, corrections: DataFrame, features: list[str], stat: str) -> tuple[DataFrame, DataFrame]:
    """Rating model per position group and the rescored corrections."""
    model = ridge(rows.where(F.col("rating").isNotNull()), "grp", features, "rating")
    return model, rescore(rows, corrections, model, "grp", features, stat, ["event_id", "player_id"])
