"""Team strengths, fixture predictions and the post-round form layer."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import per90
from touchline.functions.scoring import play60
from touchline.operators import competition as cp
from touchline.operators.aggregates import normalised_to_mean


def period_patterns(matches: DataFrame) -> DataFrame:
    """First-half goal share and comeback rate per team.

    ``matches``: team, gf, ga, ht_gf, ht_ga and the goals (or proxies) per half gf_1h, gf_2h.
    Fewer than three matches behind at half-time give the default 0.33.
    """
    behind = F.col("ht_gf") < F.col("ht_ga")
    total = F.coalesce(F.sum("gf_1h"), F.lit(0)) + F.coalesce(F.sum("gf_2h"), F.lit(0))
    n = F.count_if(behind)
    back = F.count_if(behind & (F.col("gf") >= F.col("ga")))
    return matches.groupBy("team").agg(
        F.round(F.when(total > 0, F.coalesce(F.sum("gf_1h"), F.lit(0)) / total).otherwise(0.5), 3).alias("ratio_1h"),
        n.alias("trailing_ht_n"), F.when(n >= 3, back / n).otherwise(0.33).alias("resilience"),
    )


def player_form(players: DataFrame) -> DataFrame:
    """Team attack from its outfield players' xG rates and play probabilities, mean 1.

    ``players``: team, pos, minutes, games, xg.
    """
    outfield = players.where((F.col("pos") != "G") & (F.col("minutes") > 0))
    p60 = play60(F.col("pos"), F.col("minutes") / F.greatest(F.col("games"), F.lit(1)), caps=(0.92, 0.90, 0.88))
    sums = outfield.groupBy("team").agg(F.sum(per90(F.col("xg"), F.col("minutes")) * p60).alias("_s"))
    return normalised_to_mean(sums, "_s", "form").select("team", "form")


def predict_fixtures(matches: DataFrame, ranks: DataFrame, fixtures: DataFrame, form: DataFrame, hosts: list[str], now: Column) -> DataFrame:
    """Strengths -> lambdas -> market blend -> outcome probabilities.

    ``fixtures``: event_id, home, away, odds_home, odds_draw, odds_away (odds may be null).
    """
    strengths = cp.team_strengths(matches, ranks, now)
    lambdas = cp.fixture_lambdas(fixtures, strengths, form, hosts)
    return cp.outcome_probabilities(cp.market_blend(lambdas))


def refresh_after_round(predictions: DataFrame, sides: DataFrame, ranks: DataFrame, round_weights: dict[int, float]) -> DataFrame:
    """Apply the form layer and recompute the probabilities from the new lambdas."""
    stale = ["p_home_win", "p_draw", "p_away_win", "ev_home", "ev_away"]
    return cp.outcome_probabilities(cp.form_layer(predictions.drop(*stale), sides, ranks, round_weights))


def weighted_matches(results: DataFrame, history: DataFrame, weights: dict[int, int]) -> DataFrame:
    """History plus new results that carry a multiplicity weight instead of repeated rows.

    A result whose (team, event_id) is in the history already is not added again.
    """
    w = None
    for k, v in weights.items():
        w = F.when(F.col("round_num") == k, F.lit(v)) if w is None else w.when(F.col("round_num") == k, F.lit(v))
    new = results.withColumn("weight", w).where(F.col("weight").isNotNull())
    new = new.join(history.select("team", "event_id"), ["team", "event_id"], "left_anti")
    old = history if "weight" in history.columns else history.withColumn("weight", F.lit(1))
    return old.unionByName(new, allowMissingColumns=True)


def effective_goals(xg: Column, goals: Column) -> Column:
    """80 % xG and 20 % goals; goals alone without xG."""
    return F.when(xg > 0, F.round(0.8 * xg + 0.2 * goals, 3)).otherwise(goals)
