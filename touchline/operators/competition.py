"""Standings, knockout brackets, strengths and fixture probabilities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import probability as pr
from touchline.functions.scalars import clamp, decay, implied_goals, implied_probability, or_default, without_margin
from touchline.operators.aggregates import weighted_mean
from touchline.operators.joins import match_sides, with_opponent
from touchline.operators.ordered import order_statistics, top_n, top_n_overall


def standings(fixtures: DataFrame, group: str | None = "grp") -> DataFrame:
    """Points table from results (two own-view rows per match)."""
    extra = {"grp": (group, group)} if group else {}
    sides = match_sides(fixtures.where(F.col("score_home").isNotNull() & F.col("score_away").isNotNull()), extra)
    keys = ["grp", "team"] if group else ["team"]
    pts = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    return sides.groupBy(*keys).agg(
        F.sum(pts).alias("pts"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
        F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.count("*").alias("played"),
    )


def _table_order() -> list:
    return [F.col("pts").desc(), F.col("gd").desc(), F.col("gf").desc(), F.col("team")]


def group_positions(table: DataFrame) -> DataFrame:
    """Every place of each group with its position key ('1A'). The table has one row a team."""
    ranked = table.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*_table_order())))
    return ranked.withColumn("position", F.concat(F.col("place").cast("string"), F.col("grp")))


def best_of_place(positions: DataFrame, place: int, n: int) -> DataFrame:
    """Best teams of one place across groups (best third-placed teams)."""
    order = [F.col("pts").desc(), F.col("gd").desc(), F.col("gf").desc(), F.col("grp")]
    return top_n_overall(positions.where(F.col("place") == place), order, n, "pool_rank")


def shootout_winner(home: Column, away: Column) -> Column:
    return F.when(home > away, "home").when(away > home, "away")


def winner_side(score_home: Column, score_away: Column, pens: Column, p_home: Column, p_away: Column) -> Column:
    """Real result (shoot-out first), else the model's favourite."""
    real = (
        F.when(pens == "home", "home").when(pens == "away", "away")
        .when(score_home > score_away, "home").when(score_away > score_home, "away")
        .when(score_home.isNotNull(), "home")
    )
    return F.coalesce(real, F.when(p_home >= p_away, "home").otherwise("away"))


def advance(edges: DataFrame, winners: DataFrame) -> DataFrame:
    """Next round's fixtures: winner of ``from_a`` meets winner of ``from_b``."""
    a = winners.select(F.col("event_id").alias("from_a"), F.col("winner").alias("home"))
    b = winners.select(F.col("event_id").alias("from_b"), F.col("winner").alias("away"))
    return edges.join(a, "from_a", "left").join(b, "from_b", "left").select("event_id", "home", "away")


def team_strengths(matches: DataFrame, ranks: DataFrame, now: Column, half_life_days: float = 365.0,
                   min_rank: float = 17.0, default_rank: float = 18.0) -> DataFrame:
    """Attack (alpha) and defence (beta) per team.

    ``matches``: team, opponent, gf, ga, date, is_cup, is_home, odds_home, odds_draw, odds_away and
    optionally ``weight`` (bag multiplicity). ``ranks``: team, rank_score. Goals are capped,
    adjusted to the rival's rank, weighted by recency and rank, blended with the rank prior
    and, where odds exist, with the market's implied goals.
    """
    rival = ranks.select(F.col("team").alias("opponent"), F.col("rank_score").alias("_opp"))
    m = matches.join(rival, "opponent", "left").withColumn("_opp", or_default(F.col("_opp"), default_rank))
    m = m.where((F.col("_opp") >= min_rank) & F.col("gf").isNotNull() & F.col("ga").isNotNull())
    copies = F.col("weight") if "weight" in matches.columns else F.lit(1.0)
    strength = 0.5 + F.col("_opp") / 100
    age = F.greatest(F.datediff(now, F.coalesce("date", now)), F.lit(0))
    w = copies * decay(age, half_life_days) * F.pow(F.col("_opp") / 100, F.when(F.coalesce("is_cup", F.lit(False)), 0.3).otherwise(0.6))
    own = F.when(F.col("is_home"), F.col("odds_home")).otherwise(F.col("odds_away"))
    p = [implied_probability(F.col(c)) for c in ("odds_home", "odds_draw", "odds_away")]
    quoted = F.col("odds_home").isNotNull() & F.col("odds_draw").isNotNull() & F.col("odds_away").isNotNull()
    market = F.when(quoted, implied_goals(without_margin(implied_probability(own), p[1], F.when(F.col("is_home"), p[2]).otherwise(p[0]))))
    m = m.withColumns({
        "_w": w, "_gf": F.least(F.least(F.col("gf"), F.lit(4)) * strength, F.lit(5.0)),
        "_ga": F.least(F.least(F.col("ga"), F.lit(4)) / F.greatest(strength, F.lit(0.3)), F.lit(5.0)), "_mk": market,
    })
    sums = m.groupBy("team").agg(
        F.sum(F.col("_gf") * F.col("_w")).alias("_sf"), F.sum(F.col("_ga") * F.col("_w")).alias("_sa"), F.sum("_w").alias("_sw"),
        weighted_mean(F.col("_mk"), F.col("_w")).alias("_im"), F.sum(F.when(F.col("_mk").isNotNull(), copies)).alias("_nq"),
    )
    mean = sums.agg(F.sum("_sf") / F.greatest(F.sum("_sw"), F.lit(0.01))).scalar()
    league = F.col("_lg")
    out = sums.join(ranks, "team", "full_outer").withColumn("rank_score", F.coalesce("rank_score", F.lit(40.0))).withColumn("_lg", mean)
    prior_a, prior_b = 0.7 + F.col("rank_score") / 100 * 0.6, 1.3 - F.col("rank_score") / 100 * 0.6
    n = F.coalesce("_sw", F.lit(0.0))
    trust = F.least(F.lit(1.0), n / 8.0)
    raw_a = F.coalesce(F.col("_sf") / F.nullif(n, F.lit(0.0)) / F.greatest(league, F.lit(0.01)), prior_a)
    raw_b = F.coalesce(F.col("_sa") / F.nullif(n, F.lit(0.0)) / F.greatest(league, F.lit(0.01)), prior_b)
    alpha = raw_a * trust + prior_a * (1 - trust)
    beta = F.greatest(F.lit(0.2), raw_b * trust + prior_b * (1 - trust))
    ow = F.least(F.lit(0.4), F.coalesce("_nq", F.lit(0)) / 20 * 0.4)
    alpha = F.when(F.col("_im").isNotNull(), alpha * (1 - ow) + F.col("_im") / F.greatest(league, F.lit(0.01)) * ow).otherwise(alpha)
    return out.select(
        "team", F.round(alpha, 4).alias("alpha"), F.round(beta, 4).alias("beta"), F.round(n, 2).alias("n_matches"),
        "rank_score", league.alias("league_avg"),
    )


def fixture_lambdas(fixtures: DataFrame, strengths: DataFrame, form: DataFrame, hosts: list[str], boost: float = 1.15) -> DataFrame:
    """Expected goals of both sides: attack x rival defence x league mean x host x form."""
    s = strengths.select("team", "alpha", "beta")
    f = form.select("team", "form")
    both = fixtures
    for side in ("home", "away"):
        dim = s.join(f, "team", "left").select(
            F.col("team").alias(side), F.col("alpha").alias(f"_a_{side}"), F.col("beta").alias(f"_b_{side}"),
            F.coalesce("form", F.lit(1.0)).alias(f"_f_{side}"),
        )
        both = both.join(dim, side, "left").fillna(1.0, [f"_a_{side}", f"_b_{side}", f"_f_{side}"])
    both = both.withColumn("_lg", strengths.agg(F.max("league_avg")).scalar())
    league = F.col("_lg")
    home_host, away_host = F.col("home").isin(hosts), F.col("away").isin(hosts)
    up, down = F.lit(boost), F.lit(boost**-0.5)
    mh = F.when(home_host, up).when(away_host, down).otherwise(1.0)
    ma = F.when(home_host, down).when(away_host, up).otherwise(1.0)
    lh = F.col("_a_home") * F.col("_b_away") * league * mh * (0.7 + 0.3 * F.col("_f_home"))
    la = F.col("_a_away") * F.col("_b_home") * league * ma * (0.7 + 0.3 * F.col("_f_away"))
    out = both.withColumn("lambda_home", clamp(lh, 0.2, 5.0)).withColumn("lambda_away", clamp(la, 0.2, 5.0))
    return out.drop("_lg", *[f"_{x}_{s}" for x in "abf" for s in ("home", "away")])


def market_blend(fixtures: DataFrame, weight: float = 0.6) -> DataFrame:
    """Blend lambdas with those that reproduce the market's home win probability."""
    odds = [F.col("odds_home"), F.col("odds_draw"), F.col("odds_away")]
    quoted = (odds[0] > 1) & (odds[1] > 1) & (odds[2] > 1)
    target = (1 / odds[0]) / (1 / odds[0] + 1 / odds[1] + 1 / odds[2])
    total = F.col("lambda_home") + F.col("lambda_away")
    out = fixtures.withColumn("_r", pr.market_ratio(F.when(quoted, total), F.when(quoted, target)))
    mh = F.coalesce(F.col("lambda_home") * (1 - weight) + total * F.col("_r") / (1 + F.col("_r")) * weight, F.col("lambda_home"))
    ma = F.coalesce(F.col("lambda_away") * (1 - weight) + total / (1 + F.col("_r")) * weight, F.col("lambda_away"))
    return out.withColumns({
        "lambda_home": clamp(mh, 0.2, 5.0), "lambda_away": clamp(ma, 0.2, 5.0), "market_used": F.col("_r").isNotNull(),
    }).drop("_r")


def outcome_probabilities(df: DataFrame, max_goals: int = 8, rho: float = -0.13) -> DataFrame:
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    gd = pr.goal_difference(lh, la, max_goals, rho)
    return df.withColumns({
        "p_home_win": F.round(pr.p_home_win(lh, la, max_goals, rho), 4), "p_draw": F.round(pr.p_draw(lh, la, max_goals, rho), 4),
        "p_away_win": F.round(pr.p_away_win(lh, la, max_goals, rho), 4), "ev_home": F.round(gd, 3), "ev_away": F.round(-gd, 3),
    })


def form_layer(lambdas: DataFrame, sides: DataFrame, ranks: DataFrame, round_weights: dict[int, float],
               league_adj: float = 1.05, weight: float = 0.35, cap=(0.60, 1.45)) -> DataFrame:
    """Post-round multiplier on lambdas: 80 % xG and 20 % goals, rank-adjusted, round-weighted.

    ``sides``: team, opponent, round_num, xg, gf. Probabilities are recomputed by the caller.
    """
    rival = ranks.select(F.col("team").alias("opponent"), F.col("rank_score").alias("_opp"))
    s = sides.join(rival, "opponent", "left").withColumn("_opp", F.coalesce("_opp", F.lit(30.0)))
    w = None
    for k, v in round_weights.items():
        w = F.when(F.col("round_num") == k, F.lit(v)) if w is None else w.when(F.col("round_num") == k, F.lit(v))
    adj = F.least((0.8 * F.coalesce("xg", F.lit(0.0)) + 0.2 * F.coalesce("gf", F.lit(0))) * (0.5 + F.col("_opp") / 100), F.lit(5.0))
    form = s.where(w.isNotNull()).groupBy("team").agg(weighted_mean(adj, w).alias("_adj"))
    mult = form.select("team", clamp((1 - weight) + F.col("_adj") / league_adj * weight, *cap).alias("mult"))
    out = lambdas
    for side in ("home", "away"):
        d = mult.select(F.col("team").alias(side), F.col("mult").alias("_m"))
        out = out.join(d, side, "left").withColumn(f"lambda_{side}", F.col(f"lambda_{side}") * F.coalesce("_m", F.lit(1.0))).drop("_m")
    return out


def tournament_form(sides: DataFrame, strengths: DataFrame, round_weights: dict[int, float], form_weight: float = 0.60,
                    weight_band=(0.25, 0.75), att_cap=(0.72, 1.18), def_cap=(0.65, 1.15)) -> DataFrame:
    """Attack and defence multipliers from tournament matches against own strength.

    ``sides``: team, opponent, round_num, gf, ga (already on a 90-minute basis). Goals are
    set against the rival's strengths; a harder schedule gives the form more weight.
    """
    w = None
    for k, v in round_weights.items():
        w = F.when(F.col("round_num") == k, F.lit(v)) if w is None else w.when(F.col("round_num") == k, F.lit(v))
    s = with_opponent(sides, strengths, ["alpha", "beta"], {"alpha": 1.3, "beta": 1.0}).withColumn("_w", w).where(w.isNotNull())
    per = s.groupBy("team").agg(
        weighted_mean(F.col("gf") / F.col("opp_beta"), F.col("_w")).alias("_gf"),
        weighted_mean(F.col("ga") / F.col("opp_alpha"), F.col("_w")).alias("_ga"),
        weighted_mean(F.col("opp_alpha"), F.col("_w")).alias("schedule"),
    )
    mean = per.agg(F.avg("schedule")).scalar()
    own = per.join(strengths.select("team", "alpha", "beta"), "team", "left").fillna({"alpha": 1.3, "beta": 1.0})
    fw = clamp(form_weight * F.col("schedule") / mean, *weight_band)
    return own.select(
        "team", "schedule", clamp((1 - fw) + fw * F.col("_gf") / F.col("alpha"), *att_cap).alias("att_mult"),
        clamp((1 - fw) + fw * F.col("_ga") / F.col("beta"), *def_cap).alias("def_mult"),
    )


def defence_against_history(sides: DataFrame, history: DataFrame, round_weights: dict[int, float], weight: float = 0.45, cap=(0.60, 1.35), league: float = 1.15) -> DataFrame:
    """Weighted goals conceded over the team's own historical rate, blended and clamped."""
    w = None
    for k, v in round_weights.items():
        w = F.when(F.col("round_num") == k, F.lit(v)) if w is None else w.when(F.col("round_num") == k, F.lit(v))
    per = sides.where(w.isNotNull()).groupBy("team").agg(weighted_mean(F.col("ga"), w).alias("gc_pg"))
    joined = per.join(history.select("team", F.col("gc_pg").alias("_hist")), "team", "left")
    ratio = F.col("gc_pg") / or_default(F.col("_hist"), league)
    return joined.select("team", "gc_pg", clamp((1 - weight) + weight * ratio, *cap).alias("def_mult"))


def knockout_lambdas(fixtures: DataFrame, strengths: DataFrame, form: DataFrame, hosts: list[str], host_adv=1.10, home_adv=1.02, floor=0.45) -> DataFrame:
    """Lambdas of neutral-ground fixtures from strengths and tournament form."""
    dim = strengths.join(form, "team", "left").fillna(1.0, ["att_mult", "def_mult"])
    out = fixtures
    for side in ("home", "away"):
        out = out.join(
            dim.select(
                F.col("team").alias(side), (F.col("alpha") * F.col("att_mult")).alias(f"_a_{side}"),
                F.greatest(F.lit(floor), F.col("beta") * F.col("def_mult")).alias(f"_d_{side}"),
            ), side, "left",
        ).fillna({f"_a_{side}": 1.3, f"_d_{side}": 1.0})
    adv = F.when(F.col("home").isin(hosts), host_adv).otherwise(home_adv)
    return out.withColumns({
        "lambda_home": F.round(F.col("_a_home") * F.col("_d_away") * adv, 4), "lambda_away": F.round(F.col("_a_away") * F.col("_d_home"), 4),
    }).drop("_a_home", "_d_home", "_a_away", "_d_away")


def quantile_bands(df: DataFrame, value: str, name: str = "band", low_is_hard: bool = True) -> DataFrame:
    """Five bands cut at nearest-rank quantiles sorted[int(n * p / 100)]."""
    cuts = order_statistics(df, [], value, {f"c{p}": (lambda n, p=p: F.floor(n * p / 100)) for p in (20, 40, 60, 80)})
    # one subquery per row set: the struct is a column first, its fields are read from there
    df = df.withColumn("_cuts", cuts.select(F.struct("c20", "c40", "c60", "c80")).scalar())
    c = F.col("_cuts")
    v = F.col(value)
    if low_is_hard:
        band = F.when(v <= c["c20"], 1).when(v <= c["c40"], 2).when(v <= c["c60"], 3).when(v <= c["c80"], 4).otherwise(5)
    else:
        band = F.when(v >= c["c80"], 1).when(v >= c["c60"], 2).when(v >= c["c40"], 3).when(v >= c["c20"], 4).otherwise(5)
    return df.withColumn(name, band).drop("_cuts")


def coach_values(fixtures: DataFrame, stats: DataFrame, league_avg: float, n: int = 8, max_goals: int = 6) -> DataFrame:
    """Expected value (win minus loss) of both coaches of each fixture, best ``n``."""
    dim = stats.select("team", (F.col("xg_pg") * 0.65 + F.col("gf_pg") * 0.35).alias("att"), F.col("xgc_pg").alias("def"))
    out = fixtures
    for side in ("home", "away"):
        out = out.join(dim.select(F.col("team").alias(side), F.col("att").alias(f"_a_{side}"), F.col("def").alias(f"_d_{side}")), side, "left")
        out = out.fillna(league_avg, [f"_a_{side}", f"_d_{side}"])
    base = max(league_avg, 0.01)
    out = out.withColumn("lambda_home", F.col("_a_home") * F.col("_d_away") / base * 1.15)
    out = out.withColumn("lambda_away", F.col("_a_away") * F.col("_d_home") / base * 0.85)
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    win, loss = pr.p_home_win(lh, la, max_goals, 0.0), pr.p_away_win(lh, la, max_goals, 0.0)
    out = out.withColumns({"ev_home": win - loss, "ev_away": loss - win, "p_draw": pr.p_draw(lh, la, max_goals, 0.0)})
    view = F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit(True).alias("is_home"), F.col("ev_home").alias("ev")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit(False).alias("is_home"), F.col("ev_away").alias("ev")),
    )
    sides = out.select("event_id", "p_draw", F.explode(view).alias("_s")).select("event_id", "p_draw", "_s.*")
    return top_n_overall(sides, [F.col("ev").desc(), F.col("event_id"), F.col("is_home").desc()], n)
