"""Tournament projections: gates, lineups, minutes and expected points per player and fixture."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import clamp, code_map, per90, season_xa, season_xg, shrink
from touchline.functions.scoring import (
    ASSIST_SHARE, CAPTAIN_SHARE, CUP_GOAL_SHARE, CUP_POINTS, FORM_XG_CAP, SET_PIECE_BONUS, adjust_bonus, archetype, blend_by_ratio,
    blend_club_country, blend_form, breakdown_total, expected_minutes, expected_points, play60, venue_multiplier, with_type_multipliers,
)
from touchline.functions.scoring import role as role_of
from touchline.operators import history
from touchline.operators.aggregates import mode_rows, positional_decay
from touchline.operators.joins import two_sides
from touchline.operators.ordered import next_after, top_n
from touchline.operators.podium import podium
from touchline.sources import feeds


def apply_gates(df: DataFrame, recent: str, gates: list[tuple], otherwise: tuple) -> DataFrame:
    """Ordered caps on participation; points follow the change of the play probability.

    ``gates`` are (recent minutes below, probability, expected minutes, role); rows above all
    gates keep their probability and take ``otherwise`` = (expected minutes, role).
    """
    p, mins, role = None, None, None
    for below, prob, exp, name in gates:
        cond = F.col(recent) < below
        p = F.when(cond, prob) if p is None else p.when(cond, prob)
        mins = F.when(cond, exp) if mins is None else mins.when(cond, exp)
        role = F.when(cond, name) if role is None else role.when(cond, name)
    new_p = p.otherwise(F.col("p_play"))
    scale = F.coalesce(new_p / F.nullif(F.col("p_play"), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("xpts", F.col("xpts") * scale).withColumns(
        {"p_play": new_p, "mins": mins.otherwise(otherwise[0]), "role": role.otherwise(otherwise[1])}
    )


def wide_players(rows: DataFrame, min_minutes: float = 5) -> DataFrame:
    """Players who cross much and shoot little: average crosses >= 2, more than twice the shots, shots <= 1.5.

    ``rows``: player_id, name, team, mins, crosses, shots per match.
    """
    per = rows.where(F.col("mins") >= min_minutes).groupBy("player_id").agg(
        F.min("name").alias("name"), F.min("team").alias("team"), F.avg("crosses").alias("avg_crosses"), F.avg("shots").alias("avg_shots"), F.count("*").alias("matches")
    )
    c, s = F.col("avg_crosses"), F.col("avg_shots")
    return per.where((c >= 2) & (c > 2 * s) & (s <= 1.5))


def squad_gaps(teams: DataFrame, squad: DataFrame, min_members: int = 20) -> DataFrame:
    """Teams without statistics or with too small a squad. ``teams``: team, has_stats (nullable)."""
    n = squad.groupBy("team").agg(F.count("*").alias("n"))
    out = teams.join(n, "team", "left").fillna(0, ["n"])
    return out.where(F.col("has_stats").isNull() | (F.col("n") < min_members))


def carry_lineups(played: DataFrame, squads: DataFrame, suspended: DataFrame, overrides: DataFrame) -> DataFrame:
    """Next round's lineup from the last one.

    ``played``: team, player_id, mins of the last round; ``squads``: team, player_id;
    ``suspended``: team, player_id; ``overrides``: player_id, status (manual absences).
    Suspended and absent players are missing, the eleven with most minutes start, the others
    who played come on, the rest of the squad rotates.
    """
    eleven = history.first_eleven(played.where(F.col("mins") > 0), ["team"], "mins", "player_id")
    rest = squads.join(eleven, ["team", "player_id"], "left_anti").withColumns({"status": F.lit("rotation"), "mins": F.lit(0)})
    base = eleven.select("team", "player_id", "status", "mins").unionByName(rest.select("team", "player_id", "status", "mins"))
    out = suspended.select("team", "player_id").distinct().withColumn("_susp", F.lit(True))
    manual = overrides.groupBy("player_id").agg(F.min("status").alias("_manual"))
    base = base.join(out, ["team", "player_id"], "left").join(manual, "player_id", "left")
    reason = F.when(F.col("_susp"), "suspension").when(F.col("_manual").isNotNull(), "manual")
    status = F.when(F.col("_susp"), "missing").otherwise(F.coalesce("_manual", "status"))
    return base.select("team", "player_id", status.alias("status"), reason.alias("reason"), "mins")


def suspended_next(inc: DataFrame, played: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Players sent off, with the next fixture of their team that they miss: player_id, team, event_id (of that fixture).

    ``inc``: flattened incidents whose team_id is the team; ``played``: event_id, round_num of the matches they are of;
    ``fixtures``: event_id, home, away, round_num of all. The next fixture is the team's first one of a later round.
    """
    out = feeds.cards(inc).where("misses_next").join(played.select("event_id", "round_num"), "event_id")
    out = out.select("player_id", F.col("team_id").alias("team"), "round_num").where(F.col("player_id").isNotNull() & F.col("team").isNotNull()).distinct()
    calendar = fixtures.select("event_id", "round_num", F.explode(F.array("home", "away")).alias("team"))
    found = next_after(out, calendar, ["team"], "round_num", "round_num", ["event_id"], ["event_id"])
    return found.where(F.col("next_event_id").isNotNull()).select("player_id", "team", F.col("next_event_id").alias("event_id")).distinct()


def carry_with_suspensions(lineups: DataFrame, inc: DataFrame, played: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``lineups`` (event_id, team, player_id, status, reason) in which sent-off players miss their team's next fixture.

    An entry of the player in that fixture is replaced; one without an entry, or a fixture without any lineup, gets it.
    """
    missing = suspended_next(inc, played, fixtures).withColumns({"status": F.lit("missing"), "reason": F.lit("suspension")})
    stays = lineups.join(missing.select("event_id", "player_id"), ["event_id", "player_id"], "left_anti")
    return stays.unionByName(missing, allowMissingColumns=True)


def match_records(lineup: DataFrame, inc: DataFrame, stats: DataFrame) -> DataFrame:
    """Player rows of played matches: exact minutes, cards, metrics with fallbacks.

    ``lineup`` as in ``history.player_minutes``; ``inc`` flattened incidents; ``stats``: match_id,
    player_id, goals, assists, rating, xg, xa, saves, shots, key_passes.
    """
    subs = feeds.substitutions(inc).withColumnRenamed("event_id", "match_id")
    whistles = feeds.final_whistles(inc).withColumnRenamed("event_id", "match_id")
    minutes = history.player_minutes(lineup, subs, whistles)
    booked = feeds.cards(inc).groupBy(F.col("event_id").alias("match_id"), "player_id").agg(
        F.count_if(F.col("card") == "yellow").alias("yellow"), F.count_if(F.col("misses_next")).alias("red")
    )
    out = minutes.join(stats, ["match_id", "player_id"], "left").join(booked, ["match_id", "player_id"], "left")
    out = out.fillna(0, ["yellow", "red", "goals", "assists", "saves", "shots", "key_passes"])
    return feeds.player_match_rows(out)


def intake_flat(lists: DataFrame, home_id: str = "home_id", away_id: str = "away_id", min_minutes: int = 5) -> DataFrame:
    """Flat ordered player lists of knockout matches -> player rows of both sides.

    The second goalkeeper opens the away list. ``lists``: event_id, home_id, away_id, ordinal,
    player_id, name, position, mins, xg, xa, goals, shots, key_passes.
    """
    split = history.split_at_second(lists, ["event_id"], "ordinal", F.col("position") == "G", "_away")
    rows = feeds.player_match_rows(split.where(F.coalesce("mins", F.lit(0)) >= min_minutes))
    return rows.withColumns({
        "is_home": ~F.col("_away"), "team_id": F.when(F.col("_away"), F.col(away_id)).otherwise(F.col(home_id)),
        "status": F.when(F.col("mins") >= 60, "starter").otherwise("sub_in"),
    }).drop("_away")


def update_form(form: DataFrame, rows: DataFrame, weight: float, keep: int = 20, decay: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """Add match rows to the players' bounded history and recompute the decayed form.

    ``form``: player_id, event_id, ts, mins, xg, xa, weight. Returns (history, form per player).
    """
    new = rows.select("player_id", "event_id", "ts", "mins", "xg", "xa").withColumn("weight", F.lit(weight))
    newest = [F.col("ts").desc(), F.col("event_id")]
    kept = history.bounded_history(form, new, ["player_id"], "event_id", newest, keep).drop("position")
    values = {"form_xg_90": per90(F.col("xg"), F.col("mins")), "form_xa_90": per90(F.col("xa"), F.col("mins"))}
    level = positional_decay(kept, ["player_id"], newest, values, F.col("mins") >= 20, decay, keep, F.coalesce("weight", F.lit(1.0)))
    return kept, level


def club_and_country(events: DataFrame, stats: DataFrame, national: DataFrame, recent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Main club competition of each player and the totals with the national team.

    ``events``: player_id, event_id, ts, tournament, season, home_id, away_id; ``stats``: player_id,
    event_id and metrics; ``national``: player_id, national_id. ``recent`` limits the totals to the newest matches.
    """
    e = events.join(national, "player_id")
    with_country = (F.col("home_id") == F.col("national_id")) | (F.col("away_id") == F.col("national_id"))
    club = e.where(~with_country)
    league = mode_rows(club, ["player_id"], ["tournament", "season"])
    inside = club.join(league.drop("n"), ["player_id", "tournament", "season"]).select("player_id", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    main = league.join(mode_rows(inside, ["player_id"], ["team_id"]).drop("n"), "player_id")
    country = e.where(with_country)
    country = (top_n(country, ["player_id"], [F.col("ts").desc(), F.col("event_id")], recent) if recent else country).select("player_id", "event_id")
    metrics = [c for c in stats.columns if c not in ("player_id", "event_id")]
    totals = stats.join(country, ["player_id", "event_id"]).groupBy("player_id").agg(F.count("*").alias("games"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in metrics])
    return main, totals


def gate_by_recent_minutes(df: DataFrame, minutes: str) -> DataFrame:
    """Replace share and probability by recent minutes; points follow both ratios."""
    m = F.col(minutes)
    new_share, new_p = F.round(F.least(F.lit(1.0), m / 90), 3), F.round(clamp(m / 75, 0.05, 0.95), 2)
    scale = new_share / F.nullif(F.col("mins_share"), F.lit(0.0)) * (new_p / F.nullif(F.col("p_play"), F.lit(0.0)))
    fixed = F.col("lineup_status").isNotNull()
    role = F.when(fixed, F.col("role")).otherwise(F.when(new_p >= 0.80, "starter").when(new_p >= 0.50, "rotation").otherwise("substitute"))
    return df.withColumns({
        "xpts": F.when(m.isNull(), F.col("xpts")).otherwise(F.round(F.col("xpts") * F.coalesce(scale, F.lit(1.0)), 2)),
        "mins_share": F.when(m.isNull(), F.col("mins_share")).otherwise(new_share), "p_play": F.when(m.isNull(), F.col("p_play")).otherwise(new_p),
        "role": F.when(m.isNull(), F.col("role")).otherwise(role),
    })


def project_players(players: DataFrame, fixtures: DataFrame, teams: DataFrame, priors: DataFrame, lineup: DataFrame, roles: DataFrame, hosts: list[str]) -> DataFrame:
    """Expected points of every squad player in every fixture of the team.

    ``players``: player_id, name, team, pos, club_quality, schedule_quality, club and national
    totals (club_mins, club_games, club_xg, club_xa, shots, key_passes, yellow, intl_mins,
    intl_games, intl_xg, intl_xa), form_xg_90, form_xa_90, form_n, consistency.
    ``fixtures``: event_id, home, away, lambda_home, lambda_away. ``teams``: team, def_score, gf_pg,
    gc_pg, xgc_pg, box_vuln, wide_vuln. ``priors``: pos, prior_xg, prior_xa. ``lineup``: event_id,
    player_id, status. ``roles``: player_id, role from the set-piece lists.
    """
    sides = two_sides(
        fixtures, {"team": "home", "opponent": "away", "lam_opp": "lambda_away"}, {"team": "away", "opponent": "home", "lam_opp": "lambda_home"}, ["event_id"]
    )
    bonus = roles.withColumns({"_bx": code_map(F.col("role"), {k: v[0] for k, v in SET_PIECE_BONUS.items()}, 0.0), "_ba": code_map(F.col("role"), {k: v[1] for k, v in SET_PIECE_BONUS.items()}, 0.0)})
    pk = F.when(F.max(F.col("role") == "pk_primary"), 0.12).when(F.max(F.col("role") == "pk_secondary"), 0.06).otherwise(0.0)
    bonus = bonus.groupBy("player_id").agg(F.sum("_bx").alias("_bx"), F.sum("_ba").alias("_ba"), pk.alias("_pk"))
    p = players.where((F.col("club_mins") >= 200) | (F.col("intl_games") >= 3)).join(bonus, "player_id", "left").fillna(0.0, ["_bx", "_ba", "_pk"])
    q, iq = F.col("club_quality"), F.col("schedule_quality")
    pos, n, i = F.col("pos"), F.col("club_games"), F.col("intl_games")
    club_mins, intl_mins = F.greatest(F.col("club_mins"), F.lit(1)), F.greatest(F.col("intl_mins"), F.lit(1))
    cx, ca = season_xg(F.col("club_xg"), F.col("shots")) / club_mins * 90 * q, season_xa(F.col("club_xa"), F.col("key_passes")) / club_mins * 90 * q
    played = i > 0
    ix, ia = F.when(played, F.col("intl_xg") / intl_mins * 90 * iq), F.when(played, F.col("intl_xa") / intl_mins * 90 * iq)
    p = p.withColumns({"_cx": cx, "_ca": ca, "_ix": ix, "_ia": ia})
    # the ratio of the xG rates decides the weights of both rates
    c, t = F.col("_cx"), F.col("_ix")
    xg = blend_by_ratio(pos, c, t, i, blend_club_country(c, n, t, i))
    w = F.when(t.isNotNull() & (c != t), (xg - t) / F.nullif(c - t, F.lit(0.0)))
    xa = F.coalesce(w * F.col("_ca") + (1 - w) * F.coalesce("_ia", F.lit(0.0)), blend_club_country(F.col("_ca"), n, F.col("_ia"), i))
    p = p.withColumns({"_x": xg + F.col("_bx"), "_a": xa + F.col("_ba")})
    few = F.when(n < 15, (15 - n) / 15 * 0.25).otherwise(0.0)
    fw = F.least(F.lit(0.75), 0.62 + few)
    p = p.withColumns({
        "_x": blend_form(F.col("_x"), F.col("form_xg_90"), code_map(pos, FORM_XG_CAP, 0.80), fw), "_a": blend_form(F.col("_a"), F.col("form_xa_90"), F.lit(0.80), fw),
    }).join(priors, "pos", "left")
    eff = n + i * 0.5
    p = p.withColumns({
        "xg_90": F.round(shrink(F.col("_x"), eff, F.coalesce("prior_xg", "_x"), 8.0), 4), "xa_90": F.round(shrink(F.col("_a"), eff, F.coalesce("prior_xa", "_a"), 8.0), 4),
    })
    base = F.greatest(n, F.lit(1)) * 90
    p = p.withColumn("player_type", archetype(pos, F.col("xg_90"), F.col("xa_90"), F.col("shots") / base * 90, F.col("key_passes") / base * 90, cup=True))
    rival = teams.select(F.col("team").alias("opponent"), F.col("def_score").alias("opp_def"), F.col("xgc_pg").alias("opp_xgc"), F.col("box_vuln").alias("opp_box"), F.col("wide_vuln").alias("opp_wide"))
    own = teams.select("team", F.col("gf_pg").alias("own_gf"), F.col("xgc_pg").alias("own_xgc"))
    f = sides.join(p, "team").join(own, "team", "left").join(rival, "opponent", "left").join(lineup.select("event_id", "player_id", F.col("status").alias("lineup_status")), ["event_id", "player_id"], "left")
    f = with_type_multipliers(f, "opp_box", "opp_wide")
    avg = F.coalesce(F.when(i > 0, F.col("intl_mins") / i), F.lit(0.0))
    st = F.col("lineup_status")
    p60 = F.when(st == "starter", 0.92).when(st == "substitute", 0.08).when(st == "rotation", 0.45).when(st == "missing", 0.02).otherwise(play60(pos, avg, (0.92, 0.90, 0.88), 0.08))
    mins = F.when(st == "starter", 85).when(st == "substitute", 25).when(st == "rotation", 55).when(st == "missing", 0).when(pos == "G", 5).otherwise(expected_minutes(avg, 85))
    part = F.when(st.isNotNull(), st).when(pos == "G", "substitute").otherwise(role_of(avg))
    bias = F.when(st.isNull(), F.least(F.lit(1.0), i / 10) * 0.10).otherwise(0.0)
    f = f.withColumns({"p_play": F.round(F.least(F.lit(0.95), p60 + bias), 2), "mins_share": mins / 90, "role": part})
    venue = venue_multiplier(F.col("is_home"), F.col("team"), F.col("opponent"), hosts)
    strength = (1 + (50 - F.coalesce("opp_def", F.lit(50.0))) / 100 * 0.50) * venue * F.col("mins_share")
    lam = F.coalesce("lam_opp", F.lit(0.90))
    f = f.withColumns({
        "p_goal": F.least(F.lit(0.45), F.col("xg_90") * strength * F.col("goal_mult") * code_map(pos, CUP_GOAL_SHARE, 0.3)),
        "p_assist": F.least(F.lit(0.45), F.col("xa_90") * strength * F.col("assist_mult") * code_map(pos, ASSIST_SHARE, 0.3)),
        "p_cs": clamp(F.exp(-lam), 0.03, 0.65),
    })
    saves = F.round((F.least(lam, F.lit(1.8)) * 0.60 + F.coalesce("own_xgc", F.lit(0.90)) * 0.40) / 0.30 * 0.70, 2)
    goals = F.coalesce("own_gf", F.lit(0.90)) * F.coalesce("opp_xgc", F.lit(0.90)) / 0.90 * F.when(F.col("is_home"), 1.10).otherwise(0.90)
    cards = F.when(n > 0, F.col("yellow") / n).otherwise(0.0)
    b = expected_points(pos, F.col("p_goal"), F.col("p_assist"), F.col("p_cs"), F.col("mins_share"), cards, goals, saves, CUP_POINTS, 0.072)
    keeper = F.when(pos == "G", 0.15 * 0.28 * 5 * F.col("mins_share")).otherwise(0.0)
    spot = F.col("_pk") * F.col("mins_share") * (3 - code_map(pos, CUP_POINTS["goal"], 5.0))
    steady = F.when((F.col("form_n") >= 3) & F.col("consistency").isNotNull(), 0.94 + 0.12 * F.col("consistency") / 100).otherwise(1.0)
    f = f.withColumn("breakdown", b).withColumn("xpts", F.round((breakdown_total(F.col("breakdown")) + keeper + spot) * F.col("p_play") * steady, 2))
    f = f.withColumn("cap_score", F.round(F.col("xpts") * code_map(pos, CAPTAIN_SHARE, 1.0), 2))
    return f.select(
        "event_id", "player_id", "name", "team", "opponent", "is_home", "pos", "player_type", "role", "lineup_status", "p_play", "mins_share", "xg_90", "xa_90",
        "p_goal", "p_assist", "p_cs", "breakdown", "xpts", "cap_score",
    )


def add_podium(projection: DataFrame, ratings: DataFrame, sigma: float = 0.40) -> DataFrame:
    """Add the expected bonus of finishing among the best three of a match.

    ``ratings``: player_id, avg_rating; players without a rating get no bonus.
    """
    pool = podium(projection.join(ratings, "player_id").select("event_id", "player_id", "avg_rating"), ["event_id"], "player_id", F.col("avg_rating"), sigma)
    out = projection.join(pool.select("event_id", "player_id", "podium_points"), ["event_id", "player_id"], "left")
    bonus = adjust_bonus(F.coalesce("podium_points", F.lit(0.0)), F.col("pos"), F.col("p_cs"))
    return out.withColumn("bonus", bonus).withColumn("xpts", F.round(F.col("xpts") + F.col("bonus"), 3)).drop("podium_points")
