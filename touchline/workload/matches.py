"""Standings, strengths, score probabilities and brackets on derived fixtures."""
from __future__ import annotations

from math import factorial

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import probability as pr
from touchline.operators import competition as cp
from touchline.operators.joins import match_sides, unordered_pair
from touchline.plans import bracket, strength
from touchline.session import durable
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, rnd

NOW = "2001-08-02"
TABLE_SQL = FIXTURES_SQL + """,
gs AS (SELECT event_id, grp, home AS team, score_home AS gf, score_away AS ga FROM fixtures UNION ALL SELECT event_id, grp, away, score_away, score_home FROM fixtures),
tbl AS (SELECT grp, team, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS pts, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(gf - ga) AS BIGINT) AS gd, count(*) AS played FROM gs GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pts DESC, gd DESC, gf DESC, team) AS place FROM tbl)"""


@query("standings", "D18, B11", f"WITH {TABLE_SQL} SELECT * FROM tbl")
def _(t):
    return cp.standings(t.fixtures())


@query("group_positions", "E05", f"WITH {TABLE_SQL} SELECT grp, team, pts, CAST(place AS VARCHAR) || grp AS position FROM pos")
def _(t):
    return cp.group_positions(cp.standings(t.fixtures())).select("grp", "team", "pts", "position")


@query("best_third_places", "E06", f"WITH {TABLE_SQL} SELECT grp, team, row_number() OVER (ORDER BY pts DESC, gd DESC, gf DESC, grp) AS pool_rank FROM pos WHERE place = 3 ORDER BY pts DESC, gd DESC, gf DESC, grp LIMIT 4")
def _(t):
    out = cp.best_of_place(cp.group_positions(cp.standings(t.fixtures())), 3, 4)
    return out.select("grp", "team", F.col("pool_rank").cast("long").alias("pool_rank"))


LAMBDA_SQL = FIXTURES_SQL + """,
st AS (SELECT team, avg(gf) AS att, avg(ga) AS def FROM sides GROUP BY 1),
lam AS (SELECT event_id, home, away, h.att * a.def / 2 AS lh, a.att * h.def / 2 AS la FROM fixtures JOIN st h ON h.team = home JOIN st a ON a.team = away),
cells AS (SELECT event_id, lh, la, i, j, exp(-lh) * lh ** i / factorial(CAST(i AS INTEGER)) * exp(-la) * la ** j / factorial(CAST(j AS INTEGER)) *
   CASE WHEN i = 0 AND j = 0 THEN 1 + 0.13 * lh * la WHEN i = 1 AND j = 0 THEN 1 - 0.13 * la WHEN i = 0 AND j = 1 THEN 1 - 0.13 * lh WHEN i = 1 AND j = 1 THEN 1.13 ELSE 1 END AS p
   FROM lam, generate_series(0, 8) gi(i), generate_series(0, 8) gj(j))"""


def lambdas(t):
    s = t.sides().groupBy("team").agg(F.avg("gf").alias("att"), F.avg("ga").alias("def"))
    f = t.fixtures().select("event_id", "home", "away")
    for side in ("home", "away"):
        f = f.join(s.select(F.col("team").alias(side), F.col("att").alias(f"att_{side}"), F.col("def").alias(f"def_{side}")), side)
    return f.select(
        "event_id", "home", "away", (F.col("att_home") * F.col("def_away") / 2).alias("lambda_home"), (F.col("att_away") * F.col("def_home") / 2).alias("lambda_away")
    )


@query("outcome_probabilities", "H09, H08, C18", f"""WITH {LAMBDA_SQL} SELECT event_id, {rnd('sum(p) FILTER (i > j)')} AS p_home_win, {rnd('sum(p) FILTER (i = j)')} AS p_draw, {rnd('sum(p) FILTER (i < j)')} AS p_away_win, {rnd('sum(p * (i - j))', 3)} AS ev_home FROM cells GROUP BY 1""")
def _(t):
    return cp.outcome_probabilities(lambdas(t)).select("event_id", "p_home_win", "p_draw", "p_away_win", "ev_home")


@query("top_scorelines", "F05, H09", f"""WITH {LAMBDA_SQL}, r AS (SELECT event_id, i, j, p, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, i, j) AS k FROM cells)
SELECT event_id, string_agg(CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR), ',' ORDER BY k) AS scores FROM r WHERE k <= 3 GROUP BY 1""")
def _(t):
    f = pr.with_goal_masses(lambdas(t), "lambda_home", "lambda_away")
    return f.select("event_id", F.array_join(pr.top_scores(F.col("lambda_home"), F.col("lambda_away")), ",").alias("scores"))


@query("score_map_mass", "C18, H09", f"WITH {LAMBDA_SQL} SELECT event_id, count(*) FILTER (p > 0.005) AS n_scores, {rnd('sum(p)')} AS mass FROM cells GROUP BY 1")
def _(t):
    lh, la = F.col("lambda_home"), F.col("lambda_away")
    f = pr.with_goal_masses(lambdas(t), "lambda_home", "lambda_away")
    g = f.select("event_id", pr.score_grid(lh, la).alias("g"), pr.score_mass(lh, la).alias("mass"))
    return g.select("event_id", F.size(pr.score_map(F.col("g"))).cast("long").alias("n_scores"), F.round("mass", 4).alias("mass"))


def win_sql(h: str, a: str) -> str:
    """Home-win probability of two lambdas on the 0..8 grid with the low-score correction."""
    below = lambda i: " + ".join(f"pow({a}, {j}) / {factorial(j)}.0" for j in range(i))
    cells = " + ".join(f"pow({h}, {i}) / {factorial(i)}.0 * ({below(i)})" for i in range(1, 9))
    return f"exp(-({h} + {a})) * ({cells} - 0.13 * {h} * {a})"


MARKET_SQL = f"""WITH RECURSIVE {LAMBDA_SQL}, q AS (SELECT event_id, lh, la, lh + la AS total, 1.8::DOUBLE + (event_id % 7) / 5 AS o1, 3.0::DOUBLE + (event_id % 3) / 4 AS o2, 2.2::DOUBLE + (event_id % 5) / 3 AS o3 FROM lam),
search AS (SELECT event_id, total, (1 / o1) / (1 / o1 + 1 / o2 + 1 / o3) AS goal, 0.05::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS step FROM q
  UNION ALL SELECT event_id, total, goal, CASE WHEN win > goal THEN lo ELSE r END, CASE WHEN win > goal THEN r ELSE hi END, step + 1
  FROM (SELECT *, {win_sql("(total * r / (1 + r))", "(total / (1 + r))")} AS win FROM (SELECT *, (lo + hi) / 2 AS r FROM search WHERE step < 25))),
found AS (SELECT event_id, (lo + hi) / 2 AS r FROM search WHERE step = 25)
SELECT event_id, TRUE AS market_used, {rnd('greatest(0.2, least(5.0, lh * 0.4 + total * r / (1 + r) * 0.6))')} AS lambda_home, {rnd('greatest(0.2, least(5.0, la * 0.4 + total / (1 + r) * 0.6))')} AS lambda_away FROM q JOIN found USING (event_id)"""


@query("market_calibration", "K06, H10, L09", MARKET_SQL)
def _(t):
    """Lambdas blended 60 to 40 with those whose home-win probability is the market's."""
    k = F.col("event_id")
    f = lambdas(t).withColumns({"odds_home": 1.8 + (k % 7) / 5, "odds_draw": 3.0 + (k % 3) / 4, "odds_away": 2.2 + (k % 5) / 3})
    out = cp.market_blend(f)
    return out.select("event_id", "market_used", F.round("lambda_home", 4).alias("lambda_home"), F.round("lambda_away", 4).alias("lambda_away"))


RANK_SQL = FIXTURES_SQL + """,
rk AS (SELECT n_name AS team, 15.0 + n_nationkey * 3 AS rank_score FROM nation),
mm AS (SELECT s.team, s.gf, s.ga, s.is_home, r.rank_score AS o, exp(-0.693 * date_diff('day', s.played, DATE '2001-08-02') / 365.0) * (r.rank_score / 100) ** (CASE WHEN s.round_num = 6 THEN 0.3 ELSE 0.6 END) AS w,
   CASE WHEN s.event_id % 4 = 0 THEN greatest(0.3, least(4.0, -ln(greatest(1 - (CASE WHEN s.is_home THEN 1 / (1.5 + s.event_id % 5) ELSE 1 / (2.0 + s.event_id % 3) END) / (1 / (1.5 + s.event_id % 5) + 1 / 3.4 + 1 / (2.0 + s.event_id % 3)), 0.01)) * 1.8)) END AS mk
   FROM sides s JOIN rk r ON r.team = s.opponent WHERE r.rank_score >= 17),
ss AS (SELECT team, sum(least(least(gf, 4) * (0.5 + o / 100), 5.0) * w) AS sf, sum(least(least(ga, 4) / greatest(0.5 + o / 100, 0.3), 5.0) * w) AS sa, sum(w) AS sw, sum(mk * w) / sum(CASE WHEN mk IS NOT NULL THEN w END) AS im, count(mk) AS nq FROM mm GROUP BY 1),
lg AS (SELECT sum(sf) / sum(sw) AS lg FROM ss),
al AS (SELECT rk.team, rank_score, lg, coalesce(sw, 0) AS n, coalesce(sf / sw / lg, 0.7 + rank_score / 100 * 0.6) * least(1.0, coalesce(sw, 0) / 8) + (0.7 + rank_score / 100 * 0.6) * (1 - least(1.0, coalesce(sw, 0) / 8)) AS a0,
   greatest(0.2, coalesce(sa / sw / lg, 1.3 - rank_score / 100 * 0.6) * least(1.0, coalesce(sw, 0) / 8) + (1.3 - rank_score / 100 * 0.6) * (1 - least(1.0, coalesce(sw, 0) / 8))) AS beta, im, least(0.4, coalesce(nq, 0) / 20 * 0.4) AS ow FROM rk LEFT JOIN ss USING (team), lg),
str AS (SELECT team, round(CASE WHEN im IS NOT NULL THEN a0 * (1 - ow) + im / lg * ow ELSE a0 END, 4) AS alpha, round(beta, 4) AS beta, round(n, 2) AS n_matches, lg FROM al)"""


def ranks(t):
    return t.nation.select(F.col("n_name").alias("team"), (F.lit(15.0) + F.col("n_nationkey") * 3).alias("rank_score"))


def rated_matches(t):
    k = F.col("event_id")
    quoted = k % 4 == 0
    return t.sides().withColumns({
        "date": F.col("played"), "is_cup": F.col("round_num") == 6, "odds_home": F.when(quoted, 1.5 + k % 5), "odds_draw": F.when(quoted, F.lit(3.4)),
        "odds_away": F.when(quoted, 2.0 + k % 3),
    })


def strengths(t):
    return cp.team_strengths(rated_matches(t), ranks(t), F.lit(NOW).cast("date"))


@query("team_strengths", "L08, D10, H10, H11", f"WITH {RANK_SQL} SELECT team, {rnd('alpha', 3)} AS alpha, {rnd('beta', 3)} AS beta, {rnd('n_matches', 1)} AS n_matches FROM str")
def _(t):
    return strengths(t).select("team", F.round("alpha", 3).alias("alpha"), F.round("beta", 3).alias("beta"), F.round("n_matches", 1).alias("n_matches"))


PRED_SQL = RANK_SQL + """,
fx AS (SELECT home || '|' || away AS pair, home, away FROM fixtures GROUP BY ALL),
pl AS (SELECT pair, home, away, greatest(0.2, least(5.0, h.alpha * a.beta * h.lg * CASE WHEN home IN ('NATION_1', 'NATION_2') THEN 1.15 WHEN away IN ('NATION_1', 'NATION_2') THEN 1.15 ** -0.5 ELSE 1.0 END)) AS lh,
   greatest(0.2, least(5.0, a.alpha * h.beta * h.lg * CASE WHEN home IN ('NATION_1', 'NATION_2') THEN 1.15 ** -0.5 WHEN away IN ('NATION_1', 'NATION_2') THEN 1.15 ELSE 1.0 END)) AS la FROM fx JOIN str h ON h.team = home JOIN str a ON a.team = away)"""


@query("fixture_predictions", "L09, H28, D31", f"""WITH {PRED_SQL}, c AS (SELECT pair, lh, la, i, j, exp(-lh) * lh ** i / factorial(CAST(i AS INTEGER)) * exp(-la) * la ** j / factorial(CAST(j AS INTEGER)) AS p FROM pl, generate_series(0, 8) gi(i), generate_series(0, 8) gj(j))
SELECT pair, {rnd('any_value(lh)', 3)} AS lambda_home, {rnd('any_value(la)', 3)} AS lambda_away, {rnd('sum(p) FILTER (i > j) - 0.13 * any_value(lh * la * exp(-lh - la))', 4)} AS p_home_win FROM c GROUP BY 1""")
def _(t):
    fx = t.fixtures().select(F.concat_ws("|", "home", "away").alias("event_id"), "home", "away").distinct()
    fx = fx.withColumns({c: F.lit(None).cast("double") for c in ("odds_home", "odds_draw", "odds_away")})
    s = durable(strengths(t))
    form = s.select("team", F.lit(1.0).alias("form"))
    f = cp.fixture_lambdas(fx, s, form, ["NATION_1", "NATION_2"])
    out = cp.outcome_probabilities(cp.market_blend(f))
    return out.select(F.col("event_id").alias("pair"), F.round("lambda_home", 3).alias("lambda_home"), F.round("lambda_away", 3).alias("lambda_away"), "p_home_win")


@query("form_layer", "L10, D07, C16", f"""WITH {LAMBDA_SQL}, rk AS (SELECT n_name AS team, 15.0 + n_nationkey * 3 AS rank_score FROM nation),
ad AS (SELECT s.team, sum(least((0.8 * xg + 0.2 * gf) * (0.5 + rank_score / 100), 5.0) * round_num) / sum(round_num) AS adj FROM sides s JOIN rk ON rk.team = s.opponent WHERE round_num <= 3 GROUP BY 1),
mu AS (SELECT team, greatest(0.6, least(1.45, 0.65 + adj / 1.05 * 0.35)) AS m FROM ad)
SELECT event_id, {rnd('lh * coalesce(h.m, 1)', 3)} AS lambda_home, {rnd('la * coalesce(a.m, 1)', 3)} AS lambda_away FROM lam LEFT JOIN mu h ON h.team = home LEFT JOIN mu a ON a.team = away""")
def _(t):
    out = strength.refresh_after_round(lambdas(t), t.sides(), ranks(t), {1: 1.0, 2: 2.0, 3: 3.0})
    return out.select("event_id", F.round("lambda_home", 3).alias("lambda_home"), F.round("lambda_away", 3).alias("lambda_away"))


TOUR_SQL = RANK_SQL + """,
tw AS (SELECT s.team, s.gf, s.ga, o.alpha AS oa, o.beta AS ob, CASE round_num WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 WHEN 3 THEN 0.25 WHEN 4 THEN 3.0 END AS w FROM sides s JOIN str o ON o.team = s.opponent WHERE round_num <= 4),
tp AS (SELECT team, sum(gf / ob * w) / sum(w) AS g, sum(ga / oa * w) / sum(w) AS c, sum(oa * w) / sum(w) AS sch FROM tw GROUP BY 1),
tf AS (SELECT tp.team, sch, greatest(0.25, least(0.75, 0.6 * sch / (SELECT avg(sch) FROM tp))) AS fw, g, c, alpha, beta FROM tp JOIN str USING (team)),
tour AS (SELECT team, sch, greatest(0.72, least(1.18, 1 - fw + fw * g / alpha)) AS att_mult, greatest(0.65, least(1.15, 1 - fw + fw * c / beta)) AS def_mult FROM tf)"""
ROUND_WEIGHTS = {1: 1.5, 2: 2.0, 3: 0.25, 4: 3.0}


@query("tournament_form", "D37, C16", f"WITH {TOUR_SQL} SELECT team, {rnd('sch', 3)} AS schedule, {rnd('att_mult', 3)} AS att_mult, {rnd('def_mult', 3)} AS def_mult FROM tour")
def _(t):
    out = cp.tournament_form(t.sides(), durable(strengths(t)), ROUND_WEIGHTS)
    return out.select("team", *[F.round(c, 3).alias(c) for c in ("schedule", "att_mult", "def_mult")])


@query("defence_against_history", "D38", f"""WITH {FIXTURES_SQL}, h AS (SELECT team, avg(ga) AS hist FROM sides WHERE round_num > 4 GROUP BY 1), w AS (SELECT team, ga, CASE round_num WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 WHEN 3 THEN 0.25 ELSE 3.0 END AS w FROM sides WHERE round_num <= 4)
SELECT team, {rnd('sum(ga * w) / sum(w)')} AS gc_pg, {rnd('greatest(0.6, least(1.35, 0.55 + 0.45 * (sum(ga * w) / sum(w)) / any_value(hist)))')} AS def_mult FROM w JOIN h USING (team) GROUP BY 1""")
def _(t):
    s = t.sides()
    hist = s.where(F.col("round_num") > 4).groupBy("team").agg(F.avg("ga").alias("gc_pg"))
    out = cp.defence_against_history(s, hist, ROUND_WEIGHTS)
    return out.select("team", F.round("gc_pg", 4).alias("gc_pg"), F.round("def_mult", 4).alias("def_mult"))


@query("coach_values", "L17, F08, H08", f"""WITH {FIXTURES_SQL}, s AS (SELECT team, avg(xg) * 0.65 + avg(gf) * 0.35 AS att, avg(opp_xg) AS def FROM sides GROUP BY 1),
fx AS (SELECT min(event_id) AS event_id, home, away FROM fixtures GROUP BY home, away), l AS (SELECT event_id, home, away, h.att * a.def / 1.25 * 1.15 AS lh, a.att * h.def / 1.25 * 0.85 AS la FROM fx JOIN s h ON h.team = home JOIN s a ON a.team = away),
c AS (SELECT event_id, home, away, i, j, exp(-lh) * lh ** i / factorial(CAST(i AS INTEGER)) * exp(-la) * la ** j / factorial(CAST(j AS INTEGER)) AS p FROM l, generate_series(0, 6) gi(i), generate_series(0, 6) gj(j)),
e AS (SELECT event_id, home, away, sum(p) FILTER (i > j) - sum(p) FILTER (i < j) AS ev FROM c GROUP BY ALL), v AS (SELECT event_id, home AS team, away AS opponent, TRUE AS is_home, ev FROM e UNION ALL SELECT event_id, away, home, FALSE, -ev FROM e)
SELECT team, opponent, is_home, {rnd('ev')} AS ev FROM v ORDER BY ev DESC, event_id, is_home DESC LIMIT 8""")
def _(t):
    stats = t.sides().groupBy("team").agg(F.avg("xg").alias("xg_pg"), F.avg("gf").alias("gf_pg"), F.avg("opp_xg").alias("xgc_pg"))
    fx = t.fixtures().groupBy("home", "away").agg(F.min("event_id").alias("event_id"))
    return cp.coach_values(fx, stats, 1.25).select("team", "opponent", "is_home", F.round("ev", 4).alias("ev"))


@query("schedule_quality", "D08, C09", f"""WITH {FIXTURES_SQL}, rk AS (SELECT n_name AS team, 15.0 + n_nationkey * 3 AS r FROM nation)
SELECT s.team, {rnd('greatest(0.60, least(0.92, 0.60 + (sum(r * r ** 1.5) / sum(r ** 1.5) - 12) / 63 * 0.32))', 3)} AS quality FROM sides s JOIN rk ON rk.team = s.opponent GROUP BY 1""")
def _(t):
    from touchline.operators.aggregates import schedule_quality
    from touchline.operators.joins import with_opponent

    s = with_opponent(t.sides(), ranks(t), ["rank_score"])
    return s.groupBy("team").agg(schedule_quality(F.col("opp_rank_score")).alias("quality"))


@query("shootout_winners", "H29", f"WITH {FIXTURES_SQL} SELECT event_id, CASE WHEN xg_home > xg_away THEN 'home' WHEN xg_away > xg_home THEN 'away' END AS pens_winner FROM fixtures WHERE score_home = score_away")
def _(t):
    f = t.fixtures().where(F.col("score_home") == F.col("score_away"))
    return f.select("event_id", cp.shootout_winner(F.col("xg_home"), F.col("xg_away")).alias("pens_winner"))


#: Fixtures of each round for the five regions: two a group, then winners of neighbours, an odd one passing.
LEVELS = [10, 5, 3, 2, 1]


def _bracket_sql() -> str:
    sql = f"""WITH {TOUR_SQL.replace("WITH ", "")},
gs AS (SELECT grp, home AS team, score_home AS gf, score_away AS ga FROM fixtures UNION ALL SELECT grp, away, score_away, score_home FROM fixtures),
tbl AS (SELECT grp, team, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS pts, sum(gf) AS gf, sum(gf - ga) AS gd FROM gs GROUP BY 1, 2),
own AS (SELECT tbl.* FROM tbl JOIN nation ON n_name = team JOIN region ON r_regionkey = n_regionkey WHERE r_name = grp),
pos AS (SELECT team, CAST(row_number() OVER (PARTITION BY grp ORDER BY pts DESC, gd DESC, gf DESC, team) AS VARCHAR) || grp AS position FROM own),
last AS (SELECT least(home, away) || '|' || greatest(home, away) AS pair, arg_max(home, (played, event_id)) AS rh, arg_max(score_home, (played, event_id)) AS rsh, arg_max(score_away, (played, event_id)) AS rsa, max(event_id) AS e FROM fixtures GROUP BY 1),
g AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i, count(*) OVER () AS n FROM region),
gg AS (SELECT a.i, a.r_name AS grp, b.r_name AS rival FROM g a JOIN g b ON b.i = (a.i + 1) % a.n),
slot AS (SELECT 2 * i + 1 AS event_id, '1' || grp AS sh, '4' || rival AS sa FROM gg UNION ALL SELECT 2 * i + 2, '2' || grp, '3' || rival FROM gg),
f1 AS (SELECT event_id, h.team AS home, a.team AS away FROM slot LEFT JOIN pos h ON h.position = sh LEFT JOIN pos a ON a.position = sa)"""
    for r in range(1, len(LEVELS) + 1):
        offset = sum(LEVELS[:r - 1])
        sql += f""",
l{r} AS (SELECT f.*, round(coalesce(hs.alpha * coalesce(ht.att_mult, 1), 1.3) * coalesce(greatest(0.45, ax.beta * coalesce(ta.def_mult, 1)), 1.0) * 1.02, 4) AS lh,
   round(coalesce(ax.alpha * coalesce(ta.att_mult, 1), 1.3) * coalesce(greatest(0.45, hs.beta * coalesce(ht.def_mult, 1)), 1.0), 4) AS la
   FROM f{r} f LEFT JOIN str hs ON hs.team = home LEFT JOIN tour ht ON ht.team = home LEFT JOIN str ax ON ax.team = away LEFT JOIN tour ta ON ta.team = away),
p{r} AS (SELECT event_id, home, away, lh, la, round(sum(p) FILTER (i > j), 3) AS ph, round(sum(p) FILTER (i < j), 3) AS pa FROM (SELECT l.*, i, j, exp(-lh) * lh ** i / factorial(CAST(i AS INTEGER)) * exp(-la) * la ** j / factorial(CAST(j AS INTEGER)) AS p
   FROM l{r} l, generate_series(0, 7) gi(i), generate_series(0, 7) gj(j)) GROUP BY ALL),
w{r} AS (SELECT p.*, CASE WHEN home IS NULL THEN away WHEN away IS NULL THEN home WHEN rsh IS NULL THEN CASE WHEN ph >= pa THEN home ELSE away END WHEN rsh = rsa THEN home WHEN (rsh > rsa) = (rh = home) THEN home ELSE away END AS winner, rsh IS NOT NULL AS confirmed
   FROM p{r} p LEFT JOIN last ON pair = least(home, away) || '|' || greatest(home, away))"""
        if r < len(LEVELS):
            sql += f""",
f{r + 1} AS (SELECT {offset + LEVELS[r - 1]} + j AS event_id, a.winner AS home, b.winner AS away FROM generate_series(1, {LEVELS[r]}) s(j)
   JOIN w{r} a ON a.event_id = {offset} + 2 * j - 1 LEFT JOIN w{r} b ON b.event_id = {offset} + 2 * j)"""
    parts = [f"SELECT {r} AS round, CAST(event_id AS BIGINT) AS event_id, home, away, winner, confirmed FROM w{r}" for r in range(1, len(LEVELS) + 1)]
    return sql + "\n" + " UNION ALL ".join(parts)


@query("knockout_bracket", "L11, C22, E05", _bracket_sql())
def _(t):
    home_region = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("team"), F.col("r_name").alias("grp"))
    # the match table and the strengths are read several times: derive each once and go on from the files
    t.fixtures = lambda f=durable(t.fixtures()): f
    table = cp.standings(t.fixtures()).join(home_region, ["team", "grp"], "left_semi")
    groups = t.region.select(F.col("r_name").alias("grp"), (F.row_number().over(Window.orderBy("r_regionkey")) - 1).alias("ordinal"))
    first = durable(bracket.fixtures_from_slots(bracket.group_slots(groups), cp.group_positions(table)))
    s = durable(strengths(t))
    form = durable(cp.tournament_form(t.sides(), s, ROUND_WEIGHTS))
    last = t.fixtures().groupBy(unordered_pair(F.col("home"), F.col("away")).alias("pair")).agg(
        F.max_by(F.struct("home", "away", "score_home", "score_away"), F.struct("played", "event_id")).alias("m")
    ).select(
        "pair", F.col("m.home").alias("res_home"), F.col("m.away").alias("res_away"), F.col("m.score_home").alias("res_score_home"),
        F.col("m.score_away").alias("res_score_away"), F.lit(None).cast("string").alias("pens"),
    )
    out = bracket.project_bracket(first, bracket.ladder(first), s, form, durable(last), [])
    return out.select("round", "event_id", "home", "away", "winner", "confirmed")
