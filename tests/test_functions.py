import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import pitch, probability as pr, scalars as sc, scoring, text
from touchline.operators.joins import either_contains, first_substring

lit = F.lit


def test_defaults_and_clamp(one):
    assert one(sc.or_default(lit(0.0), 3.0)) == 3.0
    assert one(sc.or_default(lit(None).cast("double"), 3.0)) == 3.0
    assert one(sc.or_default(lit(2.0), 3.0)) == 2.0
    assert one(sc.clamp(lit(9.0), 1.0, 5.0)) == 5.0
    assert one(sc.clamp(lit(None).cast("double"), 1.0, 5.0)) is None
    assert one(sc.safe_div(lit(1.0), lit(0.0))) is None
    assert one(sc.per90(lit(2.0), lit(45.0))) == 4.0


def test_parsing(one):
    assert one(text.normalize_name(lit("  José María  Ñúñez-Íñigo 7"))) == "jose maria nunezinigo"
    assert one(text.market_value(lit("1,50M"))) == 1_500_000
    assert one(text.market_value(lit("500 Th."))) == 500_000
    assert one(text.market_value(lit("750k"))) == 750_000
    assert one(text.market_value(lit("-"))) is None
    assert one(sc.decimal_odds(lit("3/5"))) == 1.6
    assert one(sc.decimal_odds(lit("x"))) is None
    assert one(sc.percent_value(lit("63%"))) == 63.0
    assert one(sc.percent_value(lit("n/a"))) is None
    assert one(sc.score_part(lit("3-1"), 1)) == 3 and one(sc.score_part(lit("3:1"), 2)) == 1
    assert one(sc.iso_date(lit("2024-02-30"))) is None
    assert one(text.goal_kind(lit("Tor in propia puerta"))) == "owngoal"
    assert one(text.goal_kind(lit("de Penal"))) == "penalty"
    assert sorted(one(text.taker_tokens(lit("Hrustić de-la Cruz")))) == ["cruz", "hrustic"]


def test_lookup_order(one):
    entries = [("Real", 1.0), ("Real Madrid", 2.0)]
    assert one(first_substring(lit("Real Madrid CF"), entries, 0.85)) == 1.0  # a short key shadows
    assert one(first_substring(lit("Boca"), entries, 0.85)) == 0.85
    assert one(either_contains(lit("Real Madrid"), entries, 20.0)) == 2.0  # exact name first
    assert one(either_contains(lit("Madrid"), entries, 20.0)) == 2.0


@pytest.mark.parametrize("lh,la", [(0.4, 2.2), (1.3, 1.1), (4.0, 0.3)])
def test_score_probabilities(spark, one, lh, la):
    def cell(i, j):
        c = {(0, 0): 1 + 0.13 * lh * la, (1, 0): 1 - 0.13 * la, (0, 1): 1 - 0.13 * lh, (1, 1): 1.13}.get((i, j), 1)
        return math.exp(-lh - la) * lh**i * la**j / math.factorial(i) / math.factorial(j) * c

    grid = {(i, j): cell(i, j) for i in range(9) for j in range(9)}
    h, a = lit(lh), lit(la)
    home, draw, away = one(pr.p_home_win(h, a)), one(pr.p_draw(h, a)), one(pr.p_away_win(h, a))
    assert home == pytest.approx(sum(p for (i, j), p in grid.items() if i > j), abs=1e-12)
    assert draw == pytest.approx(sum(p for (i, j), p in grid.items() if i == j), abs=1e-12)
    assert away == pytest.approx(sum(p for (i, j), p in grid.items() if i < j), abs=1e-12)
    assert one(pr.goal_difference(h, a)) == pytest.approx(sum(p * (i - j) for (i, j), p in grid.items()), abs=1e-12)
    row = pr.with_goal_masses(spark.createDataFrame([(lh, la)], "h double, a double"), "h", "a")
    top = row.select(pr.score_grid(F.col("h"), F.col("a")).alias("g"), pr.top_scores(F.col("h"), F.col("a")).alias("t")).first()
    cells = top.g
    assert sum(c["p"] for c in cells) == pytest.approx(sum(grid.values()), abs=1e-12)
    assert one(pr.score_mass(h, a)) == pytest.approx(sum(grid.values()), abs=1e-12)
    best = sorted(grid, key=lambda k: (-grid[k], k))[:3]
    assert top.t == [f"{i}-{j}" for i, j in best]


def test_market_ratio(one):
    total, target = 2.6, 0.55
    r = one(pr.market_ratio(lit(total), lit(target)))
    assert one(pr.p_home_win(lit(total * r / (1 + r)), lit(total / (1 + r)))) == pytest.approx(target, abs=1e-5)
    assert one(pr.market_ratio(lit(None).cast("double"), lit(0.5))) is None


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (2.200985, 11, 0.05), (12.7062, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (1.980448, 118, 0.05), (1.959964 + 2.37e-6 * 1000, 1000, 0.05), (0.0, 7, 1.0)])
def test_t_distribution(one, t, df, p):
    assert one(pr.t_two_sided(lit(t), lit(df))) == pytest.approx(p, abs=2e-4)


def t_series(t, df):
    """Finite series for whole degrees of freedom, any number of terms."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c2, sin = math.cos(theta) ** 2, math.sin(theta)
    if df % 2:
        term = total = math.cos(theta) if df > 1 else 0.0
        for k in range(1, (df - 3) // 2 + 1):
            term *= 2 * k / (2 * k + 1) * c2
            total += term
        return 1 - 2 / math.pi * (theta + sin * total)
    term = total = 1.0
    for k in range(1, (df - 2) // 2 + 1):
        term *= (2 * k - 1) / (2 * k) * c2
        total += term
    return 1 - sin * total


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 40, 41, 42, 43, 400, 401, 1500, 20_001, 300_000])
def test_t_is_exact_for_all_degrees_of_freedom(one, df):
    for t in (1e-6, 0.5, 1.7, 2.9, 4.2, 9.0, 60.0):
        assert one(pr.t_two_sided(lit(t), lit(df))) == pytest.approx(t_series(t, df), abs=1e-10)


def test_pitch(one):
    assert one(pitch.location_xg(lit(10.0), lit(50.0))) == pytest.approx(0.95 * math.exp(-0.115 * 10.5) * math.degrees(math.atan2(7.32, 10.5)) / 55, abs=1e-3)
    assert one(pitch.location_xg(lit(100.0), lit(0.0))) == 0.02
    assert one(pitch.zone(lit(34.9))) == "left" and one(pitch.zone(lit(None).cast("double"))) == "center"
    assert one(pitch.difficulty(lit(72.0))) == 5 and one(pitch.difficulty(lit(72.0), strong_is_high=False)) == 1
    assert one(pitch.conceded_xg(lit(2), lit(1), lit(None).cast("int"))) == pytest.approx(0.70)


def test_scoring(one):
    assert one(sc.consistency(lit(1), lit(1.0), lit(0.1))) is None
    assert one(sc.consistency(lit(5), lit(0.01), lit(0.1))) == 50.0
    assert one(sc.consistency(lit(5), lit(1.0), lit(3.0))) == 0.0
    assert one(scoring.play60(lit("D"), lit(80.0))) == 0.94
    assert one(scoring.archetype(lit("M"), lit(0.3), lit(0.3), lit(2.5), lit(1.0))) == "shadow_striker"
    assert one(scoring.archetype(lit("D"), lit(0.0), lit(0.11), lit(0.0), lit(0.0), cup=True)) == "overlapping_def"
    assert one(scoring.archetype(lit("D"), lit(0.0), lit(0.11), lit(0.0), lit(0.0))) == "attacking_def"
    assert one(scoring.bonus_expectation(lit(0.5), lit(1.0))) == pytest.approx(1.5)
    assert one(scoring.adjust_bonus(lit(2.0), lit("G"), lit(0.65))) == 0.8
    assert one(scoring.points_per_price(lit(3.0), lit(0.0))) is None


def test_round_to_rounds_as_python_does(spark):
    import random

    from touchline.functions.scalars import round_to

    rng = random.Random(6)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -1.5, 0.125, 0.375, -2.675, 1e300, float("inf"), 5e-324, 0.0, 4503599627370497.5, None]
    values += [round(rng.uniform(-1000, 1000), 3) + rng.choice([0, 0.005, 0.0005]) for _ in range(2000)] + [rng.randrange(10**6) / 8 for _ in range(300)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 4):
        for r in df.select("v", round_to(F.col("v"), digits).alias("r")).collect():
            assert r.r == (None if r.v is None else r.v if r.v in (float("inf"), 1e300) else round(r.v, digits)), (r.v, digits)
