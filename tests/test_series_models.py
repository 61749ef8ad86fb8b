import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models, series as se
from touchline.operators.podium import podium

# Published club values (millions), points and residuals.
VALUES = [1310, 1230, 1160, 1020, 803, 747, 708, 568, 548, 541, 507, 494, 470, 450, 387, 382, 363, 346, 277, 253]
POINTS = [77, 79, 49, 59, 38, 68, 49, 43, 62, 45, 55, 53, 52, 49, 49, 51, 36, 47, 19, 21]
RESIDUALS = [4.6, 9.3, -18.4, -3.9, -17.8, 14.1, -3.7, -5.1, 14.6, -2.2, 8.9, 7.3, 7.1, 4.8, 6.8, 9.0, -5.4, 6.2, -19.6, -16.8]


def test_value_regression_golden(spark):
    df = spark.createDataFrame([(float(v), float(p)) for v, p in zip(VALUES, POINTS)], "v double, p double")
    fit = models.simple_ols(df, "v", "p").first()
    assert (round(fit.slope, 3), round(fit.intercept, 1), round(fit.r2, 2)) == (0.033, 29.5, 0.48)
    got = {r.v: r.residual for r in models.with_residual(df, "v", "p").collect()}
    for v, want in zip(VALUES, RESIDUALS):
        assert got[float(v)] == pytest.approx(want, abs=0.11)


def test_densify(spark):
    pts = spark.createDataFrame([(1, 0, 3.0, 5.0), (1, 1, 5.0, 7.0), (1, 2, 5.5, 9.0), (1, 3, 91.0, 4.0), (2, 0, 90.5, 1.0)], "m int, o int, minute double, v double")
    s = {(r.m, r.t): r.value for r in se.densify(pts, "m", F.col("minute"), ["o"], "v").collect()}
    assert len(s) == 180
    assert (s[1, 1], s[1, 3], s[1, 4], s[1, 5], s[1, 90]) == (0.0, 5.0, 5.0, 9.0, 9.0)
    assert (s[2, 89], s[2, 90]) == (0.0, 1.0)


def test_autocorrelation(spark):
    rng = random.Random(2)
    x = [rng.random() for _ in range(30)]
    rows = [(1, t, v) for t, v in enumerate(x, 1)] + [(2, t, 4.0) for t in range(1, 31)]
    got = {(r.id, r.lag): r.ac for r in se.autocorrelation(spark.createDataFrame(rows, "id int, t int, value double"), "id", [1, 5]).collect()}
    c = np.array(x) - np.mean(x)
    for k in (1, 5):
        assert got[1, k] == pytest.approx(c[:-k] @ c[k:] / (c @ c))
        assert got[2, k] == 0.0


def test_event_study_gate(spark):
    series = spark.createDataFrame([(1, t, float(t)) for t in range(1, 91)], "m int, t int, value double")
    ev = spark.createDataFrame([(10, 1, 5, True, "g"), (11, 1, 40, False, "g"), (12, 1, 81, True, "g"), (13, 1, 88, True, "g")], "event_id int, m int, minute int, is_home boolean, kind string")
    w = se.signed_windows(ev, series, "m", 5, 10)
    means = {r.event_id: r.delta for r in se.event_means(w, ["event_id"], 15).collect()}
    assert means == {10: pytest.approx(8.0), 11: pytest.approx(-8.5), 12: pytest.approx(8.0)}
    both = se.select_events(ev, {"own": (F.col("kind") == "g", False), "rival": (F.col("kind") == "g", True), "none": (F.lit(False), False)})
    assert both.count() == 8 and both.where("selector = 'rival' and event_id = 11").first().is_home is True


def test_half_life(spark):
    traj = spark.createDataFrame([(-1, 0.0), (0, 9.0), (1, 8.0), (2, 6.0), (3, 3.0), (4, 1.0)], "offset int, mean double")
    r = se.half_life(traj).first()
    assert (r.baseline, r.peak, r.half_life) == (0.0, 8.0, 3)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3)) * [1, 10, 0.1] + [0, 1000, 5]
    g = np.where(np.arange(120) < 100, "A", "B")
    y = x @ [1.0, 0.2, 3.0] + rng.normal(size=120)
    df = spark.createDataFrame([(str(k), *map(float, r), float(t)) for k, r, t in zip(g, x, y)], "grp string, a double, b double, c double, y double")
    got = {(r.grp, r.feature): r for r in models.ridge(df, "grp", ["a", "b", "c"], "y").collect()}
    for label, mask in (("ALL", np.ones(120, bool)), ("A", g == "A"), ("B", g == "B")):
        xs = (x[mask] - x[mask].mean(0)) / x[mask].std(0)
        yc = y[mask] - y[mask].mean()
        beta = np.linalg.solve(xs.T @ xs + np.eye(3), xs.T @ yc)
        r2 = 1 - ((yc - xs @ beta) ** 2).sum() / (yc**2).sum()
        for i, f in enumerate("abc"):
            assert got[label, f].coef_std == pytest.approx(beta[i], rel=1e-7)
            assert got[label, f].r2 == pytest.approx(r2, rel=1e-9)
    assert models.ridge(df.where("grp = 'B'").limit(19), "grp", ["a"], "y").count() == 0


def test_logistic_and_auc(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    coefs, scored = models.logistic(df, ["a", "b"], "y")
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        pen = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ w)
    got = {r.feature: r.coefficient for r in coefs.collect()}
    assert [got["a"], got["b"], got["intercept"]] == pytest.approx(list(w), abs=1e-5)
    s = 1 / (1 + np.exp(-z @ w))
    pairs = [(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]]
    assert models.auc(scored, "score", "y").first().auc == pytest.approx(np.mean(pairs), abs=1e-9)


@pytest.mark.parametrize("scores", [[7.0, 6.8, 6.5, 6.5, 6.1], [9.9, 6.0, 6.1], [7.0], [7.0, 6.0], [8.5, 8.4] + [6.0 + i / 50 for i in range(25)], [6.5] * 40])
def test_podium_against_triple_sum(spark, scores):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "m int, id int, x double")
    got = {r.id: (r.p1, r.p2, r.p3) for r in podium(df, ["m"], "id", F.col("x")).collect()}
    w = np.exp((np.array(scores) - max(scores)) / 0.4)
    W, n = w.sum(), len(scores)
    for i in range(n):
        p2 = sum(w[j] / W * w[i] / (W - w[j]) for j in range(n) if j != i)
        p3 = sum(w[j] / W * w[k] / (W - w[j]) * w[i] / (W - w[j] - w[k]) for j in range(n) for k in range(n) if len({i, j, k}) == 3)
        assert got[i] == pytest.approx((w[i] / W, p2, p3), abs=1e-9)
    for place in range(min(3, n)):
        assert sum(v[place] for v in got.values()) == pytest.approx(1.0)


def test_podium_dominant(spark):
    df = spark.createDataFrame([(1, 0, 10.0), (1, 1, 4.0), (1, 2, 4.0), (1, 3, 3.9)], "m int, id int, x double")
    got = {r.id: (r.p1, r.p2, r.p3) for r in podium(df, ["m"], "id", F.col("x")).collect()}
    assert sum(v[2] for v in got.values()) == pytest.approx(1.0, abs=1e-6)
    assert got[0][0] > 0.999 and got[1][1] == pytest.approx(got[2][1])
