"""Score probabilities and test statistics as Column expressions."""
from __future__ import annotations

from math import factorial, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_pmf(k: int, lam: Column) -> Column:
    lam = F.greatest(lam, F.lit(1e-12))
    return F.exp(-lam) * F.pow(lam, F.lit(k)) / factorial(k)


def clean_sheet(lam: Column) -> Column:
    return F.exp(-lam)


def _partial_exp(x: Column, n: int) -> Column:
    """Sum of x^j / j! for j = 0..n, by nested multiplication."""
    out = F.lit(1.0 / factorial(n))
    for j in range(n - 1, -1, -1):
        out = out * x + 1.0 / factorial(j)
    return out


def _upper_mass(a: Column, b: Column, n: int) -> Column:
    """Sum over i > j of a^i b^j / (i! j!), both up to n."""
    total = F.lit(0.0)
    for i in range(1, n + 1):
        total = total + F.pow(a, F.lit(i)) / factorial(i) * _partial_exp(b, i - 1)
    return total


def p_home_win(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    """P(home wins) on the truncated grid with the low-score correction ``rho``."""
    return F.exp(-(lh + la)) * (_upper_mass(lh, la, max_goals) + lh * la * rho)


def p_away_win(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    return F.exp(-(lh + la)) * (_upper_mass(la, lh, max_goals) + lh * la * rho)


def p_draw(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    diag = sum((F.pow(lh * la, F.lit(i)) / factorial(i) ** 2 for i in range(1, max_goals + 1)), F.lit(1.0))
    return F.exp(-(lh + la)) * (diag - 2 * rho * lh * la)


def goal_difference(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    """Expected goal difference of the home side on the same grid (rho terms cancel)."""
    n = max_goals
    mean = lh * _partial_exp(lh, n - 1) * _partial_exp(la, n) - la * _partial_exp(la, n - 1) * _partial_exp(lh, n)
    return F.exp(-(lh + la)) * mean + 0.0 * rho


def with_goal_masses(df: DataFrame, lh: str, la: str, max_goals: int = 8) -> DataFrame:
    """Add the goal probabilities 0..max_goals of both sides as arrays, computed once per row.

    Optimised plans keep them as columns of their own because every score reads them.
    """
    mass = lambda lam: F.array(*[F.exp(-F.col(lam)) * F.pow(F.col(lam), F.lit(k)) / factorial(k) for k in range(max_goals + 1)])
    return df.withColumns({"_home_mass": mass(lh), "_away_mass": mass(la)})


def _cells(lh: Column, la: Column, max_goals: int, rho: float) -> list[tuple[int, int, Column]]:
    """Probability of each score from the two arrays of ``with_goal_masses``."""
    corrected = {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): F.lit(1 - rho)}
    cells = []
    for i in range(max_goals + 1):
        for j in range(max_goals + 1):
            p = F.col("_home_mass")[i] * F.col("_away_mass")[j]
            cells.append((i, j, p * corrected[i, j] if (i, j) in corrected else p))
    return cells


def score_grid(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    """array<struct<home, away, p>> of every score; never renormalised."""
    return F.array(*[F.struct(F.lit(i).alias("home"), F.lit(j).alias("away"), p.alias("p")) for i, j, p in _cells(lh, la, max_goals, rho)])


def score_mass(lh: Column, la: Column, max_goals: int = 8, rho: float = -0.13) -> Column:
    """Total probability of the truncated grid."""
    return p_home_win(lh, la, max_goals, rho) + p_draw(lh, la, max_goals, rho) + p_away_win(lh, la, max_goals, rho)


def score_map(grid: Column, floor: float = 0.005) -> Column:
    """{'2-1': p} for scores above ``floor``."""
    kept = F.filter(grid, lambda s: s["p"] > floor)
    return F.map_from_entries(
        F.transform(kept, lambda s: F.struct(F.concat_ws("-", s["home"], s["away"]).alias("k"), F.round(s["p"], 4).alias("v")))
    )


def top_scores(lh: Column, la: Column, n: int = 3, max_goals: int = 8, rho: float = -0.13) -> Column:
    """The ``n`` likeliest scores, ties by fewer home then away goals."""
    keyed = F.array(*[F.struct((-p).alias("np"), F.lit(i).alias("home"), F.lit(j).alias("away")) for i, j, p in _cells(lh, la, max_goals, rho)])
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda s: F.concat_ws("-", s["home"], s["away"]))


def market_ratio(total: Column, target: Column, max_goals: int = 8, rho: float = -0.13, steps: int = 25) -> Column:
    """Ratio r = lh / la in [0.05, 20] whose home-win probability is ``target``.

    The probability grows with r, so halving the interval ``steps`` times finds it. Whole Arrow
    batches are halved together in numpy; as a Column expression the same search is evaluated
    node by node and took thirty times as long.
    """
    inverse = [1.0 / factorial(k) for k in range(max_goals + 1)]

    @F.pandas_udf("double")
    def search(total_goals: pd.Series, wanted: pd.Series) -> pd.Series:
        both = total_goals.to_numpy(dtype=float)
        goal = wanted.to_numpy(dtype=float)
        low, high = np.full(len(both), 0.05), np.full(len(both), 20.0)
        for _ in range(steps):
            r = (low + high) / 2
            la = both / (1 + r)
            lh = both - la
            upper, below = np.zeros_like(r), np.full_like(r, inverse[0])
            for i in range(1, max_goals + 1):
                upper = upper + lh**i * inverse[i] * below
                below = below + la**i * inverse[i]
            win = np.exp(-both) * (upper + lh * la * rho)
            high, low = np.where(win > goal, r, high), np.where(win > goal, low, r)
        out = (low + high) / 2
        return pd.Series(np.where(np.isnan(both) | np.isnan(goal), np.nan, out))

    return F.when(total.isNotNull() & target.isNotNull(), search(total, target))


NODES = 96


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, by one method for all degrees of freedom.

    With s = sqrt(df) tan(theta) the density becomes a power of a cosine, integrated from 0 to |t| by Gauss-Legendre
    quadrature; angles at which the power is below e**-40 are cut off. The quotient of gamma functions comes from its
    asymptotic series at an argument raised by 40 through the recurrence. The absolute error is below 1e-11.
    """
    n = df.cast("double")
    top = F.atan(F.abs(t) / F.sqrt(n))
    top = F.when(n > 41, F.least(top, F.acos(F.exp(-40 / F.greatest(n - 1, F.lit(1.0)))))).otherwise(top)
    x, w = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((1 + u) / 2)).alias("x"), F.lit(float(v / 2)).alias("w")) for u, v in zip(x, w)])
    area = F.aggregate(nodes, F.lit(0.0), lambda acc, g: acc + g["w"] * F.pow(F.cos(top * g["x"]), n - 1)) * top
    half = n / 2
    far = half + 40
    quotient = F.sqrt(far) * (1 - 1 / (8 * far) + 1 / (128 * far**2) + 5 / (1024 * far**3) - 21 / (32768 * far**4) - 399 / (262144 * far**5))
    steps = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (half + i) / (half + i + 0.5))
    density = F.aggregate(steps, quotient, lambda acc, s: acc * s) / pi**0.5
    return F.greatest(F.lit(0.0), 1 - 2 * density * area)


def one_sample_t(n: Column, mean: Column, sample_var: Column, mu=0.0) -> Column:
    return (mean - mu) / F.sqrt(F.nullif(sample_var, F.lit(0.0)) / n)


def two_sample_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Equal-variance statistic; its degrees of freedom are n1 + n2 - 2."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return (m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2))
