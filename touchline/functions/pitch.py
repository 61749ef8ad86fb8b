"""Shot geometry and team ratings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.scalars import bands, clamp

# Pitch size in metres, goal width, shot model.
LENGTH_M, WIDTH_M, GOAL_M = 105, 68, 7.32


def location_xg(x: Column, y: Column) -> Column:
    """Shot quality from distance and opening angle; x = 0 is the goal line, y = 50 the middle."""
    depth = x / 100 * LENGTH_M
    lateral = F.abs((y - 50) / 100) * WIDTH_M
    distance = F.sqrt(depth * depth + lateral * lateral)
    angle = F.degrees(F.atan2(F.lit(GOAL_M), F.greatest(depth, F.lit(0.5))))
    return F.round(clamp(0.95 * F.exp(-0.115 * distance) * (angle / 55), 0.02, 0.85), 3)


def rational_xg(x: Column, y: Column, defends_left: Column) -> Column:
    """Variant for shots against a side: 3.5 / (1 + d^2 / 80), clamped."""
    depth = F.when(defends_left, x).otherwise(100 - x)
    d2 = depth * depth + (y - 50) * (y - 50)
    return clamp(3.5 / (1 + d2 / 80), 0.02, 0.85)


def zone(y: Column) -> Column:
    return F.when(y < 35, "left").when(y > 65, "right").otherwise("center")


def conceded_xg(big: Column, inside: Column, outside: Column) -> Column:
    """Expected goals against from counts of shots by place."""
    z = F.lit(0)
    big, inside, outside = F.coalesce(big, z), F.coalesce(inside, z), F.coalesce(outside, z)
    return big * 0.35 + F.greatest(inside - big, z) * 0.08 + outside * 0.035


def defence_score(xgc_pg: Column, clean_rate: Column) -> Column:
    """0..100: 65 % expected goals against, 35 % clean sheets."""
    return clamp(100 - (xgc_pg - 0.4) * 52, 0.0, 100.0) * 0.65 + F.least(F.lit(100.0), clean_rate * 130) * 0.35


def attack_score(xg_pg: Column, gf_pg: Column) -> Column:
    return F.least(F.lit(100.0), xg_pg * 42) * 0.65 + F.least(F.lit(100.0), gf_pg * 33) * 0.35


# Difficulty bands, 5 = strong defence.
DIFFICULTY = [(72, 5), (56, 4), (38, 3), (20, 2)]


def difficulty(def_score: Column, strong_is_high: bool = True) -> Column:
    level = bands(def_score, DIFFICULTY, 1)
    return level if strong_is_high else 6 - level


def ranked_defence(recent: Column, rank_score: Column) -> Column:
    """75 % results, 25 % world rank."""
    return clamp(F.round(0.75 * recent + 0.25 * rank_score, 1), 0.0, 100.0)
