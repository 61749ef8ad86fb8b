"""Row-level arithmetic shared by all operators. Every function maps Columns to a Column."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(value: Column, default) -> Column:
    """Null **and zero** become ``default`` (the feed's "missing" convention)."""
    return F.coalesce(F.nullif(value, F.lit(0)), _col(default))


def clamp(value: Column, low, high) -> Column:
    """``value`` held inside [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(_col(low), F.least(_col(high), value)))


def safe_div(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return a / F.nullif(b, F.lit(0))


def per90(total: Column, minutes: Column) -> Column:
    return safe_div(total, minutes) * 90


def round_to(value: Column, digits: int) -> Column:
    """Rounding of the double as it is stored, half to even, as Python rounds: 2.675 lies below its tie and gives 2.67.

    F.round goes by the shortest decimal text instead. Here the product with the power of ten is taken exactly, as a double
    and its error (each factor split in two halves of few bits), so a tie is one only if the stored value is. Exact while
    the product is below 2**52; larger values and what is not finite stay as they are. ``digits`` from 0 to 15.
    """
    power = float(10**digits)
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  the upper 26 bits
    ph = 134217729.0 * power - (134217729.0 * power - power)
    v = value.cast("double")
    product = v * power
    vh = high(v)
    error = ((vh * ph - product) + vh * (power - ph) + (v - vh) * ph) + (v - vh) * (power - ph)
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / power
    return F.when(F.isnan(v) | (F.abs(product) >= 2.0**52), v).otherwise(rounded)


def code_map(value: Column, mapping: dict, default=None) -> Column:
    """Literal dictionary lookup with a default."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def bands(value: Column, cuts: list[tuple[float, object]], default) -> Column:
    """First ``(threshold, label)`` with ``value >= threshold``; cuts run from high to low."""
    out = None
    for threshold, label in cuts:
        cond = value >= threshold
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def rules(cases: list[tuple[Column, str]], default: str) -> Column:
    """Ordered rule classification: the first condition that holds names the class."""
    out = None
    for cond, label in cases:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def first_known(*values: Column) -> Column:
    """First non-null alias of a metric."""
    return F.coalesce(*values)


def side_sign(value: Column, is_home: Column) -> Column:
    """Value seen from the acting side: unchanged at home, negated away."""
    return F.when(is_home, value).otherwise(-value)


# Conversion of counts into expected goals and assists.
XG_PER_SHOT = 0.095
XG_FLOOR_PER_GOAL = 0.5
XA_PER_KEY_PASS = 0.08


def match_xg(xg: Column, shots: Column, goals: Column) -> Column:
    """Published xG of a match, else max(shots * 0.095, goals * 0.5)."""
    return F.coalesce(
        xg,
        F.greatest(
            F.coalesce(shots, F.lit(0)) * XG_PER_SHOT,
            F.coalesce(goals, F.lit(0)) * XG_FLOOR_PER_GOAL,
        ),
    )


def match_xa(xa: Column, key_passes: Column) -> Column:
    return F.coalesce(xa, F.coalesce(key_passes, F.lit(0)) * XA_PER_KEY_PASS)


def season_xg(xg: Column, shots: Column) -> Column:
    """Season variant: a zero total counts as missing."""
    return or_default(xg, F.coalesce(shots, F.lit(0)) * XG_PER_SHOT)


def season_xa(xa: Column, key_passes: Column) -> Column:
    return or_default(xa, F.coalesce(key_passes, F.lit(0)) * XA_PER_KEY_PASS)


def shrink(value: Column, n: Column, prior: Column, k) -> Column:
    """Pull ``value`` to ``prior`` with weight n / (n + k)."""
    weight = n / (n + _col(k))
    return weight * value + (1 - weight) * prior


def consistency(n: Column, mean: Column, std: Column) -> Column:
    """0..100 from the coefficient of variation; null under 2 points, 50 for tiny means."""
    score = clamp(F.round(100 - safe_div(std, mean) * 50), 0.0, 100.0)
    return F.when(n < 2, F.lit(None).cast("double")).when(mean < 0.02, F.lit(50.0)).otherwise(score)


def decay(age: Column, half_life) -> Column:
    """Exponential weight; 0.693 is the constant the published strengths use for ln 2."""
    return F.exp(-0.693 * age / _col(half_life))


def value_blend(parts: list[tuple[Column, Column]]) -> Column:
    """Weighted blend of (value, weight) pairs; a null value drops out with its weight."""
    num = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    return safe_div(num, den)


def decimal_odds(text: Column) -> Column:
    """'3/5' -> 1.6; anything else -> null."""
    num = F.regexp_extract(text, r"^\s*(\d+)/(\d+)\s*$", 1)
    den = F.regexp_extract(text, r"^\s*(\d+)/(\d+)\s*$", 2)
    return F.round(num.try_cast("double") / F.nullif(den.try_cast("double"), F.lit(0.0)) + 1, 4)


def percent_value(text: Column) -> Column:
    """'63%' -> 63.0."""
    return F.trim(F.regexp_replace(text, "%", "")).try_cast("double")


def score_part(text: Column, part: int) -> Column:
    """Home (1) or away (2) goals of '3-1' or '3:1'."""
    return F.regexp_extract(text, r"(\d+)\s*[-:]\s*(\d+)", part).try_cast("int")


def implied_probability(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def without_margin(p: Column, *others: Column) -> Column:
    total = F.coalesce(p, F.lit(0.0))
    for o in others:
        total = total + F.coalesce(o, F.lit(0.0))
    return safe_div(F.coalesce(p, F.lit(0.0)), total)


def implied_goals(p_win: Column) -> Column:
    """Market view of a side's goals: -ln(max(1 - p, 0.01)) * 1.8 in [0.3, 4]."""
    return clamp(-F.log(F.greatest(1 - p_win, F.lit(0.01))) * 1.8, 0.3, 4.0)


def age_years(birth: Column, today: Column) -> Column:
    return F.datediff(today, birth) / 365.25


def iso_date(text: Column) -> Column:
    """Date from the first ten characters; bad text is null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


