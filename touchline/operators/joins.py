"""Lookups, reconciliation and as-of joins.

Only tables written as literals in the code are hinted for broadcast. Any other small
side is broadcast by Spark itself when its measured size is under the threshold.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, TimestampType

from touchline.operators.ordered import arg_min, positions, top_n
from touchline.session import spread


def lookup(df: DataFrame, dim: DataFrame, on: list[str], defaults: dict | None = None) -> DataFrame:
    """Left lookup by key; ``defaults`` fill what the dimension does not know."""
    out = df.join(dim, on, "left")
    return out.fillna(defaults) if defaults else out


def literal_lookup(df: DataFrame, rows: list[tuple], schema: str, on: list[str]) -> DataFrame:
    """Left lookup in a table written in the code (fixed size, so it is broadcast)."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), on, "left")


#: Words of 64 bits in the set of hashes that ``may_meet`` sends to all executors (some 10 MB with its hash table).
WORDS = 1 << 18


def may_meet(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys are nowhere in ``others``, for a join that would shuffle them all.

    The hashes of the keys of ``others`` are marked in one set of bits of fixed size: none that meets is lost, and few others
    stay while the set is not full. Keys whose equal values may hash differently are not filtered.
    """
    types = [rows.schema[k].dataType for k in keys]
    if types != [others.schema[k].dataType for k in keys] or not all(isinstance(t, (IntegralType, StringType, DateType, TimestampType)) for t in types):
        return rows
    bit = lambda: F.pmod(F.xxhash64(*keys), F.lit(WORDS * 64))
    one = F.expr("shiftleft(1L, cast(_b % 64 as int))")
    marks = others.dropna(subset=keys).select(bit().alias("_b")).groupBy((F.col("_b") / 64).cast("long").alias("_word")).agg(F.bit_or(one).alias("_bits"))
    hit = rows.withColumn("_b", bit()).withColumn("_word", (F.col("_b") / 64).cast("long")).join(F.broadcast(marks), "_word")
    return hit.where(F.col("_bits").bitwiseAND(one) != 0).select(*rows.columns)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], count: str, only_different: bool = True) -> DataFrame:
    """Counts of two sources side by side: zero-filled, with difference and direction."""
    left = a.groupBy(*keys).agg(F.sum(count).alias("count_a"))
    right = b.groupBy(*keys).agg(F.sum(count).alias("count_b"))
    both = left.join(right, keys, "full_outer").fillna(0, ["count_a", "count_b"])
    both = both.withColumn("difference", F.col("count_a") - F.col("count_b")).withColumn(
        "direction",
        F.when(F.col("difference") > 0, "a_over_b").when(F.col("difference") < 0, "b_over_a").otherwise("equal"),
    )
    return both.where(F.col("difference") != 0) if only_different else both


def unordered_pair(a: Column, b: Column) -> Column:
    """One key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def join_unordered(left: DataFrame, right: DataFrame, left_pair: tuple, right_pair: tuple, how: str = "inner") -> DataFrame:
    """Join two fixture lists whatever the order of the sides; adds ``swapped``."""
    a = left.withColumn("_pair", unordered_pair(F.col(left_pair[0]), F.col(left_pair[1])))
    b = right.withColumn("_pair", unordered_pair(F.col(right_pair[0]), F.col(right_pair[1])))
    out = a.join(b, "_pair", how).drop("_pair")
    return out.withColumn("swapped", F.col(left_pair[0]) != F.col(right_pair[0]))


def with_alias(df: DataFrame, name: str, aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Replace known aliases by the canonical name before joining on it."""
    table = aliases.select(F.col(alias).alias(name), F.col(canonical).alias("_canonical")).dropDuplicates([name])
    return df.join(table, name, "left").withColumn(name, F.coalesce("_canonical", name)).drop("_canonical")


def first_substring(text: Column, entries: list[tuple[str, float]], default) -> Column:
    """Value of the first entry contained in the text; order decides, so short keys may shadow."""
    low = F.lower(text)
    out = None
    for key, value in entries:
        cond = F.contains(low, F.lit(key.lower()))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(out.otherwise(F.lit(default)))


def either_contains(text: Column, entries: list[tuple[str, float]], default) -> Column:
    """Exact name first, else the first entry that contains the text or is contained in it."""
    low = F.lower(text)
    out = None
    for key, value in entries:
        cond = text == key
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    for key, value in entries:
        out = out.when(F.contains(low, F.lit(key.lower())) | F.contains(F.lit(key.lower()), low), F.lit(value))
    return out.otherwise(F.lit(default))


def two_sides(df: DataFrame, home: dict[str, str], away: dict[str, str], keep: list[str]) -> DataFrame:
    """One match row -> two rows (own view). ``home`` maps output name -> home-side column."""
    names = list(home)
    view = F.array(
        F.struct(F.lit(True).alias("is_home"), *[F.col(home[n]).alias(n) for n in names]),
        F.struct(F.lit(False).alias("is_home"), *[F.col(away[n]).alias(n) for n in names]),
    )
    return df.select(*keep, F.explode(view).alias("_s")).select(*keep, "_s.*")


def match_sides(fixtures: DataFrame, extra: dict[str, tuple[str, str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Own/opponent view of fixtures with columns home, away, score_home, score_away."""
    home = {"team": "home", "opponent": "away", "gf": "score_home", "ga": "score_away"}
    away = {"team": "away", "opponent": "home", "gf": "score_away", "ga": "score_home"}
    for name, (h, a) in (extra or {}).items():
        home[name], away[name] = h, a
    return two_sides(fixtures, home, away, keep or ["event_id", "round_num"])


def with_opponent(sides: DataFrame, strengths: DataFrame, columns: list[str], defaults: dict | None = None) -> DataFrame:
    """Attach the rival's strengths to each own row as ``opp_*``."""
    rival = strengths.select(F.col("team").alias("opponent"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return lookup(sides, rival, ["opponent"], {f"opp_{k}": v for k, v in (defaults or {}).items()})


def apply_overrides(df: DataFrame, key: str, overrides: DataFrame, base: Column, name: str) -> DataFrame:
    """Strict precedence: the override of the lowest priority number wins, else ``base``.

    ``overrides`` has columns key, priority, value.
    """
    best = arg_min(overrides, [key], [F.col("priority"), F.col("value")], ["value"]).withColumnRenamed("value", "_override")
    return df.join(best, key, "left").withColumn(name, F.coalesce("_override", base)).drop("_override")


def event_offsets(events: DataFrame, series: DataFrame, series_id: str, t: str, pre: int, post: int) -> DataFrame:
    """Range join event x series: an equi join on (series, minute + offset)."""
    offs = events.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post))))
    offs = offs.withColumn("_t", F.col(t) + F.col("offset"))
    points = series.select(series_id, F.col("t").alias("_t"), F.col("value"))
    return offs.join(points, [series_id, "_t"]).drop("_t")


def infer_team(known: DataFrame, events: DataFrame, players: DataFrame, match: str) -> DataFrame:
    """Team of each match side: the name table first, else the club of the first known participant.

    ``known``: match, is_home, team (nullable). ``events``: match, is_home, ordinal, player_id.
    """
    seen = events.join(players.select("player_id", "club"), "player_id")
    guess = arg_min(seen, [match, "is_home"], [F.col("ordinal"), F.col("club")], ["club"])
    out = known.join(guess, [match, "is_home"], "full_outer")
    return out.select(match, "is_home", F.coalesce("team", "club").alias("team"))


def zip_ranked(a: DataFrame, b: DataFrame, keys: list[str], order_a: list, order_b: list) -> DataFrame:
    """Pair the k-th row of ``a`` with the k-th row of ``b`` per key; both orders must be total."""
    left, right = positions(a, keys, order_a), positions(b, keys, order_b)
    return left.join(right, [*keys, "position"])


def matchup_table(pairs: DataFrame, players: DataFrame, strengths: DataFrame, columns: list[str]) -> DataFrame:
    """Players of both sides of each requested matchup, with the rival's strengths.

    ``pairs`` (home, away) is what the user wants compared, e.g. every pair of a calendar.
    """
    sides = two_sides(pairs, {"team": "home", "opponent": "away"}, {"team": "away", "opponent": "home"}, ["home", "away"])
    return with_opponent(sides.join(players, "team"), strengths, columns)


def top_matchups(pairs: DataFrame, players: DataFrame, strengths: DataFrame, base: Column, factor: Column, n: int, digits: int = 6, player: str = "player_id") -> DataFrame:
    """The best ``n`` players of both sides of every pair by ``base * factor``, rounded; ties go to the smaller id.

    ``base`` is a column of ``players`` (team, id), ``factor`` a positive one of ``strengths`` (team). A rival scales all
    rows of a team alike, so only its best ``n`` by base can be among the best of a pair, and those so near the last of
    them that rounding may tie them. They are picked before the pairs are formed: a pair meets about 2 * ``n`` rows.
    Returns home, away, the player columns, x (unrounded) and rank.
    """
    rows = players.withColumn("_base", base)
    rated = strengths.select(F.col("team").alias("opponent"), factor.cast("double").alias("_factor"))
    ranked = top_n(rows.where(F.col("_base").isNotNull()).select("team", player, "_base"), ["team"], [F.col("_base").desc(), F.col(player)], n, "_r")
    last = ranked.groupBy("team").agg(F.min(F.when(F.col("_r") == n, F.col("_base"))).alias("_last"))
    slack = rated.agg((F.lit(10.0**-digits) / F.min("_factor")).alias("s")).select("s").scalar()
    near = rows.join(last, "team", "left").where(F.col("_last").isNull() | (F.col("_base") >= F.col("_last") - slack)).drop("_last")
    sides = two_sides(pairs, {"team": "home", "opponent": "away"}, {"team": "away", "opponent": "home"}, ["home", "away"])
    both = sides.join(near, "team").join(rated, "opponent").withColumn("x", F.col("_base") * F.col("_factor"))
    return top_n(both, ["home", "away"], [F.round("x", digits).desc(), F.col(player)], n).drop("_base", "_factor", "opponent")


def setpiece_roles(players: DataFrame, takers: DataFrame) -> DataFrame:
    """Set-piece role of each player: a taker all of whose name tokens are in the player's name.

    ``players``: player_id, team, name_tokens. ``takers``: team, kind, idx, taker_tokens. A taker list meets players by
    the one of its tokens that the fewest of the team's players have, so a common surname is a key only for takers called
    nothing else; then all tokens are checked. The lowest index per kind wins. Players are dealt by their id first, so the
    roles that a task collects are those of a bounded number of players.
    """
    players = spread(players, "player_id")
    lists = takers.where(F.size("taker_tokens") > 0).groupBy("team", "kind", F.array_sort(F.array_distinct("taker_tokens")).alias("taker_tokens")).agg(F.min("idx").alias("idx"))
    named = players.select("player_id", "team", "name_tokens", F.explode(F.array_distinct("name_tokens")).alias("token"))
    # how many of the team's players have each token that some taker has
    wanted = lists.select("team", F.explode("taker_tokens").alias("token")).distinct()
    held = named.join(wanted, ["team", "token"], "left_semi").groupBy("team", "token").agg(F.count("*").alias("held"))
    counted = lists.withColumn("token", F.explode("taker_tokens")).join(held, ["team", "token"], "left")
    # a token nobody has leaves its list without players
    rarest = counted.groupBy("team", "kind", "taker_tokens", "idx").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("n"), "token")).alias("r"))
    keyed = rarest.where(F.col("r.n") > 0).select("team", "kind", "taker_tokens", "idx", F.col("r.token").alias("token"))
    hit = named.join(keyed, ["team", "token"]).where(F.size(F.array_except("taker_tokens", "name_tokens")) == 0)
    best = hit.groupBy("player_id", "team", "kind").agg(F.min("idx").alias("idx"))
    rank = F.when((F.col("kind") == "ck") | (F.col("idx") == 0), "primary").otherwise("secondary")
    return best.select("player_id", "team", "kind", "idx", F.concat_ws("_", "kind", rank).alias("role"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_absent(main: DataFrame, extra: DataFrame, keys: list[str], neutral: dict) -> DataFrame:
    """Add rows of ``extra`` whose key is not in ``main``, with neutral metrics."""
    new = extra.join(main.select(*keys), keys, "left_anti")
    new = new.withColumns({c: F.lit(v) for c, v in neutral.items()})
    return main.unionByName(new, allowMissingColumns=True)


def append_dedup(main: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Append with dedup: an existing key stays as it is."""
    tagged = main.withColumn("_new", F.lit(0)).unionByName(extra.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    value_cols = [c for c in tagged.columns if c not in keys and c != "_new"]
    return arg_min(tagged, keys, [F.col("_new"), *[F.col(c) for c in value_cols]], value_cols)
