"""Flattening of nested match, lineup, odds, transfer and page feeds into typed rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import decimal_odds, iso_date, match_xa, match_xg, percent_value
from touchline.functions.text import market_value, tag_all

RED = ("red", "yellowRed")
SET_PIECES = ("fromSetPiece", "fromCorner", "penalty")


def incidents(df: DataFrame, column: str = "incidents", keep: list[str] | None = None) -> DataFrame:
    """One row per incident, in feed order. ``keep`` are match columns (event_id, home_id, away_id)."""
    keep = keep or ["event_id", "home_id", "away_id"]
    # the outer form asks for no filter on the array, so a parsed column is parsed once
    rows = df.select(*keep, F.posexplode_outer(column).alias("ordinal", "i")).where(F.col("ordinal").isNotNull())
    at = F.col("i.time") + F.coalesce("i.addedTime", F.lit(0)) * 0.5
    home = F.coalesce("i.isHome", F.lit(True))
    return rows.select(
        *keep, "ordinal", F.col("i.incidentType").alias("kind"), F.coalesce("i.incidentClass", F.lit("")).alias("class"), F.col("i.time").alias("minute"),
        F.coalesce("i.addedTime", F.lit(0)).alias("added"), at.alias("at"), home.alias("is_home"), F.when(home, F.col("home_id")).otherwise(F.col("away_id")).alias("team_id"),
        F.col("i.player.id").alias("player_id"), F.col("i.player.name").alias("player_name"), F.col("i.playerIn.id").alias("player_in"),
        F.col("i.playerOut.id").alias("player_out"), F.col("i.homeScore").alias("home_after"), F.col("i.awayScore").alias("away_after"),
        F.col("i.text").alias("text"), F.coalesce("i.rescinded", F.lit(False)).alias("rescinded"),
    )


def goals(inc: DataFrame) -> DataFrame:
    """Goals that stand, with their build-up and own-goal flag."""
    g = inc.where(F.col("kind").isin("goal", "ownGoal") & ~F.col("rescinded"))
    return g.select(
        "event_id", "ordinal", F.col("at").alias("minute"), "player_id", "player_name", "team_id", "is_home",
        F.when(F.col("class").isin(*SET_PIECES), "set_piece").otherwise("open_play").alias("build_up"), (F.col("class") == "penalty").alias("is_penalty"),
        ((F.col("kind") == "ownGoal") | (F.col("class") == "ownGoal")).alias("is_own_goal"), "home_after", "away_after",
    )


def cards(inc: DataFrame) -> DataFrame:
    c = inc.where(F.col("kind") == "card")
    return c.select("event_id", "ordinal", "minute", "player_id", "player_name", "team_id", "is_home", F.col("class").alias("card"), F.col("class").isin(*RED).alias("misses_next"))


def substitutions(inc: DataFrame) -> DataFrame:
    return inc.where(F.col("kind") == "substitution").select("event_id", "ordinal", "minute", "added", "at", "is_home", "player_in", "player_out")


def final_whistles(inc: DataFrame) -> DataFrame:
    return inc.where((F.col("kind") == "period") & F.col("text").isin("FT", "AP", "AET")).select("event_id", "minute", "added")


def _tagged(side: str, status: str):
    return lambda p: F.struct(F.lit(status).alias("status"), F.lit(side == "home").alias("is_home"), F.col(f"{side}.team.name").alias("team"), p.alias("p"))


def _sided(side: str):
    return lambda p: F.struct(F.lit(side == "home").alias("is_home"), p.alias("p"))


def lineups(df: DataFrame, sides=("home", "away")) -> DataFrame:
    """Starters, bench and missing players; the strongest status of a player wins.

    ``df``: event_id and one struct column per side, one row a match. All entries of a match sit in its row, so they are
    put in order of strength there (starters, bench, missing; inside one status by side, list and entry) and the first
    of each player is kept before anything is exploded: no shuffle.
    """
    entry = df.schema[sides[0]].dataType["players"].dataType
    empty = F.array().cast(entry)
    strongest = [("starter", ["players"]), ("substitute", ["substitutes", "bench"]), ("missing", ["missingPlayers"])]
    lists = [F.transform(F.coalesce(F.col(f"{side}.{field}"), empty), _tagged(side, status)) for status, fields in strongest for side in sides for field in fields]
    rows = df.select("event_id", F.concat(*lists).alias("_e"))
    both = F.struct(F.col("_e").alias("e"), F.transform("_e", lambda e: e["p"]["player"]["id"]).alias("ids"))
    firsts = lambda s: F.filter(s["e"], lambda e, i: e["p"]["player"]["id"].isNotNull() & (F.array_position(s["ids"], e["p"]["player"]["id"]) == i + 1))
    first = F.get(F.transform(F.array(both), firsts), 0)  # the ids are listed once a match, not once an entry
    rows = rows.select("event_id", F.explode_outer(first).alias("e")).where(F.col("e").isNotNull()).select("event_id", "e.*")
    return rows.select(
        "event_id", F.col("p.player.id").alias("player_id"), "status", "is_home", "team", F.col("p.jerseyNumber").alias("jersey"),
        F.coalesce("p.position", "p.player.position").alias("pos"), F.coalesce("p.player.name", "p.player.shortName").alias("name"),
        F.when(F.col("status") == "missing", F.coalesce("p.type", "p.reason")).alias("reason"),
    )


def lineup_statistics(df: DataFrame, features: list[str], sides=("home", "away")) -> DataFrame:
    """One row per player and match with zero-filled features; rows without a rating are dropped."""
    empty = F.array().cast(df.schema[sides[0]].dataType["players"].dataType)
    lists = [
        F.transform(F.coalesce(F.col(f"{side}.{field}"), empty), _sided(side))
        for side in sides for field in ("players", "substitutes")
    ]
    rows = df.select("event_id", F.explode(F.concat(*lists)).alias("e")).select("event_id", "e.*")
    stat = lambda f: F.try_element_at(F.col("p.statistics"), F.lit(f))
    return rows.select(
        "event_id", "is_home", F.col("p.player.id").alias("player_id"), F.col("p.player.name").alias("name"), F.col("p.position").alias("pos"), stat("rating").alias("rating"),
        *[F.coalesce(stat(f), F.lit(0.0)).alias(f) for f in features],
    ).where(F.col("rating").isNotNull())


def period_statistics(df: DataFrame, wanted: list[str], column: str = "statistics") -> DataFrame:
    """Period x statistic x side cube as long rows, listed statistics only."""
    p = df.select("event_id", F.explode(column).alias("p")).select("event_id", F.coalesce("p.period", F.lit("ALL")).alias("period"), F.explode("p.groups").alias("g"))
    i = p.select("event_id", "period", F.explode("g.statisticsItems").alias("i")).where(F.col("i.name").isin(wanted))
    return i.select("event_id", "period", F.col("i.name").alias("stat"), percent_value(F.col("i.home")).alias("home"), percent_value(F.col("i.away")).alias("away"))


def odds_markets(df: DataFrame, column: str = "markets") -> DataFrame:
    """Pre-match 1X2, over/under 2.5 and both-score prices of each event that has one of them.

    Of several markets of a kind the last one counts as a whole, so prices of two markets never mix; of several choices of
    a name in it the last with a price. All is found in the event's own row.
    """
    name = lambda m: m["marketName"]
    pre = lambda m: ~F.coalesce(m["isLive"], F.lit(False))
    is_1x2 = lambda m: F.coalesce((m["marketGroup"] == "1X2") & F.contains(name(m), F.lit("Full time")), F.lit(False))
    is_goals = lambda m: ~is_1x2(m) & F.coalesce(F.contains(name(m), F.lit("2.5")), F.lit(False))
    is_both = lambda m: ~is_1x2(m) & ~is_goals(m) & F.coalesce(F.contains(name(m), F.lit("Both teams")), F.lit(False))
    last = lambda kind: F.try_element_at(F.filter(column, lambda m: pre(m) & kind(m)), F.lit(-1))["choices"]
    rows = df.select("event_id", last(is_1x2).alias("_result"), last(is_goals).alias("_goals"), last(is_both).alias("_both"))
    rows = rows.where(F.coalesce("_result", "_goals", "_both").isNotNull())
    price = lambda c, n: decimal_odds(F.try_element_at(F.filter(c, lambda x: (x["name"] == n) & (F.coalesce(x["fractionalValue"], F.lit("")) != "")), F.lit(-1))["fractionalValue"])
    return rows.select(
        "event_id", price("_result", "1").alias("odds_home"), price("_result", "X").alias("odds_draw"), price("_result", "2").alias("odds_away"),
        price("_goals", "Over").alias("over"), price("_goals", "Under").alias("under"), price("_both", "Yes").alias("both_yes"), price("_both", "No").alias("both_no"),
    )


def transfer_history(df: DataFrame, clubs: DataFrame) -> DataFrame:
    """Terminated and pending transfers with club names.

    ``df``: player_id, terminated, pending. ``clubs``: club_id, club.
    """
    empty = F.array().cast(df.schema["terminated"].dataType)
    t = df.select("player_id", F.posexplode(F.concat(F.coalesce("terminated", empty), F.coalesce("pending", empty))).alias("ordinal", "t"))
    t = t.select(
        "player_id", F.col("ordinal").alias("transfer_id"), F.col("t.details.season.display").alias("season"), iso_date(F.col("t.details.date")).alias("date"),
        F.col("t.transferSource.clubId").alias("from_club_id"), F.col("t.transferDestination.clubId").alias("to_club_id"), F.col("t.details.fee.value").alias("fee"),
        F.coalesce(F.col("t.typeDetails.type") == "LOAN", F.lit(False)).alias("is_loan"), F.col("t.details.marketValue.value").alias("mv_at_transfer"), F.col("t.details.age").alias("age_at_transfer"),
    )
    for side in ("from", "to"):
        t = t.join(clubs.select(F.col("club_id").alias(f"{side}_club_id"), F.col("club").alias(f"{side}_club")), f"{side}_club_id", "left")
    return t


def fixture_rows(df: DataFrame, column: str = "event") -> DataFrame:
    """Event struct -> fixture row."""
    e = lambda f: F.col(f"{column}.{f}")
    return df.select(
        e("id").alias("event_id"), e("homeTeam.id").alias("home_id"), e("homeTeam.name").alias("home"), e("awayTeam.id").alias("away_id"), e("awayTeam.name").alias("away"),
        F.timestamp_seconds(e("startTimestamp")).alias("kickoff"), e("status.type").alias("status"), e("homeScore.current").alias("score_home"), e("awayScore.current").alias("score_away"), e("roundInfo.round").alias("round_num"),
    )


def squad_entries(df: DataFrame, column: str = "entry") -> DataFrame:
    """Squad entry in either shape: wrapped in ``player`` or bare, position as text or object."""
    e = lambda f: F.col(f"{column}.{f}")
    return df.select(
        "team", F.coalesce(e("player.id"), e("id")).alias("player_id"), F.coalesce(e("player.name"), e("name")).alias("name"),
        F.coalesce(e("player.position"), e("player.positionObject.name"), e("position")).alias("pos"), e("jerseyNumber").alias("jersey"),
    ).where(F.col("player_id").isNotNull())


def roster_rows(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Player rows of landed roster pages: link id, name and market value per table row."""
    rows = pages.select(*(keep or ["url"]), F.posexplode(tag_all(F.col(html), "tr")).alias("ordinal", "row"))
    link = r"(?s)<a[^>]*href=\"[^\"]*/spieler/(\d+)[^\"]*\"[^>]*>(.*?)</a>"
    cells = tag_all(F.col("row"), "td")
    money = F.regexp_replace(F.element_at(cells, -1), "<[^>]*>", "")
    return rows.where(F.col("row").rlike("/spieler/")).select(
        *(keep or ["url"]), "ordinal", F.regexp_extract("row", link, 1).try_cast("long").alias("player_id"),
        F.trim(F.regexp_replace(F.regexp_extract("row", link, 2), "<[^>]*>", "")).alias("name"), market_value(F.regexp_replace(money, "€", "")).alias("market_value"),
    )


_ATTRIBUTES = r"""((?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*)"""


def page_links(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Every link of a page in order: target and text. The target may stand at any place of the tag, in either quote or none."""
    tag = rf"(?is)<a{_ATTRIBUTES}\s*>(.*?)</a>"
    parts = [F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(g)) for g in (1, 2)]
    target = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    link = lambda a, name: F.struct(
        F.when(a.rlike(target), F.concat(*[F.regexp_extract(a, target, g) for g in (1, 2, 3)])).alias("href"), name.alias("name")
    )
    links = F.filter(F.zip_with(*parts, link), lambda x: x["href"].isNotNull())
    return pages.select(*keep, F.posexplode(links).alias("ordinal", "l")).select(*keep, "ordinal", "l.href", "l.name")


def embedded_json(pages: DataFrame, variable: str, schema: str, html: str = "html") -> DataFrame:
    """Payload of ``const <variable> = {...}`` in a page, parsed with an explicit schema.

    The parser reads one value and stops at its closing brace, so braces in strings and what follows do not matter.
    """
    text = F.regexp_extract(html, rf"(?s)const\s+{variable}\s*=\s*(\{{.*)", 1)
    return pages.withColumn("payload", F.from_json(F.nullif(text, F.lit("")), schema))


def player_match_rows(stats: DataFrame) -> DataFrame:
    """Match metrics with fallbacks: shots and goals for xG, key passes for xA."""
    return stats.withColumns({
        "xg": F.round(match_xg(F.col("xg"), F.col("shots"), F.col("goals")), 4), "xa": F.round(match_xa(F.col("xa"), F.col("key_passes")), 4),
    })


def momentum_points(df: DataFrame, column: str = "graphPoints") -> DataFrame:
    """Graph points of a match as series rows."""
    p = df.select("event_id", F.posexplode(column).alias("ordinal", "p"))
    return p.select("event_id", "ordinal", F.col("p.minute").alias("minute"), F.col("p.value").alias("value"))


def clean_records(df: DataFrame, error: Column) -> DataFrame:
    """Drop error records; an absent flag is no error."""
    return df.where(~F.coalesce(error, F.lit(False)))
