"""Column-level work: filters, rates, codes, banding, text and score functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import pitch, probability as pr, scalars as sc, scoring, text
from touchline.operators.joins import either_contains, first_substring, match_sides
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, PLAYERS_SQL, rnd


@query("minimum_exposure", "B01, B07, B06", f"""WITH {PLAYERS_SQL} SELECT player_id, {rnd('goals / minutes * 90')} AS goals_90,
    {rnd('(CASE WHEN xg = 0 THEN shots * 0.095 ELSE xg END) / minutes * 90')} AS xg_90,
    {rnd('(CASE WHEN xa = 0 THEN key_passes * 0.08 ELSE xa END) / minutes * 90')} AS xa_90 FROM players WHERE minutes >= 90""")
def _(t):
    p = t.players().where(F.col("minutes") >= 90)
    return p.select(
        "player_id", F.round(sc.per90(F.col("goals"), F.col("minutes")), 4).alias("goals_90"),
        F.round(sc.per90(sc.season_xg(F.col("xg"), F.col("shots")), F.col("minutes")), 4).alias("xg_90"),
        F.round(sc.per90(sc.season_xa(F.col("xa"), F.col("key_passes")), F.col("minutes")), 4).alias("xa_90"),
    )


@query("time_range_and_sets", "B02, B03, B18", """SELECT event_id, user_id, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('error', 'purchase') AND event_type NOT IN ('signup')""")
def _(t):
    ts = F.col("ts")
    return t.events.where(
        (ts >= F.lit("2024-01-10").cast("timestamp_ntz")) & (ts < F.lit("2024-01-20").cast("timestamp_ntz"))
        & F.col("event_type").isin("error", "purchase") & ~F.col("event_type").isin("signup")
    ).select("event_id", "user_id", "value")


@query("clamp_default_blend", "B04, B05, H17", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CASE WHEN l_discount IS NULL OR l_discount = 0 THEN 0.05 ELSE l_discount END AS discount,
    greatest(5.0, least(40.0, l_quantity)) AS quantity,
    {rnd('0.45 * l_quantity + 0.55 * least(l_tax * 100, 6.0)')} AS blended FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", sc.or_default(F.col("l_discount"), 0.05).alias("discount"),
        sc.clamp(q, 5.0, 40.0).alias("quantity"), F.round(scoring.blend_form(q, F.col("l_tax") * 100, F.lit(6.0), 0.55), 4).alias("blended"),
    )


@query("match_metric_fallback", "B06", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    {rnd("coalesce(CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END, greatest(l_linenumber * 0.095, (CAST(l_quantity AS INTEGER) % 3) * 0.5))")} AS xg,
    {rnd("coalesce(CASE WHEN l_linestatus = 'F' THEN l_tax END, l_linenumber * 0.08)")} AS xa FROM lineitem""")
def _(t):
    xg = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    goals = F.col("l_quantity").cast("int") % 3
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(sc.match_xg(xg, F.col("l_linenumber"), goals), 4).alias("xg"),
        F.round(sc.match_xa(F.when(F.col("l_linestatus") == "F", F.col("l_tax")), F.col("l_linenumber")), 4).alias("xa"),
    )


@query("code_map_default", "B08, C02", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'G' WHEN '2-HIGH' THEN 'D'
    WHEN '3-MEDIUM' THEN 'M' ELSE 'F' END AS pos, CASE o_orderstatus WHEN 'F' THEN 95 WHEN 'O' THEN 60 ELSE 40 END AS rank_score FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", sc.code_map(F.col("o_orderpriority"), {"1-URGENT": "G", "2-HIGH": "D", "3-MEDIUM": "M"}, "F").alias("pos"),
        sc.code_map(F.col("o_orderstatus"), {"F": 95, "O": 60}, 40).alias("rank_score"),
    )


@query("archetype_rules", "B09", f"""WITH {PLAYERS_SQL}, r AS (SELECT *, xg / minutes * 90 AS x, xa / minutes * 90 AS a, shots / minutes * 90 / 5 AS s,
    key_passes / minutes * 90 AS k FROM players)
SELECT player_id, CASE WHEN pos = 'F' THEN CASE WHEN a >= 0.14 AND s < 2.2 THEN 'wide_fwd' WHEN s >= 2.0 AND a < 0.10 THEN 'box_striker'
      WHEN s >= 1.7 AND a >= 0.10 THEN 'complete_striker' WHEN x >= 0.25 AND s < 1.5 THEN 'poacher' ELSE 'pressing_fwd' END
    WHEN pos = 'M' THEN CASE WHEN s >= 2.0 AND x >= 0.20 THEN 'shadow_striker' WHEN a >= 0.22 THEN 'playmaker'
      WHEN x >= 0.10 AND a >= 0.10 THEN 'attacking_mid' WHEN a >= 0.13 AND k >= 1.3 THEN 'creative_mid' WHEN x >= 0.12 THEN 'goalscoring_mid'
      WHEN x < 0.05 AND a < 0.07 THEN 'cdm' ELSE 'box_to_box' END
    WHEN pos = 'D' THEN CASE WHEN a >= 0.12 OR (k >= 1.8 AND a >= 0.07) THEN 'overlapping_def' WHEN a >= 0.07 OR x >= 0.10 THEN 'attacking_def' ELSE 'defender' END
    ELSE 'other' END AS player_type FROM r""")
def _(t):
    m = F.col("minutes")
    rate = lambda c: sc.per90(F.col(c), m)
    return t.players().select(
        "player_id", scoring.archetype(F.col("pos"), rate("xg"), rate("xa"), rate("shots") / 5, rate("key_passes")).alias("player_type")
    )


@query("threshold_bands", "B10", """SELECT c_custkey, CASE WHEN s >= 72 THEN 5 WHEN s >= 56 THEN 4 WHEN s >= 38 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END AS fdr,
    CASE WHEN s >= 60 THEN 'starter' WHEN s >= 35 THEN 'rotation' ELSE 'substitute' END AS role FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)""")
def _(t):
    s = F.col("c_acctbal") / 100
    return t.customer.select("c_custkey", pitch.difficulty(s).alias("fdr"), scoring.role(s).alias("role"))


@query("perspective_unpivot", "B11, B12", f"""WITH {FIXTURES_SQL} SELECT event_id, is_home, team, opponent, gf, ga,
    CASE WHEN is_home THEN gf - ga ELSE -(ga - gf) END AS signed FROM sides""")
def _(t):
    s = match_sides(t.fixtures(), keep=["event_id"])
    home_diff = F.when(F.col("is_home"), F.col("gf") - F.col("ga")).otherwise(F.col("ga") - F.col("gf"))
    return s.withColumn("signed", sc.side_sign(home_diff, F.col("is_home")))


@query("text_search", "B14", """SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')
    OR contains(lower(p_brand), 'ring')) AND p_size >= 10""")
def _(t):
    cols = [F.col(c) for c in ("p_name", "p_type", "p_brand")]
    return t.part.where(text.search_any(cols, "Ring") & (F.col("p_size") >= 10)).select("p_partkey")


@query("quality_alerts", "B19, F01", f"""WITH {PLAYERS_SQL} SELECT player_id, team, {rnd('xg / minutes * 90')} AS xg_90 FROM players
    WHERE minutes / games < 25 AND xg / minutes * 90 > 0.15""")
def _(t):
    rate = sc.per90(F.col("xg"), F.col("minutes"))
    bench = t.players().where((F.col("minutes") / F.col("games") < 25) & (rate > 0.15))
    return bench.select("player_id", "team", F.round(rate, 4).alias("xg_90")).orderBy(F.col("xg_90").desc(), "player_id")


@query("participation_gates", "B20", f"""WITH g AS (SELECT c_custkey, count(o_orderkey) * 6.0 AS recent, c_acctbal / 1000 AS xpts, 0.9 AS old_p
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT *, CASE WHEN recent < 30 THEN 0.08 WHEN recent < 60 THEN 0.45 ELSE old_p END AS new_p,
    CASE WHEN recent < 30 THEN 25 WHEN recent < 60 THEN 55 ELSE 85 END AS mins, CASE WHEN recent < 30 THEN 'substitute' WHEN recent < 60 THEN 'rotation' ELSE 'starter' END AS role FROM g)
SELECT c_custkey, CAST(new_p AS DOUBLE) AS new_p, mins, role, {rnd('xpts * new_p / old_p', 6)} AS xpts FROM n""")
def _(t):
    from touchline.plans.tournament import apply_gates

    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 6.0).alias("recent"))
    base = t.customer.join(seen, "c_custkey", "left").fillna(0.0, ["recent"])
    base = base.select("c_custkey", "recent", (F.col("c_acctbal") / 1000).alias("xpts"), F.lit(0.9).alias("p_play"))
    gates = [(30.0, 0.08, 25, "substitute"), (60.0, 0.45, 55, "rotation")]
    out = apply_gates(base, "recent", gates, (85, "starter"))
    return out.select("c_custkey", F.col("p_play").alias("new_p"), "mins", "role", F.round("xpts", 6).alias("xpts"))


ENTRIES = [("ECO", 0.95), ("SMALL", 0.90), ("STANDARD", 0.88), ("PROM", 0.80), ("E", 0.70)]
TYPE_SQL = "CASE WHEN contains(lower(p_type), 'eco') THEN 0.95 WHEN contains(lower(p_type), 'small') THEN 0.90 WHEN contains(lower(p_type), 'standard') THEN 0.88 WHEN contains(lower(p_type), 'prom') THEN 0.80 WHEN contains(lower(p_type), 'e') THEN 0.70 ELSE 0.85 END"


@query("substring_lookup", "C08", f"SELECT p_partkey, CAST({TYPE_SQL} AS DOUBLE) AS quality FROM part")
def _(t):
    return t.part.select("p_partkey", first_substring(F.col("p_type"), ENTRIES, 0.85).alias("quality"))


WORDS = [("red widget", 90.0), ("ring", 60.0), ("old bolt and nut", 40.0), ("small", 30.0)]


@query("two_way_lookup", "C09", """SELECT p_partkey, CAST(CASE WHEN p_name = 'red widget' THEN 90.0 WHEN p_name = 'ring' THEN 60.0 WHEN p_name = 'old bolt and nut' THEN 40.0
    WHEN p_name = 'small' THEN 30.0 WHEN contains(n, 'red widget') OR contains('red widget', n) THEN 90.0 WHEN contains(n, 'ring') OR contains('ring', n) THEN 60.0
    WHEN contains(n, 'old bolt and nut') OR contains('old bolt and nut', n) THEN 40.0 WHEN contains(n, 'small') OR contains('small', n) THEN 30.0 ELSE 20.0 END AS DOUBLE) AS score
    FROM (SELECT *, lower(p_name) AS n FROM part)""")
def _(t):
    return t.part.select("p_partkey", either_contains(F.col("p_name"), WORDS, 20.0).alias("score"))


@query("name_normalisation", "H01, H02, G02", """SELECT conv_id, turn, role, length(n) AS letters, md5(n) AS digest,
    CASE WHEN n = '' THEN '' ELSE split_part(n, ' ', -1) END AS last_token, len(list_distinct(list_filter(string_split(n, ' '), lambda x: length(x) >= 4))) AS long_tokens
    FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS n FROM conversations)""")
def _(t):
    n = text.normalize_name(F.col("text"))
    c = t.conversations.select("conv_id", "turn", "role", n.alias("n"))
    return c.select(
        "conv_id", "turn", "role", F.length("n").cast("long").alias("letters"), F.md5(F.col("n").cast("binary")).alias("digest"),
        text.last_token(F.col("n")).alias("last_token"),
        F.size(F.filter(text.tokens(F.col("n")), lambda x: F.length(x) >= 4)).cast("long").alias("long_tokens"),
    )


@query("keyword_containment", "H03, H06", """SELECT doc_id, regexp_matches(lower(text), 'license|copyright|password') AS has_keyword,
    CASE WHEN regexp_matches(text, 'license|copyright', 'i') THEN 'owngoal' WHEN regexp_matches(text, 'penal|\\(EP\\)', 'i') THEN 'penalty' ELSE 'regular' END AS kind FROM documents""")
def _(t):
    c = F.col("text")
    kind = F.when(c.rlike("(?i)license|copyright"), "owngoal").when(c.rlike(r"(?i)penal|\(EP\)"), "penalty").otherwise("regular")
    return t.documents.select("doc_id", text.contains_any(c, ["license", "copyright", "password"]).alias("has_keyword"), kind.alias("kind"))


@query("value_parsing", "H04, H05", """SELECT o_orderkey, CAST(round(CAST(regexp_extract(replace(v, ',', '.'), '([\\d.]+)', 1) AS DOUBLE) *
      CASE WHEN v LIKE '%M' THEN 1000000 WHEN v LIKE '%k' THEN 1000 ELSE 1 END) AS BIGINT) AS value,
    (round((o_orderkey % 7 + 1) / (o_custkey % 5 + 1) + 1, 4) + 0.0) AS odds, CAST(o_orderkey % 101 AS DOUBLE) AS pct, CAST(o_orderkey % 6 AS INTEGER) AS home, CAST(o_custkey % 4 AS INTEGER) AS away
    FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 90 + 1 AS VARCHAR) || ',50M' WHEN 1 THEN CAST(o_custkey % 900 AS VARCHAR) || 'k' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders)""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    money = F.when(k % 3 == 0, F.concat(s(c % 90 + 1), F.lit(",50M"))).when(k % 3 == 1, F.concat(s(c % 900), F.lit("k"))).otherwise(s(c))
    score = F.concat(s(k % 6), F.lit(":"), s(c % 4))
    return t.orders.select(
        "o_orderkey", text.market_value(money).alias("value"), sc.decimal_odds(F.concat(s(k % 7 + 1), F.lit("/"), s(c % 5 + 1))).alias("odds"),
        sc.percent_value(F.concat(s(k % 101), F.lit("%"))).alias("pct"), sc.score_part(score, 1).alias("home"), sc.score_part(score, 2).alias("away"),
    )


@query("dates_and_ages", "H07, H22", f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
    {rnd("date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 365.25", 2)} AS age FROM orders""")
def _(t):
    day = sc.iso_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", day.cast("string").alias("day"), F.round(sc.age_years(day, F.lit("2001-08-02").cast("date")), 2).alias("age"))


@query("odds_to_probability", "H10, H11", f"""SELECT event_type, user_id, event_id, {rnd('1 / h / v')} AS p_home, {rnd('1 / d / v')} AS p_draw, {rnd('1 / a / v')} AS p_away,
    {rnd('greatest(0.3, least(4.0, -ln(greatest(1 - 1 / h / v, 0.01)) * 1.8))')} AS goals
    FROM (SELECT *, 1 / h + 1 / d + 1 / a AS v FROM (SELECT *, 1.1 + value / 50 AS h, 3.0 + value / 200 AS d, 2.0 + user_id / 100 AS a FROM events))""")
def _(t):
    e = t.events.select("event_type", "user_id", "event_id", (1.1 + F.col("value") / 50).alias("h"), (3.0 + F.col("value") / 200).alias("d"), (2.0 + F.col("user_id") / 100).alias("a"))
    p = [sc.implied_probability(F.col(c)) for c in "hda"]
    n = [sc.without_margin(p[0], p[1], p[2]), sc.without_margin(p[1], p[0], p[2]), sc.without_margin(p[2], p[0], p[1])]
    return e.select(
        "event_type", "user_id", "event_id", F.round(n[0], 4).alias("p_home"), F.round(n[1], 4).alias("p_draw"), F.round(n[2], 4).alias("p_away"),
        F.round(sc.implied_goals(n[0]), 4).alias("goals"),
    )


@query("shot_quality", "H12, H13, H14, H15", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_discount * 1000 AS y, l_tax FROM lineitem),
d AS (SELECT *, x / 100 * 105 AS dep, abs((y - 50) / 100) * 68 AS lat FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  {rnd('greatest(0.02, least(0.85, 0.95 * exp(-0.115 * sqrt(dep * dep + lat * lat)) * (degrees(atan2(7.32, greatest(dep, 0.5))) / 55)))', 3)} AS xg,
  {rnd('greatest(0.02, least(0.85, 3.5 / (1 + (x * x + (y - 50) * (y - 50)) / 80)))', 3)} AS xg_against,
  CASE WHEN y < 35 THEN 'left' WHEN y > 65 THEN 'right' ELSE 'center' END AS zone,
  {rnd('l_linenumber * 0.35 + greatest(x - l_linenumber, 0) * 0.08 + x * 0.035', 4)} AS xgc,
  {rnd('greatest(0.0, least(100.0, 100 - (x / 20 - 0.4) * 52)) * 0.65 + least(100.0, l_tax * 10 * 130) * 0.35')} AS def_score,
  {rnd('least(100.0, x / 20 * 42) * 0.65 + least(100.0, x / 25 * 33) * 0.35')} AS att_score FROM d""")
def _(t):
    x, y, n = F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", pitch.location_xg(x, y).alias("xg"),
        F.round(pitch.rational_xg(x, y, F.lit(True)), 3).alias("xg_against"), pitch.zone(y).alias("zone"), F.round(pitch.conceded_xg(n, x, x), 4).alias("xgc"),
        F.round(pitch.defence_score(x / 20, F.col("l_tax") * 10), 4).alias("def_score"), F.round(pitch.attack_score(x / 20, x / 25), 4).alias("att_score"),
    )


@query("play_probability", "H19, H20, H24, H25, H27, H28", f"""WITH {PLAYERS_SQL}, q AS (SELECT *, minutes / games * 2 AS m, goals / games AS br FROM players),
r AS (SELECT *, CASE pos WHEN 'G' THEN 0.96 WHEN 'D' THEN greatest(0.10, least(0.94, (m - 10) / 70)) WHEN 'M' THEN greatest(0.05, least(0.92, (m - 20) / 65))
        ELSE greatest(0.05, least(0.90, (m - 25) / 60)) END AS p60,
    yellow / 0.78 * 0.76 / (minutes / 90) AS pen, xg / minutes * 90 AS x,
    CASE WHEN team IN ('Brand#1', 'Brand#2') THEN 1.15 ELSE 1.03 END AS venue FROM q)
SELECT player_id, {rnd('p60')} AS p60, {rnd('games / (games + 8.0) * greatest(0.0, x - pen) + (1 - games / (games + 8.0)) * 0.2 + pen')} AS xg_reg,
  {rnd('br * (1 + least(br, 0.3) / 0.3 * 2) * 0.9')} AS bonus, CAST(venue AS DOUBLE) AS venue,
  CASE WHEN price > 0 THEN {rnd('goals / price', 2)} END AS per_price, CASE WHEN xg > 0 THEN {rnd('goals - xg', 2)} END AS xg_over,
  CASE pos WHEN 'G' THEN {rnd('least(round(br, 3), 0.8) * greatest(0.35, p60 / 0.65)', 3)} WHEN 'D' THEN {rnd('least(round(br, 3), 0.8) * greatest(0.60, 0.5 + p60 / 0.65 * 0.5)', 3)}
     ELSE least(round(br, 3), 0.8) END AS bonus_adj FROM r""")
def _(t):
    p = t.players().withColumns({"m": F.col("minutes") / F.col("games") * 2, "br": F.col("goals") / F.col("games")})
    pos, mins = F.col("pos"), F.col("minutes")
    p60 = scoring.play60(pos, F.col("m"))
    pen = scoring.penalty_xg90(F.col("yellow"), mins)
    return p.select(
        "player_id", F.round(p60, 4).alias("p60"),
        F.round(scoring.regress_open_play(sc.per90(F.col("xg"), mins), pen, F.col("games"), F.lit(0.2), 8.0), 4).alias("xg_reg"),
        F.round(scoring.bonus_expectation(F.col("br"), F.lit(0.9)), 4).alias("bonus"),
        scoring.venue_multiplier(F.lit(True), F.col("team"), F.lit(""), ["Brand#1", "Brand#2"]).alias("venue"),
        scoring.points_per_price(F.col("goals"), F.col("price")).alias("per_price"), scoring.over_performance(F.col("goals"), F.col("xg")).alias("xg_over"),
        scoring.adjust_bonus(F.col("br"), pos, p60).alias("bonus_adj"),
    )


@query("expected_points", "H23, H08", f"""WITH {PLAYERS_SQL}, q AS (SELECT *, least(0.7, xg / minutes * 90) AS pg, least(0.55, xa / minutes * 90) AS pa, exp(-(1 + yellow / games)) AS pcs FROM players),
r AS (SELECT player_id, pos, pg * CASE pos WHEN 'F' THEN 4 WHEN 'M' THEN 5 ELSE 8 END AS goal, pa * 3 AS assist,
  pcs * CASE pos WHEN 'G' THEN 5 WHEN 'D' THEN 4 WHEN 'M' THEN 1 ELSE 0 END AS clean_sheet, 2 * 55 / 90.0 AS minutes, -(yellow / games) AS cards,
  pg * 0.28 / greatest(xg, 0.5) * 3 AS decisive_goal, CASE WHEN pos = 'G' THEN shots / games / 4.0 * (55 / 90.0) ELSE 0 END AS saves FROM q)
SELECT player_id, {rnd('goal')} AS goal, {rnd('clean_sheet')} AS clean_sheet, {rnd('decisive_goal')} AS decisive_goal, {rnd('saves')} AS saves,
  {rnd('goal + assist + clean_sheet + minutes + cards + decisive_goal + saves')} AS total FROM r""")
def _(t):
    mins, games = F.col("minutes"), F.col("games")
    pg, pa = F.least(F.lit(0.7), sc.per90(F.col("xg"), mins)), F.least(F.lit(0.55), sc.per90(F.col("xa"), mins))
    cards = F.col("yellow") / games
    b = scoring.expected_points(F.col("pos"), pg, pa, pr.clean_sheet(1 + cards), F.lit(55 / 90), cards, F.col("xg"), F.col("shots") / games)
    out = t.players().select("player_id", b.alias("b"))
    return out.select(
        "player_id", *[F.round(F.col("b")[c], 4).alias(c) for c in ("goal", "clean_sheet", "decisive_goal", "saves")],
        F.round(scoring.breakdown_total(F.col("b")), 4).alias("total"),
    )


@query("type_multiplier", "H16, H26", f"""WITH {PLAYERS_SQL}, q AS (SELECT player_id, CASE pos WHEN 'F' THEN 'box_striker' WHEN 'M' THEN 'playmaker' WHEN 'D' THEN 'overlapping_def' ELSE 'other' END AS player_type,
   xg - 1.5 AS bv, xa - 0.6 AS wv FROM players),
w AS (SELECT *, CASE player_type WHEN 'box_striker' THEN bv * 0.14 WHEN 'playmaker' THEN wv * 0.03 WHEN 'overlapping_def' THEN bv * 0.01 ELSE 0 END AS g,
   CASE player_type WHEN 'box_striker' THEN bv * 0.02 WHEN 'playmaker' THEN wv * 0.13 WHEN 'overlapping_def' THEN wv * 0.10 ELSE 0 END AS a,
   CASE player_type WHEN 'box_striker' THEN 1.0 WHEN 'playmaker' THEN 0.15 WHEN 'overlapping_def' THEN 0.10 ELSE 0 END AS sg,
   CASE player_type WHEN 'box_striker' THEN 0.0 WHEN 'playmaker' THEN 0.85 WHEN 'overlapping_def' THEN 0.90 ELSE 0 END AS sa FROM q),
m AS (SELECT player_id, player_type, {rnd('greatest(0.9, least(1.1, 1 + g))', 3)} AS goal_mult, {rnd('greatest(0.9, least(1.1, 1 + a))', 3)} AS assist_mult, sg, sa FROM w)
SELECT player_id, player_type, goal_mult, assist_mult, {rnd('sg * (goal_mult - 1) * 100 + sa * (assist_mult - 1) * 100', 1)} AS style_match FROM m""")
def _(t):
    kind = sc.code_map(F.col("pos"), {"F": "box_striker", "M": "playmaker", "D": "overlapping_def"}, "other")
    p = t.players().select("player_id", kind.alias("player_type"), (F.col("xg") - 1.5).alias("bv"), (F.col("xa") - 0.6).alias("wv"))
    return scoring.with_type_multipliers(p, "bv", "wv").drop("bv", "wv")


@query("club_country_blend", "H17", f"""WITH {PLAYERS_SQL}, q AS (SELECT player_id, pos, xg / minutes * 90 AS c, games AS cn, xa / minutes * 180 AS i, CAST(yellow * 2 AS DOUBLE) AS n FROM players),
b AS (SELECT *, CASE WHEN n >= 3 THEN (0.7 * c * cn + 0.3 * i * n) / (0.7 * cn + 0.3 * n) ELSE c END AS base, i / nullif(c, 0) AS ratio,
   n >= (CASE WHEN pos = 'D' THEN 10 ELSE 5 END) AND c > 0.02 AS ok FROM q),
w AS (SELECT *, CASE WHEN ratio < (CASE WHEN pos = 'D' THEN 0.40 ELSE 0.60 END) THEN (CASE WHEN pos = 'D' THEN 0.55 ELSE 0.50 END)
   WHEN ratio < (CASE WHEN pos = 'D' THEN 0.55 ELSE 0.75 END) THEN (CASE WHEN pos = 'D' THEN 0.65 ELSE 0.60 END) WHEN ratio > 1.25 THEN 0.55 END AS wt FROM b)
SELECT player_id, {rnd('CASE WHEN ok AND wt IS NOT NULL THEN wt * c + (1 - wt) * i ELSE base END')} AS xg_90 FROM w""")
def _(t):
    m = F.col("minutes")
    c, i = sc.per90(F.col("xg"), m), sc.per90(F.col("xa"), m) * 2
    n = (F.col("yellow") * 2).cast("double")
    base = scoring.blend_club_country(c, F.col("games"), i, n)
    return t.players().select("player_id", F.round(scoring.blend_by_ratio(F.col("pos"), c, i, n, base), 4).alias("xg_90"))
