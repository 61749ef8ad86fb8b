"""Feed flattening, pages, incremental selection and streaming-shaped batches.

Nested feeds are built per row from the driver tables (an order becomes a match document),
then flattened by the same functions that read landed files.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions.text import tag_text
from touchline.session import shared_folder, spread
from touchline.sources import feeds, readers, schemas, sinks
from touchline.sources.keyed import read_keyed_ranges
from touchline.workload.registry import query
from touchline.workload.tables import rnd


def doc(t, column: str, schema: str, text):
    """Orders as one JSON text per match, parsed with the feed's schema."""
    o = spread(t.orders).select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("home_id"), (F.col("o_custkey") + 1).alias("away_id"), text.alias("_json")
    )
    return o.withColumn(column, F.from_json("_json", schema)).drop("_json")


@query("keyed_object_rows", "A01, H21", """SELECT CAST(o_custkey AS VARCHAR) AS team, o_orderkey, 'F' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT CAST(o_custkey + 1 AS VARCHAR), o_orderkey, 'S', 1.0 FROM orders""")
def _(t):
    text = F.format_string('{"%d": {"kind": "F", "amount": %s}, "%d": {"kind": "S", "amount": 1.0}}', "o_custkey", F.col("o_totalprice").cast("string"), F.col("o_custkey") + 1)
    o = t.orders.select("o_orderkey", F.from_json(text, "map<string, struct<kind: string, amount: double>>").alias("m"))
    return o.select("o_orderkey", F.explode("m").alias("team", "v")).select("team", "o_orderkey", "v.kind", "v.amount")


@query("keyed_file_rows", "A01, H21", """SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_custkey AS cust, 'a "b" } {' || o_orderstatus AS note, o_orderkey % 3 AS first FROM orders""")
def _(t):
    """Orders written as files that each hold one keyed object, and read back in byte ranges."""
    path = f"{shared_folder(t.spark)}/keyed-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    value = F.to_json(F.struct(F.col("o_custkey").alias("cust"), F.concat(F.lit('a "b" } {'), "o_orderstatus").alias("note"), F.array(F.struct((k % 3).alias("x"))).alias("list")))
    pairs = t.orders.select(F.floor(k / 20_000).alias("part"), F.concat(F.lit('"'), k.cast("string"), F.lit('": '), value).alias("pair"))
    files = pairs.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("pair"), ",\n"), F.lit("}")).alias("value"))  # 20,000 keys a file
    files.write.partitionBy("part").text(path)
    rows = read_keyed_ranges(t.spark, f"{path}/*/*.txt", "order_key", "struct<cust: long, note: string, list: array<struct<x: long>>>")
    return rows.select("order_key", "cust", "note", F.col("list")[0]["x"].alias("first"))


@query("named_array_rows", "A02", """SELECT event_id, CAST(key AS INTEGER) AS ordinal, CAST(json_extract_string(props, '$.k') AS INTEGER) + key AS k FROM events, generate_series(0, 1) g(key)""")
def _(t):
    text = F.concat(F.lit('{"fixtures": ['), "props", F.lit(", "), "props", F.lit("]}"))
    d = t.events.select("event_id", F.from_json(text, "fixtures array<struct<k: int>>").alias("d"))
    rows = readers.array_rows(d.select("event_id", "d.fixtures"), "fixtures", ["event_id"])
    return rows.select("event_id", "ordinal", (F.col("k") + F.col("ordinal")).alias("k"))


def incident_docs(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pen = F.when(k % 4 == 0, "penalty").when(k % 4 == 1, "fromCorner").when(k % 4 == 2, "ownGoal").otherwise("regular")
    text = F.format_string(
        '[{"incidentType": "goal", "incidentClass": "%s", "time": %d, "addedTime": 2, "isHome": %s, "player": {"id": %d, "name": "p"}, "homeScore": 1, "awayScore": 0, "rescinded": %s},'
        ' {"incidentType": "card", "incidentClass": "%s", "time": 70, "isHome": false, "player": {"id": %d, "name": "q"}}, {"incidentType": "substitution", "time": 60, "addedTime": 1, "isHome": true, "playerIn": {"id": 1}, "playerOut": {"id": 2}},'
        ' {"incidentType": "period", "text": "FT", "time": 90, "addedTime": 4}]',
        pen, (k % 90 + 1).cast("int"), (k % 2 == 0).cast("string"), c, (k % 10 == 0).cast("string"), F.when(k % 3 == 0, "red").otherwise("yellow"), c + 1,
    )
    return feeds.incidents(doc(t, "incidents", f"array<{schemas.INCIDENT}>", text))


@query("incident_goals", "A04, B18", """SELECT o_orderkey AS event_id, CAST(o_orderkey % 90 + 1 + 1.0 AS DOUBLE) AS minute, o_custkey AS player_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS team_id,
    CASE WHEN o_orderkey % 4 < 2 THEN 'set_piece' ELSE 'open_play' END AS build_up, o_orderkey % 4 = 0 AS is_penalty, o_orderkey % 4 = 2 AS is_own_goal FROM orders WHERE o_orderkey % 10 <> 0""")
def _(t):
    return feeds.goals(incident_docs(t)).select("event_id", "minute", "player_id", "team_id", "build_up", "is_penalty", "is_own_goal")


@query("incident_cards_and_subs", "A04, C14", """SELECT o_orderkey AS event_id, 'card' AS kind, o_custkey + 1 AS player_id, o_orderkey % 3 = 0 AS flag FROM orders UNION ALL SELECT o_orderkey, 'sub', 1, TRUE FROM orders""")
def _(t):
    inc = incident_docs(t)
    c = feeds.cards(inc).select("event_id", F.lit("card").alias("kind"), "player_id", F.col("misses_next").alias("flag"))
    s = feeds.substitutions(inc).select("event_id", F.lit("sub").alias("kind"), F.col("player_in").alias("player_id"), F.col("is_home").alias("flag"))
    return c.unionByName(s)


def lineup_docs(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = (
        '{"team": {"name": "%s"}, "players": [{"player": {"id": %d, "name": "a"}, "position": "M", "statistics": {"rating": 7.5, "goals": 1}}, {"player": {"id": %d, "name": "b"}, "statistics": {"goals": 2}}],'
        ' "substitutes": [{"player": {"id": %d, "name": "b"}, "statistics": {"rating": 6.5}}], "missingPlayers": [{"player": {"id": %d, "name": "c"}, "type": "injury"}, {"player": {"id": %d, "name": "a"}}]}'
    )
    text = F.format_string(f'{{"home": {side}, "away": {side}}}', F.lit("h"), c, c + 1, c + 1, c + 2, c, F.lit("v"), c + 10, c + 11, c + 12, c + 2, c + 13)
    return doc(t, "d", f"struct<home: {schemas.LINEUP_SIDE}, away: {schemas.LINEUP_SIDE}>", text).select("event_id", "d.home", "d.away")


@query("lineup_precedence", "A05", """SELECT o_orderkey AS event_id, o_custkey + d AS player_id, s AS status, tm AS team FROM orders, (VALUES (0, 'starter', 'h'), (1, 'starter', 'h'), (2, 'missing', 'h'), (10, 'starter', 'v'), (11, 'starter', 'v'), (12, 'substitute', 'v'), (13, 'missing', 'v')) v(d, s, tm)""")
def _(t):
    return feeds.lineups(lineup_docs(t)).select("event_id", "player_id", "status", "team")


@query("lineup_statistics", "A06", """SELECT o_orderkey AS event_id, o_custkey + d AS player_id, CAST(r AS DOUBLE) AS rating, CAST(g AS DOUBLE) AS goals, CAST(0 AS DOUBLE) AS saves FROM orders, (VALUES (0, 7.5, 1), (1, 6.5, 0), (10, 7.5, 1), (12, 6.5, 0)) v(d, r, g)""")
def _(t):
    return feeds.lineup_statistics(lineup_docs(t), ["goals", "saves"]).select("event_id", "player_id", "rating", "goals", "saves")


@query("period_statistics", "A07, H05", """SELECT o_orderkey AS event_id, p AS period, s AS stat, CAST(CASE WHEN s = 'Ball possession' THEN o_orderkey % 101 ELSE o_custkey % 20 END AS DOUBLE) AS home, CAST(CASE WHEN s = 'Ball possession' THEN 100 - o_orderkey % 101 END AS DOUBLE) AS away
    FROM orders, (VALUES ('ALL'), ('1ST')) a(p), (VALUES ('Ball possession'), ('Total shots')) b(s)""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = '[{"statisticsItems": [{"name": "Ball possession", "home": "%d%%", "away": "%d%%"}, {"name": "Total shots", "home": "%d", "away": "n/a"}, {"name": "Offsides", "home": "1", "away": "1"}]}]'
    text = F.format_string(f'[{{"period": "ALL", "groups": {item}}}, {{"period": "1ST", "groups": {item}}}]', k % 101, 100 - k % 101, c % 20, k % 101, 100 - k % 101, c % 20)
    d = doc(t, "statistics", f"array<{schemas.PERIOD}>", text)
    return feeds.period_statistics(d, ["Ball possession", "Total shots"])


@query("odds_markets", "A08, H05", f"""SELECT o_orderkey AS event_id, {rnd('(o_orderkey % 7 + 1) / 5 + 1')} AS odds_home, {rnd('(o_custkey % 9 + 1) / 4 + 1')} AS odds_away, CAST(1.8 AS DOUBLE) AS over, CAST(2.0 AS DOUBLE) AS both_yes FROM orders""")
def _(t):
    text = F.format_string(
        '[{"marketGroup": "1X2", "marketName": "Full time", "choices": [{"name": "1", "fractionalValue": "%d/5"}, {"name": "X", "fractionalValue": "5/2"}, {"name": "2", "fractionalValue": "%d/4"}]},'
        ' {"marketGroup": "1X2", "marketName": "Full time", "isLive": true, "choices": [{"name": "1", "fractionalValue": "9/1"}]}, {"marketGroup": "g", "marketName": "Over/Under 2.5", "choices": [{"name": "Over", "fractionalValue": "4/5"}]},'
        ' {"marketGroup": "b", "marketName": "Both teams to score", "choices": [{"name": "Yes", "fractionalValue": "1/1"}]}]',
        F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 9 + 1,
    )
    out = feeds.odds_markets(doc(t, "markets", f"array<{schemas.MARKET}>", text))
    return out.select("event_id", "odds_home", "odds_away", "over", "both_yes")


@query("transfer_history", "A09", """SELECT o_orderkey AS player_id, x AS transfer_id, f.n_name AS from_club, g.n_name AS to_club, o_totalprice AS fee, x = 1 AS is_loan, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date
    FROM orders, generate_series(0, 1) s(x) JOIN nation f ON f.n_nationkey = o_custkey % 25 LEFT JOIN nation g ON g.n_nationkey = o_orderkey % 30""")
def _(t):
    one = (
        '{"transferSource": {"clubId": "%d"}, "transferDestination": {"clubId": "%d"}, "typeDetails": {"type": "%s"}, "details": {"date": "%sT00:00:00", "season": {"display": "24/25"}, "age": 23, "fee": {"value": %s}}}'
    )
    day, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string")
    text = F.format_string(f'{{"t": [{one}], "p": [{one}]}}', F.col("o_custkey") % 25, F.col("o_orderkey") % 30, F.lit("SALE"), day, price, F.col("o_custkey") % 25, F.col("o_orderkey") % 30, F.lit("LOAN"), day, price)
    d = doc(t, "d", f"struct<t: array<{schemas.TRANSFER}>, p: array<{schemas.TRANSFER}>>", text)
    d = d.select(F.col("event_id").alias("player_id"), F.col("d.t").alias("terminated"), F.col("d.p").alias("pending"))
    clubs = t.nation.select(F.col("n_nationkey").cast("string").alias("club_id"), F.col("n_name").alias("club"))
    out = feeds.transfer_history(d, clubs)
    return out.select("player_id", F.col("transfer_id").cast("long").alias("transfer_id"), "from_club", "to_club", "fee", "is_loan", F.col("date").cast("string").alias("date"))


@query("fixture_rows", "A10, H07", """SELECT o_orderkey AS event_id, o_custkey AS home_id, CAST(o_custkey % 4 AS INTEGER) AS score_home, CAST(NULL AS INTEGER) AS score_away, o_orderpriority AS home, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def _(t):
    text = F.format_string(
        '{"id": %d, "homeTeam": {"id": %d, "name": "%s"}, "awayTeam": {"id": 1, "name": "x"}, "startTimestamp": %d, "status": {"type": "finished"}, "homeScore": {"current": %d}, "roundInfo": {"round": 2}}',
        "o_orderkey", "o_custkey", "o_orderpriority", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.col("o_custkey") % 4,
    )
    out = feeds.fixture_rows(doc(t, "event", schemas.EVENT, text).select("event"))
    return out.select("event_id", "home_id", "score_home", "score_away", "home", F.to_date("kickoff").cast("string").alias("day"))


@query("squad_entry_shapes", "A11", """SELECT c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'D' END AS pos, c_mktsegment AS team FROM customer""")
def _(t):
    k = F.col("c_custkey")
    wrapped = F.format_string('{"player": {"id": %d, "name": "%s", "positionObject": {"name": "M"}}, "jerseyNumber": "7"}', k, "c_name")
    bare = F.format_string('{"id": %d, "name": "%s", "position": "D"}', k, "c_name")
    d = t.customer.select(F.col("c_mktsegment").alias("team"), F.from_json(F.when(k % 2 == 0, wrapped).otherwise(bare), schemas.SQUAD_ENTRY).alias("entry"))
    return feeds.squad_entries(d).select("player_id", "name", "pos", "team")


@query("page_links", "A12", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1), 1) - 1 AS ordinal FROM pages) SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, href FROM l""")
def _(t):
    return feeds.page_links(t.pages, ["page_id"]).select("page_id", "ordinal", "href")


@query("page_titles", "A12, H06", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS n FROM pages""")
def _(t):
    title = tag_text(F.col("html"), "title")
    return t.pages.select("page_id", title.alias("title"), F.length(title).cast("long").alias("n"))


@query("embedded_payload", "A13", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def _(t):
    page = F.concat(F.lit("<script>const D = "), "props", F.lit(";</script>"))
    d = feeds.embedded_json(t.events.select("event_id", page.alias("html")), "D", "struct<k: int>")
    return d.select("event_id", "payload.k")


@query("ordered_report", "A14, F01", f"""SELECT l_suppkey, {rnd('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1""")
def _(t):
    out = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return out.orderBy(F.col("total").desc(), "l_suppkey")


@query("pending_keys", "A17, C13", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return sinks.pending(t.orders.select("o_orderkey"), done, ["o_orderkey"], empty=F.col("l_returnflag") != "R")


@query("upsert_by_version", "A18", """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, year(o_orderdate) AS y FROM orders) SELECT o_custkey, arg_max(o_orderkey, (y, o_orderkey)) AS o_orderkey, CAST(max(y) AS INTEGER) AS y FROM b GROUP BY 1""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    newest = lambda d: d.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "y"), F.struct("y", "o_orderkey")).alias("m")).select("o_custkey", "m.*")
    return sinks.upsert(newest(o.where(F.col("y") < 1999)), newest(o.where(F.col("y") >= 1999)), ["o_custkey"], "y")


@query("member_sync", "A19", """WITH cur AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS m FROM orders WHERE year(o_orderdate) < 1999), snap AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS m FROM orders WHERE year(o_orderdate) >= 1999 AND o_orderpriority <> '5-LOW')
SELECT g, m, EXISTS (SELECT 1 FROM cur WHERE cur.g = snap.g AND cur.m = snap.m) AS kept FROM snap UNION ALL SELECT g, m, TRUE FROM cur WHERE g NOT IN (SELECT g FROM snap)""")
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("m"), F.year("o_orderdate").alias("y"))
    cur = o.where(F.col("y") < 1999).select("g", "m").distinct().withColumn("kept", F.lit(True))
    snap = o.where((F.col("y") >= 1999) & (F.col("g") != "5-LOW")).select("g", "m").distinct().withColumn("kept", F.lit(False))
    return sinks.sync_members(cur, snap, "g", "m")


@query("wide_player_detection", "L14, B16", f"""WITH m AS (SELECT l_partkey, avg(l_linenumber) AS crosses, avg(l_quantity / 20) AS shots, count(*) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY 1)
SELECT l_partkey AS player_id, {rnd('crosses', 2)} AS avg_crosses, {rnd('shots', 6)} AS avg_shots, n AS matches FROM m WHERE crosses >= 2 AND crosses > 2 * shots AND shots <= 1.5""")
def _(t):
    from touchline.plans.tournament import wide_players

    rows = t.lineitem.select(F.col("l_partkey").alias("player_id"), F.lit("p").alias("name"), F.lit("t").alias("team"), F.col("l_quantity").alias("mins"), F.col("l_linenumber").alias("crosses"), (F.col("l_quantity") / 20).alias("shots"))
    out = wide_players(rows)
    return out.select("player_id", F.round("avg_crosses", 2).alias("avg_crosses"), F.round("avg_shots", 6).alias("avg_shots"), "matches")


@query("squad_gaps", "B21", """SELECT n_name AS team, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1 HAVING count(c_custkey) < 20""")
def _(t):
    from touchline.plans.tournament import squad_gaps

    teams = t.nation.select(F.col("n_name").alias("team"), F.lit(1).alias("has_stats"), "n_nationkey")
    squad = t.customer.where(F.col("c_acctbal") > 9000).join(teams, F.col("n_nationkey") == F.col("c_nationkey")).select("team", F.col("c_custkey").alias("player_id"))
    return squad_gaps(teams.select("team", "has_stats"), squad).select("team", "n")
