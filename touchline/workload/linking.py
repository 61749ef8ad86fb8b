"""Joins, linkage and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.text import normalize_name, taker_tokens
from touchline.operators import joins, linkage
from touchline.operators.ordered import next_after
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, PLAYERS_SQL, rnd


@query("full_outer_reconcile", "C03, L02, G01", """WITH a AS (SELECT l_orderkey, l_suppkey, count(*) AS c FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_suppkey, count(*) AS c FROM lineitem WHERE l_tax >= 0.02 GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, coalesce(a.c, 0) AS count_a, coalesce(b.c, 0) AS count_b, coalesce(a.c, 0) - coalesce(b.c, 0) AS difference,
  CASE WHEN coalesce(a.c, 0) > coalesce(b.c, 0) THEN 'a_over_b' ELSE 'b_over_a' END AS direction
FROM a FULL JOIN b USING (l_orderkey, l_suppkey) WHERE coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def _(t):
    one = t.lineitem.withColumn("n", F.lit(1))
    return joins.reconcile(one.where(F.col("l_returnflag") != "N"), one.where(F.col("l_tax") >= 0.02), ["l_orderkey", "l_suppkey"], "n")


@query("total_against_lines", "C03", f"""SELECT o_orderkey, {rnd('coalesce(s, 0)', 2)} AS line_total, {rnd('o_totalprice - coalesce(s, 0)', 2)} AS gap FROM orders
    LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > coalesce(s, 0) + 1""")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    both = joins.lookup(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"], {"s": 0.0})
    both = both.where(F.col("o_totalprice") > F.col("s") + 1)
    return both.select("o_orderkey", F.round("s", 2).alias("line_total"), F.round(F.col("o_totalprice") - F.col("s"), 2).alias("gap"))


@query("dimension_lookup", "C01, C02, C21", """SELECT c_custkey, coalesce(n_name, 'unknown') AS team, CASE n_regionkey WHEN 0 THEN 95.0 WHEN 1 THEN 80.0 WHEN 2 THEN 60.0 ELSE 40.0 END AS rank_score
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""".replace("95.0", "CAST(95 AS DOUBLE)"))
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team"), "n_regionkey")
    out = joins.lookup(t.customer.select("c_custkey", "c_nationkey"), n, ["c_nationkey"], {"team": "unknown"})
    out = joins.literal_lookup(out, [(0, 95.0), (1, 80.0), (2, 60.0)], "n_regionkey int, rank_score double", ["n_regionkey"])
    return out.select("c_custkey", "team", F.coalesce("rank_score", F.lit(40.0)).alias("rank_score"))


NAMES_A = "a AS (SELECT p_partkey AS id, p_partkey AS ord, p_brand AS scope, p_name AS name FROM part)"


@query("cascade_name_match", "C04", """WITH r AS (SELECT p_brand AS scope, p_name AS name, max(p_partkey) AS id, min(p_partkey) AS ord FROM part WHERE p_size <= 25 GROUP BY 1, 2),
l AS (SELECT p_partkey AS left_id, p_brand AS scope, p_name || ' jr ' || split_part(p_name, ' ', -1) AS long_name, p_name FROM part WHERE p_size > 25),
q AS (SELECT left_id, scope, CASE WHEN left_id % 2 = 0 THEN p_name ELSE long_name END AS name FROM l),
m AS (SELECT q.left_id, q.scope, q.name, e.id AS exact,
   (SELECT count(*) FROM r WHERE r.scope = q.scope AND list_contains(string_split(r.name, ' '), split_part(q.name, ' ', -1))) AS n,
   (SELECT arg_min(id, ord) FROM r WHERE r.scope = q.scope AND list_contains(string_split(r.name, ' '), split_part(q.name, ' ', -1))) AS only_id,
   (SELECT arg_min(id, ord) FROM r WHERE r.scope = q.scope AND list_contains(string_split(r.name, ' '), split_part(q.name, ' ', -1))
       AND list_contains(string_split(r.name, ' '), split_part(q.name, ' ', 1))) AS both_id
   FROM q LEFT JOIN r e ON e.scope = q.scope AND e.name = q.name)
SELECT left_id, scope, coalesce(exact, CASE WHEN n = 1 THEN only_id WHEN n > 1 THEN both_id END) AS match_id,
  CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'last_token' WHEN n > 1 AND both_id IS NOT NULL THEN 'first_and_last' END AS stage FROM m""")
def _(t):
    p = t.part.select("p_partkey", F.col("p_brand").alias("scope"), F.col("p_name").alias("name"), "p_size")
    right = p.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), "scope", "name")
    longer = F.concat_ws(" jr ", F.col("name"), F.element_at(F.split("name", " "), -1))
    left = p.where(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("left_id"), "scope", F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(longer).alias("name")
    )
    return linkage.cascade_match(left, right, "left_id", "id", "ord", scope=["scope"])


@query("fuzzy_first_match", "C05, H02, G02", """WITH l AS (SELECT p_partkey AS left_id, p_brand AS scope, p_name AS name FROM part WHERE p_size > 25),
r AS (SELECT p_partkey AS id, p_brand AS scope, p_name AS name FROM part WHERE p_size <= 25),
j AS (SELECT left_id, l.scope, r.id FROM l JOIN r ON l.scope = r.scope AND (l.name = r.name OR EXISTS (
   SELECT 1 FROM (SELECT unnest(list_intersect(string_split(l.name, ' '), string_split(r.name, ' '))) AS w) WHERE length(w) > 3)))
SELECT scope, left_id, min(id) AS match_id, min(id) AS match_ordinal, count(DISTINCT id) > 1 AS ambiguous FROM j GROUP BY 1, 2""")
def _(t):
    p = t.part.select("p_partkey", F.col("p_brand").alias("scope"), normalize_name(F.col("p_name")).alias("name"), "p_size")
    right = p.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), "scope", "name")
    left = p.where(F.col("p_size") > 25).select(F.col("p_partkey").alias("left_id"), "scope", "name")
    return linkage.fuzzy_first(left, right, "left_id", "id", "ord", scope=["scope"])


PAIR_SQL = """p AS (SELECT o_orderkey AS id, 'team ' || CAST(o_custkey % 997 AS VARCHAR) || ' club' || CAST(o_custkey AS VARCHAR) AS home, 'side' || CAST(o_custkey AS VARCHAR) || ' fc' AS away,
   CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 3 END AS sh, CAST(floor(o_totalprice) AS BIGINT) % 2 AS sa, o_orderstatus FROM orders)"""


@query("fixture_linkage", "C06, L03", f"""WITH {PAIR_SQL}, l AS (SELECT * FROM p WHERE o_orderstatus <> 'O'), r AS (SELECT * FROM p WHERE o_orderstatus = 'O')
SELECT l.id AS left_id, min(r.id) AS match_id FROM l LEFT JOIN r ON l.home = r.home AND l.away = r.away
  AND (l.sh IS NULL OR r.sh IS NULL OR (l.sh = r.sh AND l.sa = r.sa)) GROUP BY 1""")
def _(t):
    c = F.col("o_custkey")
    s = lambda x: x.cast("string")
    price = F.floor("o_totalprice")
    p = t.orders.select(
        F.col("o_orderkey").alias("left_id"), F.col("o_orderkey").alias("id"), "o_orderstatus",
        F.concat(F.lit("team "), s(c % 997), F.lit(" club"), s(c)).alias("home"), F.concat(F.lit("side"), s(c), F.lit(" fc")).alias("away"),
        F.when(F.col("o_orderkey") % 5 > 0, price % 3).alias("score_home"), (price % 2).alias("score_away"),
    )
    left = p.where(F.col("o_orderstatus") != "O").drop("id")
    right = p.where(F.col("o_orderstatus") == "O").drop("left_id")
    return linkage.link_fixtures(left, right, "left_id", "id", "id")


LEFTOVER_SQL = """WITH RECURSIVE lines AS (SELECT l_orderkey AS o, l_linenumber AS line, p_name AS name, l_returnflag AS flag, list_concat(['=' || p_name], list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 3), lambda x: '~' || x)) AS keys,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT * FROM lines WHERE flag = 'A'), b AS (SELECT * FROM lines WHERE flag = 'R'),
c AS (SELECT a.o, a.k, coalesce(list(b.k ORDER BY b.k) FILTER (b.k IS NOT NULL), []) AS found FROM a LEFT JOIN b ON a.o = b.o AND list_has_any(a.keys, b.keys) GROUP BY ALL),
fold AS (SELECT o, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT o FROM a)
  UNION ALL SELECT f.o, c.k, CASE WHEN len(list_filter(c.found, lambda x: NOT list_contains(f.taken, x))) > 0 THEN list_append(f.taken, list_filter(c.found, lambda x: NOT list_contains(f.taken, x))[1]) ELSE f.taken END FROM fold f JOIN c ON c.o = f.o AND c.k = f.k + 1),
last AS (SELECT o, arg_max(taken, k) AS taken FROM fold GROUP BY o)
SELECT a.o AS l_orderkey, 'a' AS source, line, name FROM a JOIN c USING (o, k) WHERE len(found) = 0
UNION ALL SELECT b.o, 'b', line, name FROM b LEFT JOIN last ON last.o = b.o WHERE taken IS NULL OR NOT list_contains(taken, k)"""


@query("scorer_leftovers", "C07", LEFTOVER_SQL)
def _(t):
    """Lines of an order named by part: shipped ones against returned ones."""
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").select(
        "l_orderkey", "name", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"), "l_returnflag"
    )
    a = lines.where(F.col("l_returnflag") == "A").drop("l_returnflag")
    b = lines.where(F.col("l_returnflag") == "R").drop("l_returnflag")
    out = linkage.match_scorers(a, b, ["l_orderkey"])
    return out.select("l_orderkey", "source", F.col("ordinal.l_linenumber").alias("line"), "name")


@query("unordered_pair_join", "C10", f"""WITH {FIXTURES_SQL}, f AS (SELECT *, least(home, away) || '|' || greatest(home, away) AS pair FROM fixtures),
q AS (SELECT least(home, away) || '|' || greatest(home, away) AS pair, arg_min(home, event_id) AS first_home, arg_min(away, event_id) AS first_away, count(*) AS met FROM fixtures GROUP BY 1)
SELECT event_id, met, home <> first_home AS swapped FROM f JOIN q USING (pair)""")
def _(t):
    f = t.fixtures().select("event_id", "home", "away")
    pair = joins.unordered_pair(F.col("home"), F.col("away"))
    first = f.groupBy(pair.alias("pair")).agg(
        F.min_by("home", "event_id").alias("first_home"), F.min_by("away", "event_id").alias("first_away"), F.count("*").alias("met")
    )
    out = joins.join_unordered(f, first.drop("pair"), ("home", "away"), ("first_home", "first_away"))
    return out.select("event_id", "met", F.when(F.col("home") != F.col("first_home"), True).otherwise(False).alias("swapped"))


@query("alias_join", "C11", """SELECT c_mktsegment, o_status, count(*) AS n FROM (SELECT c_mktsegment, CASE o_orderstatus WHEN 'P' THEN 'OPEN' WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END AS o_status
    FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2""")
def _(t):
    alias = t.spark.createDataFrame([("P", "OPEN"), ("O", "OPEN")], "alias string, canonical string")
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("o_status"))
    named = joins.with_alias(o, "o_status", F.broadcast(alias), "alias", "canonical")
    return named.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment", "o_status").agg(F.count("*").alias("n"))


@query("squad_semi_and_anti", "C12, C13, G03", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS played FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def _(t):
    squad = t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    played = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    yes = squad.join(played, "c_custkey", "left_semi").withColumn("played", F.lit(True))
    no = squad.join(played, "c_custkey", "left_anti").withColumn("played", F.lit(False))
    return yes.unionByName(no)


@query("next_fixture_asof", "C14", f"""WITH {FIXTURES_SQL}, s AS (SELECT DISTINCT team, played, event_id FROM sides),
miss AS (SELECT event_id AS miss_id, team, played FROM sides WHERE gf = 0 AND ga = 4)
SELECT miss_id, team, (SELECT arg_min(event_id, (s.played, event_id)) FROM s WHERE s.team = miss.team AND s.played > miss.played) AS next_event,
  CAST((SELECT min(s.played) FROM s WHERE s.team = miss.team AND s.played > miss.played) AS VARCHAR) AS next_played FROM miss""")
def _(t):
    s = t.sides().withColumn("day", F.unix_date("played"))
    miss = s.where((F.col("gf") == 0) & (F.col("ga") == 4)).select(F.col("event_id").alias("miss_id"), "team", "day")
    calendar = s.select("team", F.col("day").alias("next_day"), "event_id", F.col("played").cast("string").alias("played"))
    out = next_after(miss, calendar, ["team"], "day", "next_day", ["event_id", "played"], ["event_id"])
    return out.select("miss_id", "team", F.col("next_event_id").alias("next_event"), "next_played")


@query("opponent_strengths", "C16", f"""WITH {FIXTURES_SQL}, s AS (SELECT team, avg(gf) AS att, avg(ga) AS def FROM sides GROUP BY 1)
SELECT event_id, is_home, {rnd('s.att')} AS opp_att, {rnd('s.def')} AS opp_def FROM sides JOIN s ON s.team = opponent""")
def _(t):
    s = t.sides()
    strengths = s.groupBy("team").agg(F.avg("gf").alias("att"), F.avg("ga").alias("def"))
    out = joins.with_opponent(s, strengths, ["att", "def"])
    return out.select("event_id", "is_home", F.round("opp_att", 4).alias("opp_att"), F.round("opp_def", 4).alias("opp_def"))


@query("setpiece_roles", "C17, H18", """WITH taker AS (SELECT DISTINCT p_brand AS team, p_type AS kind, p_name AS taker, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_name) AS first_id FROM part WHERE p_size <= 12),
tk AS (SELECT team, kind, (row_number() OVER (PARTITION BY team, kind ORDER BY first_id)) - 1 AS idx, list_filter(string_split(taker, ' '), lambda x: length(x) >= 4) AS tt FROM taker),
pl AS (SELECT p_partkey AS player_id, p_brand AS team, list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4) AS nt FROM part)
SELECT player_id, kind, min(idx) AS idx, CASE WHEN min(idx) = 0 THEN kind || '_primary' ELSE kind || '_secondary' END AS role
FROM pl JOIN tk USING (team) WHERE len(tt) > 0 AND list_has_all(nt, tt) GROUP BY 1, 2""")
def _(t):
    from pyspark.sql import Window

    players = t.part.select(F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("team"), taker_tokens(F.col("p_name")).alias("name_tokens"))
    lists = t.part.where(F.col("p_size") <= 12).groupBy(F.col("p_brand").alias("team"), F.col("p_type").alias("kind"), "p_name").agg(F.min("p_partkey").alias("first_id"))
    idx = F.row_number().over(Window.partitionBy("team", "kind").orderBy("first_id")) - 1
    takers = lists.select("team", "kind", idx.cast("long").alias("idx"), taker_tokens(F.col("p_name")).alias("taker_tokens"))
    return joins.setpiece_roles(players, takers).select("player_id", "kind", "idx", "role")


@query("matchup_projection", "C19, F09", f"""WITH {PLAYERS_SQL}, s AS (SELECT team, avg(yellow / games) AS d FROM players GROUP BY 1),
pairs AS (SELECT DISTINCT a.p_brand AS home, b.p_brand AS away FROM lineitem l1 JOIN part a ON a.p_partkey = l1.l_partkey JOIN part b ON b.p_size = a.p_size AND b.p_partkey = a.p_partkey + 1 WHERE a.p_brand <> b.p_brand),
m AS (SELECT home, away, home AS team, away AS opponent FROM pairs UNION ALL SELECT home, away, away, home FROM pairs)
SELECT m.home, m.away, player_id, {rnd('xg / minutes * 90 * (1 + s.d)')} AS xpts FROM m JOIN players USING (team) JOIN s ON s.team = m.opponent
QUALIFY row_number() OVER (PARTITION BY m.home, m.away ORDER BY round(xg / minutes * 90 * (1 + s.d), 6) DESC, player_id) <= 40""")
def _(t):
    players = t.stored_players()
    strengths = players.groupBy("team").agg(F.avg(F.col("yellow") / F.col("games")).alias("d"))
    a = t.part.join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_size", F.col("p_brand").alias("home"))
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_size", F.col("p_brand").alias("away"))
    pairs = a.join(b, ["p_partkey", "p_size"]).where(F.col("home") != F.col("away")).select("home", "away").distinct()
    best = joins.top_matchups(pairs, players, strengths, F.col("xg") / F.col("minutes") * 90, 1 + F.col("d"), 40)
    return best.select("home", "away", "player_id", F.round("x", 4).alias("xpts"))


@query("infer_side_team", "C20", f"""WITH {FIXTURES_SQL}, lu AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 2 = 0 AS is_home, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT l_orderkey, is_home, arg_min(p_brand, (l_linenumber, p_brand)) AS guess FROM lu GROUP BY 1, 2),
k AS (SELECT o_orderkey AS l_orderkey, o_orderkey % 2 = 0 AS is_home, CASE WHEN o_orderkey % 3 = 0 THEN 'known ' || o_orderstatus END AS team FROM orders)
SELECT l_orderkey, is_home, coalesce(team, guess) AS team FROM k FULL JOIN g USING (l_orderkey, is_home)""")
def _(t):
    k = F.col("o_orderkey")
    known = t.orders.select(k.alias("l_orderkey"), (k % 2 == 0).alias("is_home"), F.when(k % 3 == 0, F.concat(F.lit("known "), "o_orderstatus")).alias("team"))
    seen = t.lineitem.select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("is_home"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("player_id"))
    players = t.part.select(F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("club"))
    return joins.infer_team(known, seen, players, "l_orderkey")


@query("positional_zip", "C23", """WITH s AS (SELECT l_orderkey, l_extendedprice AS sold, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS position FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_orderkey, l_extendedprice AS bought, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS position FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, position, round(bought - sold, 2) AS gain FROM s JOIN b USING (l_orderkey, position)""")
def _(t):
    side = lambda flag, name: t.lineitem.where(F.col("l_returnflag") == flag).select("l_orderkey", F.col("l_partkey").alias(f"{name}_part"), F.col("l_extendedprice").alias(name))
    order = lambda name: [F.col(name).desc(), F.col(f"{name}_part")]
    out = joins.zip_ranked(side("R", "sold"), side("N", "bought"), ["l_orderkey"], order("sold"), order("bought"))
    return out.select("l_orderkey", F.col("position").cast("long").alias("position"), F.round(F.col("bought") - F.col("sold"), 2).alias("gain"))


@query("override_precedence", "B13, L12", """WITH ov AS (SELECT o_custkey AS c_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS priority,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'missing' WHEN '2-HIGH' THEN 'substitute' WHEN '3-MEDIUM' THEN 'rotation' ELSE 'starter' END AS value FROM orders WHERE o_orderstatus = 'P')
SELECT customer.c_custkey, coalesce(arg_min(value, priority), 'derived') AS status FROM customer LEFT JOIN ov ON ov.c_custkey = customer.c_custkey GROUP BY 1""")
def _(t):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).otherwise(3)
    names = F.array(*[F.lit(x) for x in ("missing", "substitute", "rotation", "starter")])
    ov = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"), rank.alias("priority"))
    ov = ov.withColumn("value", F.element_at(names, F.col("priority") + 1))
    return joins.apply_overrides(t.customer.select("c_custkey"), "c_custkey", ov, F.lit("derived"), "status")


@query("key_set_union", "G01, G04", """SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def _(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return joins.union_all([a, b]).distinct()


@query("append_absent_neutral", "G06, G05", f"""WITH {PLAYERS_SQL} SELECT player_id, xg AS xpts FROM (SELECT player_id, {rnd('xg')} AS xg FROM players WHERE pos = 'F' UNION ALL SELECT p_partkey, 0.0 FROM part WHERE p_partkey NOT IN (SELECT player_id FROM players WHERE pos = 'F'))""")
def _(t):
    main = t.players().where(F.col("pos") == "F").select("player_id", F.round("xg", 4).alias("xpts"))
    return joins.append_absent(main, t.part.select(F.col("p_partkey").alias("player_id")), ["player_id"], {"xpts": 0.0})


@query("append_with_dedup", "G05, A18", """SELECT k, arg_min(v, src) AS v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v, 0 AS src FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
    UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer) GROUP BY 1""")
def _(t):
    main = t.orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return joins.append_dedup(main, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), ["k"])
