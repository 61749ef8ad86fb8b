"""Whole jobs: sinks and publishing, audits, suspensions, flat intake, plans with kept players."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions.scalars import round_to
from touchline.functions.text import goal_kind
from touchline.operators.ordered import top_n
from touchline.plans import audit, strength, tournament, transfers
from touchline.session import durable, shared_folder
from touchline.sources import feeds, readers, sinks
from touchline.workload.fitting import RIDGE_SQL
from touchline.workload.landing import incident_docs
from touchline.workload.linking import LEFTOVER_SQL
from touchline.workload.matches import MARKET_SQL, NOW, RANK_SQL, ranks, rated_matches, win_sql
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, PLAYERS_SQL, rnd


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("published_versions", "A16, A18", f"SELECT o_custkey, count(*) AS n, {rnd('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1")
def _(t):
    """Two runs are published, the pointer goes back to the first, and its table is read."""
    root = folder(t, "published")
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    sinks.publish(totals, root, "all")
    sinks.publish(sinks.latest(t.spark, root).where(F.col("n") > 10), root, "busy")
    sinks.point(t.spark, root, "all", expected="busy", check=True)
    return sinks.latest(t.spark, root)


@query("csv_report_round_trip", "A14, F01", f"SELECT l_suppkey, count(*) AS n, {rnd('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1")
def _(t):
    path = folder(t, "report")
    totals = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    sinks.write_csv(totals, path, [F.col("total").desc(), F.col("l_suppkey")])
    return t.spark.read.schema(totals.schema).option("header", True).csv(path)


@query("json_table_round_trip", "A15, A01", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    path = folder(t, "orders-json")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    sinks.write_json(rows, path)
    return readers.read_lines(t.spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


@query("partition_refresh", "A15, A03", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE o_totalprice END AS price FROM orders")
def _(t):
    """A table by status, one partition of it replaced, with an input that was never landed."""
    path = folder(t, "by-status")
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    sinks.write_table(rows, path, ["o_orderstatus"])
    sinks.write_table(rows.where(F.col("o_orderstatus") == "F").withColumn("price", F.floor("price").cast("double")), path, ["o_orderstatus"])
    late = readers.optional(t.spark, folder(t, "late"), rows.schema, t.spark.read.parquet)
    return t.spark.read.parquet(path).select(*rows.columns).unionByName(late)


MARKET_STEPS = MARKET_SQL[MARKET_SQL.index("q AS (SELECT event_id, lh"):MARKET_SQL.index("SELECT event_id, TRUE AS market_used")]
PREDICT_SQL = f"""WITH RECURSIVE {RANK_SQL},
fm AS (SELECT team, avg(gf) + 0.5 AS f0 FROM sides GROUP BY 1), fo AS (SELECT team, 0.7 + 0.3 * f0 / (SELECT avg(f0) FROM fm) AS form FROM fm),
lam AS (SELECT event_id, home, away, greatest(0.2, least(5.0, coalesce(h.alpha, 1) * coalesce(a.beta, 1) * (SELECT max(lg) FROM str) * coalesce(fh.form, 1))) AS lh,
  greatest(0.2, least(5.0, coalesce(a.alpha, 1) * coalesce(h.beta, 1) * (SELECT max(lg) FROM str) * coalesce(fa.form, 1))) AS la
  FROM fixtures LEFT JOIN str h ON h.team = home LEFT JOIN str a ON a.team = away LEFT JOIN fo fh ON fh.team = home LEFT JOIN fo fa ON fa.team = away),
{MARKET_STEPS},
bl AS (SELECT event_id, event_id % 2 = 0 AS quoted, CASE WHEN event_id % 2 = 0 THEN greatest(0.2, least(5.0, lh * 0.4 + total * r / (1 + r) * 0.6)) ELSE lh END AS lh,
  CASE WHEN event_id % 2 = 0 THEN greatest(0.2, least(5.0, la * 0.4 + total / (1 + r) * 0.6)) ELSE la END AS la FROM q JOIN found USING (event_id))
SELECT event_id, quoted AS market_used, {rnd('lh', 3)} AS lambda_home, {rnd('la', 3)} AS lambda_away, {rnd(win_sql('lh', 'la'), 4)} AS p_home_win FROM bl"""


@query("market_predictions", "L09, K06, H10, H11", PREDICT_SQL)
def _(t):
    """Every match from strengths and form; one in two has odds, which pull the expected goals."""
    k = F.col("event_id")
    quoted = k % 2 == 0
    odds = {"odds_home": 1.8 + (k % 7) / 5, "odds_draw": 3.0 + (k % 3) / 4, "odds_away": 2.2 + (k % 5) / 3}
    fx = t.fixtures().select("event_id", "home", "away").withColumns({n: F.when(quoted, c) for n, c in odds.items()})
    raw = durable(t.sides().groupBy("team").agg((F.avg("gf") + 0.5).alias("f0")))
    form = raw.select("team", (F.col("f0") / raw.agg(F.avg("f0")).scalar()).alias("form"))
    out = strength.predict_fixtures(rated_matches(t), ranks(t), fx, form, [], F.lit(NOW).cast("date"))
    return out.select("event_id", "market_used", *[F.round(c, 3).alias(c) for c in ("lambda_home", "lambda_away")], "p_home_win")


@query("count_audit", "L02, C03, B18", """WITH a AS (SELECT o_orderkey AS event_id, o_custkey AS player_id, 1 AS n FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS event_id, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS player_id, o_orderkey % 3 AS n FROM orders WHERE o_orderkey % 3 > 0)
SELECT event_id, player_id, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'a_over_b' ELSE 'b_over_a' END AS direction, 'goals' AS stat
FROM a FULL JOIN b USING (event_id, player_id) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(t):
    inc = incident_docs(t).where(F.col("kind") == "goal")
    k = F.col("o_orderkey")
    lineups = t.orders.select(k.alias("event_id"), (F.col("o_custkey") + (k % 7 == 0).cast("int")).alias("player_id"), (k % 3).alias("goals"))
    return audit.count_audit(inc, lineups, "goals").drop("difference")


NAME_AUDIT_SQL = LEFTOVER_SQL.replace("SELECT l_orderkey AS o, l_linenumber AS line,", "SELECT l_orderkey * 2 + l_linenumber % 2 AS o, l_linenumber AS line,").replace(
    "PARTITION BY l_orderkey, l_returnflag ORDER BY", "PARTITION BY l_orderkey, l_linenumber % 2, l_returnflag ORDER BY"
).replace("FROM lineitem JOIN part ON l_partkey = p_partkey", "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 5 > 0 AND l_suppkey % 7 > 0")
NAME_AUDIT_SQL = NAME_AUDIT_SQL[:NAME_AUDIT_SQL.index("SELECT a.o AS l_orderkey")] + """SELECT a.o // 2 AS match_id, a.o % 2 AS side, 'a' AS source, line, name FROM a JOIN c USING (o, k) WHERE len(found) = 0
UNION ALL SELECT b.o // 2, b.o % 2, 'b', line, name FROM b LEFT JOIN last ON last.o = b.o WHERE taken IS NULL OR NOT list_contains(taken, k)"""


@query("name_audit", "L03, C06, C07", NAME_AUDIT_SQL)
def _(t):
    """Orders as matches in two sources; the names agree, every fifth score does not; lines are goals, of two flags as of two sources."""
    k = F.col("o_orderkey")
    tag = F.concat(F.lit("club"), k.cast("string"))
    fixtures = t.orders.select(k.alias("match_id"), F.concat(tag, F.lit("a fc")).alias("home"), F.concat(tag, F.lit("b")).alias("away"), (k % 4).alias("score_home"), (k % 3).alias("score_away"), k.alias("ordinal"))
    feed = fixtures.withColumns({"home": F.regexp_replace("home", " fc$", ""), "score_home": F.col("score_home") + (F.col("match_id") % 5 == 0).cast("int")})
    lines = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").select(
        F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2).alias("side"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"), "name",
        F.when(F.col("l_suppkey") % 7 == 0, "owngoal").otherwise("regular").alias("kind"), "l_returnflag",
    )
    goals = lambda flag: lines.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    out = audit.name_audit(fixtures, feed, goals("A"), goals("R"))
    return out.select("match_id", "side", "source", F.col("ordinal.l_linenumber").alias("line"), "name")


@query("suspension_carry", "C14, L12, A04", """WITH ev AS (SELECT o_orderkey AS e, o_custkey AS c, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS r FROM orders),
cal AS (SELECT e, c AS team, r FROM ev UNION ALL SELECT e, c + 1, r FROM ev), red AS (SELECT DISTINCT c + 1 AS p, r FROM ev WHERE e % 3 = 0),
miss AS (SELECT DISTINCT p, e FROM (SELECT p, red.r, arg_min(cal.e, (cal.r, cal.e)) AS e FROM red JOIN cal ON cal.team = red.p AND cal.r > red.r GROUP BY 1, 2)),
own AS (SELECT e, c AS team, c AS p, 'substitute' AS status FROM ev UNION ALL SELECT e, c + 1, c + 1, 'starter' FROM ev)
SELECT e AS event_id, team, p AS player_id, status, NULL AS reason FROM own ANTI JOIN miss USING (e, p) UNION ALL SELECT e, p, p, 'missing', 'suspension' FROM miss""")
def _(t):
    """Players sent off miss their team's next fixture, whether it has an entry of theirs or not."""
    c = F.col("o_custkey")
    fixtures = t.orders.select(F.col("o_orderkey").alias("event_id"), c.alias("home"), (c + 1).alias("away"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("round_num"))
    entry = lambda d, s: F.struct((F.col("home") + d).alias("team"), (F.col("home") + d).alias("player_id"), F.lit(s).alias("status"), F.lit(None).cast("string").alias("reason"))
    lineups = fixtures.select("event_id", F.explode(F.array(entry(0, "substitute"), entry(1, "starter"))).alias("x")).select("event_id", "x.*")
    return tournament.carry_with_suspensions(lineups, incident_docs(t), fixtures, fixtures).select("event_id", "team", "player_id", "status", "reason")


@query("match_record_rows", "L15, E17, B06", f"""WITH e AS (SELECT o_orderkey AS k FROM orders),
x AS (SELECT k, 1 AS p, 34 AS mins, 'sub_in' AS status, TRUE AS h FROM e UNION ALL SELECT k, 2, 61, 'starter', TRUE FROM e UNION ALL SELECT k, 5000, 94, 'starter', TRUE FROM e UNION ALL SELECT k, 5001, 0, 'missing', FALSE FROM e)
SELECT k AS match_id, p AS player_id, mins, status, h AS is_home, CASE WHEN p = 5000 THEN k % 3 ELSE 0 END AS goals,
  {rnd("CASE WHEN p <> 5000 THEN 0 WHEN k % 2 = 0 THEN 0.3 ELSE greatest((k % 9) * 0.095, (k % 3) * 0.5) END")} AS xg, {rnd("CASE WHEN p = 5000 THEN (k % 4) * 0.08 ELSE 0 END")} AS xa FROM x""")
def _(t):
    k = F.col("o_orderkey")
    one = lambda p, s, h, r=None: F.struct(F.lit(p).cast("long").alias("player_id"), F.lit(s).alias("status"), F.lit(h).alias("is_home"), F.lit("n").alias("name"), F.lit(r).cast("string").alias("reason"))
    entries = F.explode(F.array(one(1, "bench", True), one(2, "starter", True), one(5000, "starter", True), one(5001, "missing", False, "injury"))).alias("x")
    lineup = t.orders.select(k.alias("match_id"), entries).select("match_id", "x.*")
    stats = t.orders.select(
        k.alias("match_id"), F.lit(5000).cast("long").alias("player_id"), (k % 3).alias("goals"), (k % 2).alias("assists"), F.lit(7.0).alias("rating"), F.when(k % 2 == 0, 0.3).alias("xg"),
        F.lit(None).cast("double").alias("xa"), F.lit(0).alias("saves"), (k % 9).alias("shots"), (k % 4).alias("key_passes"),
    )
    out = tournament.match_records(lineup, incident_docs(t), stats).where(F.col("status").isNotNull())
    return out.select("match_id", "player_id", "mins", "status", "is_home", "goals", F.round("xg", 4).alias("xg"), F.round("xa", 4).alias("xa"))


@query("flat_intake", "L16, E16", f"""WITH g AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_linenumber IN (1, 4)),
c AS (SELECT l_orderkey, l_linenumber AS cut FROM g WHERE n = 2)
SELECT l_orderkey AS event_id, l_partkey AS player_id, coalesce(l_linenumber < cut, TRUE) AS is_home, CASE WHEN coalesce(l_linenumber >= cut, FALSE) THEN l_orderkey + 1 ELSE l_orderkey END AS team_id,
  CASE WHEN l_quantity * 2 - 2 >= 60 THEN 'starter' ELSE 'sub_in' END AS status, {rnd('greatest((l_suppkey % 5) * 0.095, (l_suppkey % 2) * 0.5)')} AS xg
FROM lineitem LEFT JOIN c USING (l_orderkey) WHERE l_quantity * 2 - 2 >= 5""")
def _(t):
    s = F.col("l_suppkey")
    lists = t.lineitem.select(
        F.col("l_orderkey").alias("event_id"), F.col("l_orderkey").alias("home_id"), (F.col("l_orderkey") + 1).alias("away_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("player_id"),
        F.lit("n").alias("name"), F.when(F.col("l_linenumber").isin(1, 4), "G").otherwise("M").alias("position"), (F.col("l_quantity") * 2 - 2).alias("mins"), F.lit(None).cast("double").alias("xg"),
        F.lit(None).cast("double").alias("xa"), (s % 2).alias("goals"), (s % 5).alias("shots"), (s % 3).alias("key_passes"),
    )
    return tournament.intake_flat(lists).select("event_id", "player_id", "is_home", "team_id", "status", F.round("xg", 4).alias("xg"))


@query("recent_minutes_gate", "L13, B20", f"""WITH {PLAYERS_SQL}, p AS (SELECT player_id, CASE WHEN player_id % 4 > 0 THEN CAST(games * 7 % 100 AS DOUBLE) END AS m, (games % 9 + 1) / 10 AS share, (yellow % 8 + 1) / 10 AS p_play, round(xg * 9.9731, 4) AS xpts, player_id % 5 = 0 AS fixed FROM players),
n AS (SELECT *, CASE WHEN m IS NOT NULL THEN round(least(1.0, m / 90), 3) END AS s2, CASE WHEN m IS NOT NULL THEN round(greatest(0.05, least(0.95, m / 75)), 2) END AS p2 FROM p)
SELECT player_id, {rnd('coalesce(s2, share)', 3)} AS mins_share, {rnd('coalesce(p2, p_play)', 2)} AS p_play, {rnd('CASE WHEN m IS NULL THEN xpts ELSE xpts * (s2 / share * (p2 / p_play)) END', 2)} AS xpts,
  CASE WHEN m IS NULL OR fixed THEN 'given' WHEN p2 >= 0.80 THEN 'starter' WHEN p2 >= 0.50 THEN 'rotation' ELSE 'substitute' END AS role FROM n""")
def _(t):
    k = F.col("player_id")
    p = t.players().select(
        "player_id", F.when(k % 4 > 0, (F.col("games") * 7 % 100).cast("double")).alias("recent"), ((F.col("games") % 9 + 1) / 10).alias("mins_share"), ((F.col("yellow") % 8 + 1) / 10).alias("p_play"),
        F.round(F.col("xg") * 9.9731, 4).alias("xpts"), F.when(k % 5 == 0, "starter").alias("lineup_status"), F.lit("given").alias("role"),
    )
    out = tournament.gate_by_recent_minutes(p, "recent")
    return out.select("player_id", F.round("mins_share", 3).alias("mins_share"), F.round("p_play", 2).alias("p_play"), F.round("xpts", 2).alias("xpts"), "role")


SQUAD_SQL = f"""{PLAYERS_SQL}, pool AS (SELECT *, row_number() OVER (ORDER BY xpts DESC, id) AS k FROM
  (SELECT player_id AS id, pos, price, round(xg * 5 + xa * 3, 6) AS xpts FROM players) WHERE xpts > 0 AND price > 0),
mine AS (SELECT DISTINCT l_suppkey AS manager_id, l_partkey AS id FROM lineitem),
slots AS (SELECT manager_id, m.id, pos, price, xpts, row_number() OVER (PARTITION BY manager_id ORDER BY m.id) - 1 AS n FROM mine m JOIN pool p ON p.id = m.id QUALIFY n < 6),
own AS (SELECT manager_id, list(id) AS owned, sum(price) AS worth, count(*) AS size FROM slots GROUP BY 1),
shapes AS (SELECT * FROM (VALUES {', '.join(f'({i}, {d}, {m}, {f})' for i, (d, m, f) in enumerate(transfers.FORMATIONS))}) v(formation, d, m, f)),
kept AS (SELECT manager_id, x AS keep_set, sum(xpts) AS pts, sum(price) AS stays, count(*) FILTER (pos = 'G') AS kg, count(*) FILTER (pos = 'D') AS kd, count(*) FILTER (pos = 'M') AS km, count(*) FILTER (pos = 'F') AS kf
  FROM own JOIN slots USING (manager_id), generate_series(0, 63) s(x) WHERE bit_count(CAST(x AS BIGINT)) = 3 AND x < pow(2, size) AND (x >> CAST(n AS BIGINT)) & 1 = 1 GROUP BY ALL),
walk AS (SELECT manager_id, keep_set, formation, owned, CAST(0 AS BIGINT) AS k, CAST(120.0 + worth - stays AS DOUBLE) AS money, CAST(pts AS DOUBLE) AS points, 1 - kg AS g, d - kd AS d, m - km AS m, f - kf AS f, CAST([] AS BIGINT[]) AS bought
    FROM kept JOIN own USING (manager_id), shapes WHERE kg <= 1 AND kd <= d AND km <= m AND kf <= f
  UNION ALL SELECT manager_id, keep_set, formation, owned, k + 1, CASE WHEN buy THEN money - price ELSE money END, CASE WHEN buy THEN points + xpts ELSE points END,
    g - CAST(buy AND pos = 'G' AS INTEGER), d - CAST(buy AND pos = 'D' AS INTEGER), m - CAST(buy AND pos = 'M' AS INTEGER), f - CAST(buy AND pos = 'F' AS INTEGER), CASE WHEN buy THEN list_append(bought, id) ELSE bought END
  FROM (SELECT w.*, p.id, p.price, p.xpts, p.pos, p.price <= w.money AND NOT list_contains(owned, p.id) AND CASE p.pos WHEN 'G' THEN g WHEN 'D' THEN d WHEN 'M' THEN m ELSE f END > 0 AS buy FROM walk w JOIN pool p ON p.k = w.k + 1 WHERE g + d + m + f > 0)),
best AS (SELECT * FROM walk WHERE g + d + m + f = 0 QUALIFY row_number() OVER (PARTITION BY manager_id ORDER BY points DESC, formation, keep_set) = 1)"""


def keep_set_best(t):
    """Each supplier's six first parts as a squad of which three stay, and its best plan."""
    pool = durable(t.players().select(F.col("player_id").alias("id"), F.col("pos").alias("position"), "price", F.round(F.col("xg") * 5 + F.col("xa") * 3, 6).alias("xpts")).where((F.col("xpts") > 0) & (F.col("price") > 0)))
    mine = t.lineitem.select(F.col("l_suppkey").alias("manager_id"), F.col("l_partkey").alias("id")).distinct().join(pool, "id")
    slot = F.struct("id", F.col("position").alias("pos"), "xpts", "price", F.lit(False).alias("must_sell"))
    first = top_n(mine, ["manager_id"], [F.col("id")], 6)
    squads = durable(first.groupBy("manager_id").agg(F.array_sort(F.collect_list(slot)).alias("slots")).withColumn("bank", F.lit(120.0)))
    named = squads.where(F.col("manager_id").isNotNull()).withColumn("owned", F.col("slots.id"))
    plans = transfers.keep_plans(named, keep=3, carry=("owned",))
    return squads, durable(transfers.best_transfers(plans, pool, ["manager_id", "formation", "keep_set"]))


@query("keep_set_plans", "K05, J03", f"""WITH RECURSIVE {SQUAD_SQL}
SELECT manager_id, formation, CAST(keep_set AS BIGINT) AS keep_set, {rnd('points')} AS total, {rnd('money', 2)} AS money_left, array_to_string(bought, ',') AS bought FROM best""")
def _(t):
    _squads, best = keep_set_best(t)
    best = best.where(F.col("total").isNotNull())
    ids = F.array_join(F.transform("chosen", lambda c: c["id"].cast("string")), ",")
    return best.select("manager_id", "formation", F.col("keep_set").cast("long").alias("keep_set"), F.round("total", 4).alias("total"), F.round("money_left", 2).alias("money_left"), ids.alias("bought"))


@query("transfer_swaps", "C23, K05", f"""WITH RECURSIVE {SQUAD_SQL},
o AS (SELECT pos, row_number() OVER () AS x FROM (VALUES ('G'), ('D'), ('M'), ('F')) v(pos)),
sold AS (SELECT manager_id, s.id, s.xpts, row_number() OVER (PARTITION BY manager_id ORDER BY strpos('GDMF', s.pos), n) AS place FROM best JOIN slots s USING (manager_id) WHERE (keep_set >> CAST(n AS BIGINT)) & 1 = 0),
buys AS (SELECT manager_id, unnest(bought) AS id, generate_subscripts(bought, 1) AS i FROM best),
bought AS (SELECT manager_id, b.id, p.xpts, row_number() OVER (PARTITION BY manager_id ORDER BY strpos('GDMF', p.pos), i) AS place FROM buys b JOIN pool p ON p.id = b.id)
SELECT manager_id, place AS position, sold.id AS sold, bought.id AS bought, {rnd('bought.xpts - sold.xpts', 2)} AS over_replaced FROM sold JOIN bought USING (manager_id, place)""")
def _(t):
    """The swaps of every manager's best plan with kept players."""
    squads, best = keep_set_best(t)
    return transfers.planned_swaps(squads, best).select("manager_id", "position", "sold", "bought", "over_replaced")


@query("rating_audit", "L05, K02, K03", f"""WITH {RIDGE_SQL}, c AS (SELECT l_orderkey, l_partkey, CAST(l_orderkey % 3 - 1 AS DOUBLE) AS delta FROM lineitem WHERE l_linenumber = 1),
j AS (SELECT l_orderkey, l_partkey, l_linenumber, (icpt + b1 / s1 * l_quantity + b2 / s2 * l_discount) / 10000 AS p, (icpt + b1 / s1 * (l_quantity + delta) + b2 / s2 * l_discount) / 10000 AS q FROM lineitem JOIN c USING (l_orderkey, l_partkey) JOIN f ON g = l_returnflag)
SELECT l_orderkey AS event_id, l_partkey AS player_id, l_linenumber, {rnd('greatest(1.0, least(10.0, p))')} AS predicted, {rnd('greatest(1.0, least(10.0, q)) - greatest(1.0, least(10.0, p))')} AS change FROM j""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("player_id"), F.col("l_returnflag").alias("grp"), "l_linenumber", "l_quantity", "l_discount", (F.col("l_extendedprice") / 10000).alias("rating"))
    fixes = rows.where(F.col("l_linenumber") == 1).select("event_id", "player_id", (F.col("event_id") % 3 - 1).cast("double").alias("delta"))
    _model, out = audit.rating_audit(rows, fixes, ["l_quantity", "l_discount"], "l_quantity")
    return out.select("event_id", "player_id", "l_linenumber", F.round("predicted", 4).alias("predicted"), F.round("change", 4).alias("change"))


@query("roster_pages", "A12, H04", """SELECT 'u' || c_custkey AS url, o AS ordinal, c_custkey * 10 + o AS player_id, c_name AS name, CAST((c_custkey % 9 + 1) * 1000000 + 500000 AS BIGINT) AS market_value FROM customer, (VALUES (1), (2)) v(o)""")
def _(t):
    k = F.col("c_custkey")
    row = '<tr class="odd"><td>%d</td><td><a title="x" href="/n/profil/spieler/%d">%s <b></b></a></td><td class="r">€%d,50M</td></tr>'
    html = F.format_string(f"<table><tr><td>head</td></tr>{row}{row}</table>", F.lit(1), k * 10 + 1, "c_name", k % 9 + 1, F.lit(2), k * 10 + 2, "c_name", k % 9 + 1)
    return feeds.roster_rows(t.customer.select(F.concat(F.lit("u"), k.cast("string")).alias("url"), html.alias("html")))


@query("goal_line_kinds", "H06, B18", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'owngoal' WHEN o_orderkey % 5 IN (1, 2) THEN 'penalty' ELSE 'regular' END AS kind FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "45' en PROPIA puerta").when(k == 1, "12' de Penal").when(k == 2, "80' (ep)").when(k == 3, "gol de cabeza").otherwise("Eigentor nach Elfmeter")
    return t.orders.select("o_orderkey", goal_kind(text).alias("kind"))


@query("national_totals", "L18, E08", f"""WITH e AS (SELECT o_custkey AS player_id, o_orderkey AS event_id, o_orderdate AS ts, o_totalprice AS xg FROM orders WHERE o_orderkey % 20 = o_custkey % 20 OR o_orderkey % 7 + 20 = o_custkey % 20),
r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, event_id) <= 10)
SELECT player_id, count(*) AS games, {rnd('sum(xg)', 2)} AS xg FROM r JOIN customer ON c_custkey = player_id GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    e = t.orders.select(
        F.col("o_custkey").alias("player_id"), k.alias("event_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("tournament"), F.col("o_orderstatus").alias("season"),
        (k % 20).alias("home_id"), (k % 7 + 20).alias("away_id"),
    )
    national = t.customer.select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 20).alias("national_id"))
    stats = t.orders.select(F.col("o_custkey").alias("player_id"), k.alias("event_id"), F.col("o_totalprice").alias("xg"))
    _main, totals = tournament.club_and_country(e, stats, national, recent=10)
    return totals.select("player_id", "games", F.round("xg", 2).alias("xg"))


@query("weighted_round_results", "D30, L10", f"""WITH {FIXTURES_SQL}, s AS (SELECT *, CASE WHEN xg > 0 THEN round(0.8 * xg + 0.2 * gf, 3) ELSE gf END AS eff FROM sides),
w AS (SELECT team, eff, 1 AS weight FROM s WHERE round_num > 4 OR event_id % 10 = 0 UNION ALL SELECT team, eff, CASE round_num WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END FROM s WHERE round_num <= 3 AND event_id % 10 <> 0)
SELECT team, CAST(sum(weight) AS BIGINT) AS n, {rnd('sum(eff * weight) / sum(weight)')} AS goals FROM w GROUP BY 1""")
def _(t):
    """Rounds 1 to 3 enter with multiplicities, unless the history has the match already."""
    s = t.sides().withColumn("eff", strength.effective_goals(F.col("xg"), F.col("gf")))
    history = s.where((F.col("round_num") > 4) | (F.col("event_id") % 10 == 0))
    every = strength.weighted_matches(s.where(F.col("round_num") <= 3), history, {1: 2, 2: 3, 3: 4})
    return every.groupBy("team").agg(F.sum("weight").cast("long").alias("n"), F.round(F.sum(F.col("eff") * F.col("weight")) / F.sum("weight"), 4).alias("goals"))


def exact_round_sql(v: str, digits: int) -> str:
    """Half to even of a value that is stored exactly and whose product with the power of ten is exact."""
    return f"CASE WHEN {v} * {10**digits} - floor({v} * {10**digits}) = 0.5 THEN 2 * round({v} * {10**digits} / 2) ELSE round({v} * {10**digits}) END / {10**digits}"


@query("half_even_rounding", "H22", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {exact_round_sql('(l_quantity / 8)', 2)} AS eighths, {exact_round_sql('(l_quantity / 2)', 0)} AS halves FROM lineitem")
def _(t):
    """Eighths and halves are stored exactly, so their ties are real ones and go to the even side."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_to(F.col("l_quantity") / 8, 2).alias("eighths"), round_to(F.col("l_quantity") / 2, 0).alias("halves"))
