"""Ordered analytics, rankings and top-k reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import history
from touchline.operators.ordered import carry_forward, dense_ranks, percentiles, positions, running_totals, top_n, top_n_overall
from touchline.session import task_count
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, PLAYERS_SQL, rnd


@query("running_totals", "E10, D29", f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, {rnd('sum(l_quantity) OVER w', 2)} AS total FROM lineitem
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def _(t):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return running_totals(rows, ["l_suppkey"], order, {"total": F.col("l_quantity")}).withColumn("total", F.round("total", 2)).drop("l_quantity")


@query("row_positions", "E05", """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events""")
def _(t):
    return positions(t.events.select("event_type", "event_id", "value"), ["event_type"], [F.col("value").desc(), F.col("event_id")]).drop("value")


@query("carry_forward", "E01", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def _(t):
    e = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return carry_forward(e, ["user_id"], ["ts", "event_id"], "v", "last_purchase").select("user_id", "event_id", "last_purchase")


@query("dense_scorer_rank", "E04, L04", """WITH g AS (SELECT l_suppkey, count(*) AS goals FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT s_suppkey AS l_suppkey, CAST(s_nationkey % 3 AS BIGINT) AS delta FROM supplier WHERE s_acctbal > 8000)
SELECT l_suppkey, goals + coalesce(delta, 0) AS corrected, dense_rank() OVER (ORDER BY goals + coalesce(delta, 0) DESC) AS place FROM g LEFT JOIN c USING (l_suppkey)""")
def _(t):
    from touchline.plans.audit import corrected_scorers

    goals = t.lineitem.where(F.col("l_returnflag") == "R").groupBy(F.col("l_suppkey").alias("player_id")).agg(F.count("*").alias("goals"))
    fix = t.supplier.where(F.col("s_acctbal") > 8000).select(
        F.col("s_suppkey").alias("player_id"), F.lit("manual").alias("kind"), (F.col("s_nationkey") % 3).cast("long").alias("delta"), F.col("s_name").alias("note")
    )
    return corrected_scorers(goals, fix).select(F.col("player_id").alias("l_suppkey"), "corrected", "place")


@query("interpolated_percentiles", "D11, E14", f"""SELECT l_suppkey, {rnd('quantile_cont(l_extendedprice, 0.25)')} AS p25, {rnd('quantile_cont(l_extendedprice, 0.75)')} AS p75, {rnd('quantile_cont(l_extendedprice, 0.9)')} AS p90 FROM lineitem GROUP BY 1""")
def _(t):
    out = percentiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"p25": 0.25, "p75": 0.75, "p90": 0.9})
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("p25", "p75", "p90")])


@query("quantile_bands", "E14", """WITH c AS (SELECT list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders), q AS (SELECT l[CAST(floor(n * 20 / 100) AS BIGINT) + 1] AS a, l[CAST(floor(n * 40 / 100) AS BIGINT) + 1] AS b, l[CAST(floor(n * 60 / 100) AS BIGINT) + 1] AS c, l[CAST(floor(n * 80 / 100) AS BIGINT) + 1] AS d FROM c)
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 WHEN o_totalprice <= c THEN 3 WHEN o_totalprice <= d THEN 4 ELSE 5 END AS band,
  CASE WHEN o_totalprice >= d THEN 1 WHEN o_totalprice >= c THEN 2 WHEN o_totalprice >= b THEN 3 WHEN o_totalprice >= a THEN 4 ELSE 5 END AS inverted FROM orders, q""")
def _(t):
    from touchline.operators.competition import quantile_bands

    o = t.orders.select("o_orderkey", "o_totalprice")
    return quantile_bands(quantile_bands(o, "o_totalprice"), "o_totalprice", "inverted", low_is_hard=False).drop("o_totalprice")


@query("snapshot_gains", "E07", """WITH d AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS round_num, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1, 2),
s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY round_num) AS BIGINT) AS total FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY round_num ORDER BY total DESC, user_id) AS position FROM s WHERE c > 0)
SELECT user_id, count(*) FILTER (position = 1) AS place_1, count(*) FILTER (position = 2) AS place_2, count(*) FILTER (position = 3) AS place_3, CAST(sum(4 - position) AS BIGINT) AS total_points, count(*) AS appearances FROM g WHERE position <= 3 GROUP BY 1""")
def _(t):
    from pyspark.sql import Window

    e = t.events.groupBy("user_id", F.dayofmonth("ts").alias("round_num")).agg(F.count_if(F.col("event_type") == "purchase").alias("c"))
    w = Window.partitionBy("user_id").orderBy("round_num").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    snaps = e.withColumn("total", F.sum("c").over(w))
    return history.podium_totals(history.snapshot_gains(snaps, "user_id", "round_num", "total"), "user_id")


@query("newest_usable_rows", "E08, L18", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS cand FROM orders QUALIFY cand <= 15)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM c WHERE o_orderstatus <> 'P' QUALIFY position <= 5""")
def _(t):
    out = history.newest_usable(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], F.col("o_orderstatus") != "P", 5)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query("bounded_history", "E09, L16", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders), h AS (SELECT * FROM o WHERE year(o_orderdate) < 2000 UNION SELECT * FROM o WHERE year(o_orderdate) >= 1999)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM h QUALIFY position <= 8""")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    y = F.year("o_orderdate")
    out = history.bounded_history(o.where(y < 2000), o.where(y >= 1999), ["o_custkey"], "o_orderkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 8)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query("score_context", "E10", f"""WITH {FIXTURES_SQL}, g AS (SELECT event_id, is_home, gf + 1 - 1 - ga AS lead FROM sides WHERE gf >= 0)
SELECT event_id, is_home, CASE WHEN lead = 0 THEN 'go_ahead' WHEN lead = -1 THEN 'equalizer' WHEN lead > 0 THEN 'extend_lead' ELSE 'pull_one_back' END AS context FROM g""")
def _(t):
    from touchline.operators.series import context_label, goal_context

    s = t.sides()
    home_after = F.when(F.col("is_home"), F.col("gf") + 1).otherwise(F.col("ga"))
    away_after = F.when(F.col("is_home"), F.col("ga")).otherwise(F.col("gf") + 1)
    return s.select("event_id", "is_home", context_label(goal_context(F.col("is_home"), home_after, away_after)).alias("context"))


@query("before_marker_counts", "E11", """WITH m AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS mark FROM conversations GROUP BY 1)
SELECT conv_id, count(*) FILTER ((mark IS NULL OR turn < mark) AND length(text) > 20) AS n_before FROM conversations JOIN m USING (conv_id) GROUP BY 1""")
def _(t):
    return history.before_marker(t.conversations, ["conv_id"], "turn", F.col("role") == "assistant", F.length("text") > 20, "n_before")


@query("split_at_second_marker", "E16, L16", """WITH m AS (SELECT conv_id, list_sort(list(turn) FILTER (role = 'assistant'))[2] AS cut FROM conversations GROUP BY 1)
SELECT conv_id, turn, role, coalesce(turn >= cut, FALSE) AS is_second FROM conversations JOIN m USING (conv_id)""")
def _(t):
    return history.split_at_second(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "assistant")


@query("first_eleven", "E15, L12", """SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 11 THEN 'starter' ELSE 'sub_in' END AS status FROM orders""")
def _(t):
    return history.first_eleven(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "status")


@query("minutes_on_pitch", "E17, L15", """WITH st AS (SELECT l_orderkey, l_partkey, CASE WHEN min(l_linenumber) <= 2 THEN 'starter' WHEN min(l_linenumber) <= 5 THEN 'bench' ELSE 'missing' END AS status FROM lineitem GROUP BY 1, 2),
su AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) + 40 AS minute, l_partkey AS pin, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pout,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem WHERE l_returnflag = 'R'),
fin AS (SELECT o_orderkey AS l_orderkey, greatest(90, 90 + CAST(o_custkey % 8 AS INTEGER)) AS fm FROM orders),
i AS (SELECT l_orderkey, pin AS l_partkey, arg_max(minute, o) AS m_in FROM su GROUP BY 1, 2), x AS (SELECT l_orderkey, pout AS l_partkey, min(minute) AS m_out FROM su WHERE pout IS NOT NULL GROUP BY 1, 2),
a AS (SELECT l_orderkey, l_partkey, status, m_in FROM st FULL JOIN i USING (l_orderkey, l_partkey))
SELECT a.l_orderkey AS match_id, a.l_partkey AS player_id, CAST(CASE WHEN status = 'starter' THEN greatest(1, coalesce(m_out, fm)) WHEN status = 'bench' OR status IS NULL THEN greatest(1, fm - m_in) ELSE 0 END AS INTEGER) AS mins,
  CASE WHEN status = 'starter' THEN 'starter' WHEN status = 'missing' THEN 'missing' ELSE 'sub_in' END AS status
FROM a LEFT JOIN x USING (l_orderkey, l_partkey) JOIN fin USING (l_orderkey) WHERE status IN ('starter', 'missing') OR m_in IS NOT NULL""")
def _(t):
    from pyspark.sql import Window

    rank = F.min("l_linenumber")
    status = F.when(rank <= 2, "starter").when(rank <= 5, "bench").otherwise("missing")
    key = F.col("l_orderkey").alias("match_id")
    tasks = task_count(t.lineitem)
    lines = t.lineitem.repartition(tasks, "l_orderkey")
    lineup = lines.groupBy(key, F.col("l_partkey").alias("player_id")).agg(status.alias("status"))
    lineup = lineup.withColumns({"is_home": F.lit(True), "name": F.lit("p"), "reason": F.lit(None).cast("string")})
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # the lines of one order
    subs = lines.where(F.col("l_returnflag") == "R").select(
        key, (F.col("l_quantity").cast("int") + 40).alias("minute"), F.lit(0).alias("added"), F.col("l_partkey").alias("player_in"),
        F.lead("l_partkey").over(w).alias("player_out"), F.row_number().over(w).alias("ordinal"), F.lit(True).alias("is_home"),
    )
    periods = t.orders.select(F.col("o_orderkey").alias("match_id"), F.lit(90).alias("minute"), (F.col("o_custkey") % 8).cast("int").alias("added"))
    known = t.orders.select(F.col("o_orderkey").alias("match_id"))
    out = history.player_minutes(lineup, subs, periods, tasks).join(known, "match_id", "left_semi")
    return out.select("match_id", "player_id", "mins", "status")


@query("starter_flags", "E20, L13", f"""WITH m AS (SELECT o_custkey, CAST(quarter(o_orderdate) AS INTEGER) AS r, max(CAST(floor(o_totalprice) AS BIGINT) % 95) AS mins FROM orders GROUP BY 1, 2), u AS (SELECT * FROM m WHERE mins > 0)
SELECT o_custkey, coalesce(max(mins) FILTER (r = 1), 0) AS mins_1, coalesce(max(mins) FILTER (r = 2), 0) AS mins_2, coalesce(max(mins) FILTER (r = 3), 0) AS mins_3, coalesce(bool_or(mins >= 60) FILTER (r = 1), FALSE) AS started_1,
  coalesce(bool_or(mins >= 60) FILTER (r = 2), FALSE) AS started_2, coalesce(bool_or(mins >= 60) FILTER (r = 3), FALSE) AS started_3,
  {rnd('sum(mins * CASE r WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 ELSE 0.5 END) FILTER (mins >= 60) / sum(CASE r WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 ELSE 0.5 END) FILTER (mins >= 60)')} AS start_minutes FROM u WHERE r <= 3 GROUP BY 1""")
def _(t):
    m = t.orders.groupBy("o_custkey", F.quarter("o_orderdate").alias("round_num")).agg(F.max(F.floor("o_totalprice") % 95).alias("mins"))
    return history.starter_flags(m, "o_custkey", {1: 1.5, 2: 2.0, 3: 0.5}).withColumn("start_minutes", F.round("start_minutes", 4))


@query("top_by_metric", "F02", f"""WITH {PLAYERS_SQL}, m AS (SELECT player_id, unnest(['xg', 'xa', 'goals']) AS metric, unnest([xg, xa, CAST(goals AS DOUBLE)]) AS value FROM players)
SELECT metric, player_id, {rnd('value')} AS value, row_number() OVER (PARTITION BY metric ORDER BY round(value, 6) DESC, player_id) AS rank FROM m WHERE value > 0 QUALIFY rank <= 10""")
def _(t):
    p = t.players().withColumn("goals", F.col("goals").cast("double"))
    long = p.unpivot(["player_id"], ["xg", "xa", "goals"], "metric", "value").where(F.col("value") > 0)
    out = top_n(long, ["metric"], [F.round("value", 6).desc(), F.col("player_id")], 10)
    return out.select("metric", "player_id", F.round("value", 4).alias("value"), F.col("rank").cast("long").alias("rank"))


@query("top_captains", "F01, F03", f"""WITH {PLAYERS_SQL} SELECT player_id, {rnd('xg * 5 + xa * 3')} AS cap_score FROM players WHERE price > 0 ORDER BY round(xg * 5 + xa * 3, 6) DESC, player_id LIMIT 25""")
def _(t):
    score = F.col("xg") * 5 + F.col("xa") * 3
    best = top_n_overall(t.players().where(F.col("price") > 0).withColumn("s", score), [F.round("s", 6).desc(), F.col("player_id")], 25)
    return best.select("player_id", F.round("s", 4).alias("cap_score"))


@query("best_per_position", "F04", f"""WITH {PLAYERS_SQL}, d AS (SELECT name, pos, max(round(xg, 6)) AS xg FROM players GROUP BY 1, 2) SELECT pos, name, {rnd('xg')} AS xg FROM d QUALIFY row_number() OVER (PARTITION BY pos ORDER BY xg DESC, name) = 1""")
def _(t):
    by_name = t.players().groupBy("name", "pos").agg(F.max(F.round("xg", 6)).alias("xg"))
    return top_n(by_name, ["pos"], [F.col("xg").desc(), F.col("name")], 1).select("pos", "name", F.round("xg", 4).alias("xg"))


@query("dynamic_sort", "F06, F07", """SELECT c_custkey, abs(c_acctbal) AS magnitude, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal END AS chosen FROM customer ORDER BY chosen DESC NULLS LAST, abs(c_acctbal) DESC, c_custkey""")
def _(t):
    column = "chosen"
    c = t.customer.select("c_custkey", F.abs("c_acctbal").alias("magnitude"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal")).alias("chosen"))
    return c.orderBy(F.col(column).desc_nulls_last(), F.col("magnitude").desc(), "c_custkey")
