"""Group summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import pitch, scalars as sc
from touchline.operators import aggregates as ag
from touchline.operators.ordered import arg_max, positions
from touchline.workload.registry import query
from touchline.workload.tables import FIXTURES_SQL, PLAYERS_SQL, rnd


@query("entity_summary", "D01, D16", f"""SELECT l_suppkey, count(*) AS n, {rnd('sum(l_extendedprice)', 2)} AS total, {rnd('avg(l_quantity)')} AS mean, max(l_extendedprice) AS top,
    {rnd("count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*)", 1)} AS pct_returned FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_quantity"), 4).alias("mean"),
        F.max("l_extendedprice").alias("top"), ag.share(F.col("l_returnflag") == "R").alias("pct_returned"),
    )


@query("team_totals", "D04, D05, H15", f"""WITH {PLAYERS_SQL}, k AS (SELECT team, arg_max(yellow, (minutes, -player_id)) AS gc, arg_max(assists, (minutes, -player_id)) AS vi, arg_max(games, (minutes, -player_id)) AS games,
   arg_max(player_id, (minutes, -player_id)) AS keeper FROM players WHERE pos = 'G' GROUP BY 1),
s AS (SELECT team, sum(xg) AS xg, sum(goals) AS goals FROM players GROUP BY 1),
d AS (SELECT team, keeper, greatest(0.0, least(100.0, 100 - (gc / games - 0.4) * 52)) * 0.65 + least(100.0, vi / games * 130) * 0.35 AS def, least(100.0, xg / games * 42) * 0.65 + least(100.0, goals / games * 33) * 0.35 AS att FROM s JOIN k USING (team))
SELECT team, keeper, {rnd('def')} AS def_score, {rnd('att')} AS att_score, CASE WHEN def >= 72 THEN 5 WHEN def >= 56 THEN 4 WHEN def >= 38 THEN 3 WHEN def >= 20 THEN 2 ELSE 1 END AS fdr FROM d""")
def _(t):
    p = t.players()
    keeper = ag.main_row(p.where(F.col("pos") == "G"), ["team"], "minutes", "player_id", ["player_id", "yellow", "assists", "games"])
    total = p.groupBy("team").agg(F.sum("xg").alias("xg"), F.sum("goals").alias("goals"))
    out = total.join(keeper.withColumnRenamed("player_id", "keeper"), "team")
    g = F.col("games")
    d = pitch.defence_score(F.col("yellow") / g, F.col("assists") / g)
    return out.select(
        "team", "keeper", F.round(d, 4).alias("def_score"), F.round(pitch.attack_score(F.col("xg") / g, F.col("goals") / g), 4).alias("att_score"),
        pitch.difficulty(d).alias("fdr"),
    )


@query("arg_max_row", "D05", """SELECT l_suppkey, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1""")
def _(t):
    return arg_max(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice"), -F.col("l_orderkey")], ["l_orderkey", "l_extendedprice"])


@query("ratio_of_sums", "D06", f"""WITH {PLAYERS_SQL} SELECT pos, {rnd('sum(xg) / greatest(sum(minutes), 1) * 90')} AS xg_90, {rnd('sum(xa) / greatest(sum(minutes), 1) * 90')} AS xa_90 FROM players WHERE minutes >= 90 GROUP BY 1""")
def _(t):
    p = t.players().where(F.col("minutes") >= 90)
    return p.groupBy("pos").agg(
        F.round(ag.ratio_per90(F.col("xg"), F.col("minutes")), 4).alias("xg_90"), F.round(ag.ratio_per90(F.col("xa"), F.col("minutes")), 4).alias("xa_90")
    )


@query("weighted_means", "D07, D08", f"""SELECT l_suppkey, {rnd('sum(l_extendedprice * l_quantity) / sum(l_quantity)')} AS mean_price,
    {rnd('greatest(0.60, least(0.92, 0.60 + (sum(l_quantity * l_quantity ** 1.5) / sum(l_quantity ** 1.5) - 12) / (75 - 12) * (0.92 - 0.60)))', 3)} AS quality FROM lineitem GROUP BY 1""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(ag.weighted_mean(F.col("l_extendedprice"), q), 4).alias("mean_price"), ag.schedule_quality(q).alias("quality")
    )


@query("positional_decay", "D09", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, {rnd('sum(o_totalprice * 0.82 ** i) / sum(0.82 ** i)', 2)} AS form, count(*) AS n FROM r WHERE i < 20 AND o_orderstatus <> 'P' GROUP BY 1""")
def _(t):
    out = ag.positional_decay(
        t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], {"form": F.col("o_totalprice")}, F.col("o_orderstatus") != "P", 0.82
    )
    return out.withColumn("form", F.round("form", 2))


@query("time_decay", "D10", f"""SELECT o_custkey, {rnd("sum(o_totalprice * w) / sum(w)", 2)} AS level, {rnd('sum(w)')} AS weight FROM (SELECT *,
    exp(-0.693 * date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') / 365.0) AS w FROM orders) GROUP BY 1""")
def _(t):
    w = sc.decay(F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate")), 365.0)
    o = t.orders.withColumn("w", w)
    return o.groupBy("o_custkey").agg(F.round(ag.weighted_mean(F.col("o_totalprice"), F.col("w")), 2).alias("level"), F.round(F.sum("w"), 4).alias("weight"))


@query("conditional_shares", "D15, D23, B16", f"""SELECT l_suppkey, count(*) FILTER (l_quantity > 40) AS n_high, {rnd('avg(CASE WHEN l_discount < 0.02 THEN 1.0 ELSE 0.0 END)')} AS pct_low,
    {rnd('avg(CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0.0 END)')} AS pct_high FROM lineitem GROUP BY 1 HAVING avg(l_quantity) >= 20 AND count(*) > 2""")
def _(t):
    d = F.col("l_discount")
    part = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    g = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_quantity") > 40).alias("n_high"), part(d < 0.02).alias("pct_low"), part(d > 0.08).alias("pct_high"), F.avg("l_quantity").alias("q"), F.count("*").alias("n")
    )
    return g.where((F.col("q") >= 20) & (F.col("n") > 2)).drop("q", "n")


@query("nested_mode", "D17", """WITH c AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority, o_orderstatus) = 1),
y AS (SELECT o.o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders o JOIN b ON o.o_custkey = b.o_custkey AND o.o_orderpriority = b.o_orderpriority AND o.o_orderstatus = b.o_orderstatus GROUP BY ALL)
SELECT b.o_custkey, o_orderpriority, o_orderstatus, b.n AS n_outer, CAST(y AS INTEGER) AS y, y2.n AS n_inner FROM b JOIN (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, y) = 1) y2 ON y2.o_custkey = b.o_custkey""")
def _(t):
    return ag.nested_mode(t.orders.withColumn("y", F.year("o_orderdate")), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], "y")


@query("zone_shares", "D19, H13", f"""SELECT l_suppkey, count(*) AS shots, {rnd('count(*) FILTER (z = 0) / count(*)', 3)} AS left_share, {rnd('count(*) FILTER (z = 1) / count(*)', 3)} AS center_share,
    {rnd('count(*) FILTER (z = 2) / count(*)', 3)} AS right_share FROM (SELECT l_suppkey, CASE WHEN l_quantity * 2 < 35 THEN 0 WHEN l_quantity * 2 > 65 THEN 2 ELSE 1 END AS z FROM lineitem) GROUP BY 1""")
def _(t):
    return ag.zone_shares(t.lineitem.withColumn("z", pitch.zone(F.col("l_quantity") * 2)), ["l_suppkey"], "z")


@query("zone_pivot", "D19, A07", """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def _(t):
    out = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
    return out.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("relative_deviation", "D20", f"""WITH s AS (SELECT l_suppkey, avg(l_discount) AS box, avg(l_tax) AS wide, avg(l_quantity) AS air FROM lineitem GROUP BY 1),
d AS (SELECT l_suppkey, (box - avg(box) OVER ()) / greatest(avg(box) OVER (), 0.01) AS b, (wide - avg(wide) OVER ()) / greatest(avg(wide) OVER (), 0.01) AS w, (air - avg(air) OVER ()) / greatest(avg(air) OVER (), 0.01) AS a FROM s)
SELECT l_suppkey, {rnd('greatest(-1.0, least(1.0, b))')} AS box_vuln, {rnd('greatest(-1.0, least(1.0, w))')} AS wide_vuln, {rnd('greatest(-1.0, least(1.0, a))')} AS air_vuln,
  CASE WHEN greatest(a, b, w) <= 0.05 THEN NULL WHEN b >= w AND b >= a THEN 'central' WHEN w >= a THEN 'wide' ELSE 'aerial' END AS label FROM d""")
def _(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("box"), F.avg("l_tax").alias("wide"), F.avg("l_quantity").alias("air"))
    for c in ("box", "wide", "air"):
        s = ag.relative_deviation(s, c, f"{c}_d")
    parts = {"central": F.col("box_d"), "wide": F.col("wide_d"), "aerial": F.col("air_d")}
    return s.select(
        "l_suppkey", *[F.round(sc.clamp(F.col(f"{c}_d"), -1.0, 1.0), 4).alias(f"{c}_vuln") for c in ("box", "wide", "air")], ag.largest_label(parts).alias("label")
    )


@query("shrinkage", "D21", f"""WITH {PLAYERS_SQL}, pr AS (SELECT pos, sum(xg) / greatest(sum(minutes), 1) * 90 AS prior FROM players WHERE minutes >= 200 GROUP BY 1)
SELECT player_id, {rnd('games / (games + 8.0) * (xg / minutes * 90) + (1 - games / (games + 8.0)) * prior')} AS xg_reg FROM players JOIN pr USING (pos)""")
def _(t):
    p = t.players().withColumn("rate", sc.per90(F.col("xg"), F.col("minutes")))
    prior = p.where(F.col("minutes") >= 200).groupBy("pos").agg(ag.ratio_per90(F.col("xg"), F.col("minutes")).alias("prior"))
    return ag.shrink_to_group(p, ["pos"], "rate", "games", 8.0, "xg_reg", prior, "prior").select("player_id", F.round("xg_reg", 4).alias("xg_reg"))


@query("consistency_score", "D22", f"""WITH s AS (SELECT user_id, count(*) AS n, avg(value / 100) AS m, stddev_pop(value / 100) AS s FROM events WHERE value >= 20 GROUP BY 1)
SELECT user_id, n, CASE WHEN n < 2 THEN NULL WHEN m < 0.02 THEN 50.0 ELSE greatest(0.0, least(100.0, round(100 - s / m * 50))) END AS consistency FROM s""")
def _(t):
    return ag.consistency_by(t.events, ["user_id"], F.col("value") / 100, F.col("value") >= 20)


@query("grouping_sets", "D24", f"""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, count(*) AS n, {rnd('avg(l_extendedprice)', 2)} AS mean,
    {rnd('stddev_pop(l_quantity)')} AS spread FROM lineitem GROUP BY ROLLUP (l_returnflag) HAVING count(*) >= 20""")
def _(t):
    return ag.all_and_each(t.lineitem, "l_returnflag", [F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.round(F.stddev_pop("l_quantity"), 4).alias("spread")])


@query("complete_quotes", "D25", f"""WITH q AS (SELECT o_custkey, o_orderstatus, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS home, avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS draw,
   avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS away FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS n_books, {rnd('avg(home)', 6)} AS home, {rnd('avg(draw)', 6)} AS draw, {rnd('avg(away)', 6)} AS away FROM q WHERE home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL GROUP BY 1""")
def _(t):
    p, price = F.col("o_orderpriority"), F.col("o_totalprice")
    q = t.orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.avg(F.when(p == "1-URGENT", price)).alias("home"), F.avg(F.when(p == "2-HIGH", price)).alias("draw"), F.avg(F.when(p == "3-MEDIUM", price)).alias("away")
    )
    out = ag.complete_quotes(q, ["o_custkey"], ["home", "draw", "away"])
    return out.select("o_custkey", "n_books", *[F.round(c, 6).alias(c) for c in ("home", "draw", "away")])


@query("result_rates", "D26, D15", f"""WITH {FIXTURES_SQL} SELECT team, count(*) AS n, {rnd('avg(CASE WHEN ga = 0 THEN 1.0 ELSE 0 END)')} AS clean, {rnd('avg(CASE WHEN gf > ga THEN 1.0 ELSE 0 END)')} AS wins, {rnd('avg(gf)')} AS gf_pg, {rnd('avg(ga)')} AS gc_pg
    FROM sides GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    out = t.sides().groupBy("team").agg(
        F.count("*").alias("n"), rate(F.col("ga") == 0).alias("clean"), rate(F.col("gf") > F.col("ga")).alias("wins"),
        F.round(F.avg("gf"), 4).alias("gf_pg"), F.round(F.avg("ga"), 4).alias("gc_pg"),
    )
    return out.where(F.col("n") >= 5)


@query("period_split_comebacks", "D27", f"""WITH {FIXTURES_SQL}, h AS (SELECT team, gf, ga, gf // 2 AS hf, CASE WHEN event_id % 2 = 0 THEN ga ELSE ga // 2 END AS ha FROM sides)
SELECT team, {rnd('CASE WHEN sum(gf) > 0 THEN sum(hf) / sum(gf) ELSE 0.5 END', 3)} AS ratio_1h, count(*) FILTER (hf < ha) AS trailing_ht_n,
  {rnd('CASE WHEN count(*) FILTER (hf < ha) >= 3 THEN count(*) FILTER (hf < ha AND gf >= ga) / count(*) FILTER (hf < ha) ELSE 0.33 END')} AS resilience FROM h GROUP BY 1""")
def _(t):
    from touchline.plans.strength import period_patterns

    half = F.floor(F.col("ga") / 2)
    h = t.sides().withColumns({"ht_gf": F.floor(F.col("gf") / 2), "ht_ga": F.when(F.col("event_id") % 2 == 0, F.col("ga")).otherwise(half)})
    h = h.withColumns({"gf_1h": F.col("ht_gf"), "gf_2h": F.col("gf") - F.col("ht_gf")})
    return period_patterns(h).withColumn("resilience", F.round("resilience", 4))


@query("bucket_rates", "D28, B10", f"""SELECT CAST(b AS INTEGER) AS bucket, count(*) AS n, {rnd('avg(y)')} AS rate FROM (SELECT CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 50 AND value < 150 THEN 2
    WHEN value >= 150 AND value < 300 THEN 3 WHEN value >= 300 AND value < 600 THEN 4 END AS b, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y FROM events) WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) > 5""")
def _(t):
    from touchline.operators.series import bucket_rates

    e = t.events.withColumn("y", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))
    return bucket_rates(e, "value", "y", [0, 10, 50, 150, 300, 600]).withColumn("rate", F.round("rate", 4))


@query("occurrence_lists", "D29", """SELECT l_suppkey, count(*) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    from touchline.plans.audit import scorer_totals

    out = scorer_totals(t.lineitem.where(F.col("l_returnflag") == "R"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return out.select("l_suppkey", "total", "position", "l_orderkey", "l_linenumber")


@query("bag_multiplicity", "D30", f"""SELECT l_suppkey, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS copies, {rnd('sum(l_quantity * l_linenumber) / sum(l_linenumber)')} AS mean FROM lineitem GROUP BY 1""")
def _(t):
    out = ag.bag_weights(t.lineitem.select("l_suppkey", "l_linenumber", "l_quantity"), "l_linenumber")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("copies"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("normalised_team_form", "D31", f"""WITH {PLAYERS_SQL}, f AS (SELECT team, sum(xg / minutes * 90 * CASE pos WHEN 'D' THEN greatest(0.10, least(0.92, (minutes / games * 2 - 10) / 70)) WHEN 'M' THEN greatest(0.05, least(0.90, (minutes / games * 2 - 20) / 65))
   ELSE greatest(0.05, least(0.88, (minutes / games * 2 - 25) / 60)) END) AS s FROM players WHERE pos <> 'G' GROUP BY 1)
SELECT team, {rnd('s / (SELECT avg(s) FROM f WHERE s > 0)')} AS form FROM f""")
def _(t):
    from touchline.plans.strength import player_form

    p = t.players().withColumn("games", F.col("games") / 2)
    return player_form(p)


@query("group_maximum", "D32", """WITH c AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, c_custkey, n, max(n) OVER (PARTITION BY c_nationkey) AS group_max FROM c""")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = t.customer.select("c_custkey", "c_nationkey").join(n, "c_custkey", "left").fillna(0, ["n"])
    return ag.group_against_total(c, "c_nationkey", "n")


@query("distinct_first", "D34", """SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_partkey, l_suppkey, l_extendedprice)) AS l_partkey, arg_min(l_suppkey, (l_partkey, l_suppkey, l_extendedprice)) AS l_suppkey FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = ag.first_seen(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("distinct_most_complete", "D34", """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderpriority < '4' THEN o_orderpriority END AS b FROM orders)
SELECT o_custkey, o_orderkey, a, b FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, o_orderkey) = 1""")
def _(t):
    r = t.orders.select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderpriority") < "4", F.col("o_orderpriority")).alias("b")
    )
    return ag.most_complete(r, ["o_custkey"], ["o_orderkey"])


@query("merge_partial_records", "D35", """SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS xg, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS pos FROM orders GROUP BY 1""")
def _(t):
    done = F.col("o_orderstatus") == "F"
    r = t.orders.select("o_custkey", "o_orderkey", F.when(done, F.col("o_totalprice")).alias("xg"), F.when(~done, F.col("o_orderpriority")).alias("pos"))
    return ag.merge_partial(r, ["o_custkey"], "o_orderkey", ["xg", "pos"])


@query("extra_time_xg", "D36", f"""WITH s AS (SELECT l_orderkey, l_linenumber % 2 = 0 AS is_home, sum(l_discount) AS xg FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, max(l_quantity * 3) AS mx FROM lineitem GROUP BY 1)
SELECT l_orderkey, is_home, {rnd('xg * CASE WHEN mx > 90 THEN 90 / mx ELSE 1.0 END', 6)} AS xg90 FROM s JOIN m USING (l_orderkey)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("is_home"), (F.col("l_quantity") * 3).alias("mins"), F.col("l_discount").alias("xg"))
    return ag.extra_time_scale(rows, ["l_orderkey"], "is_home", "mins", "xg").withColumn("xg90", F.round("xg90", 6))


@query("truthy_mean", "D39", f"""SELECT l_suppkey, {rnd('coalesce(avg(nullif(l_discount, 0)), 0.82)')} AS level FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(ag.truthy_mean(F.col("l_discount"), 0.82), 4).alias("level"))


@query("collect_by_round", "D40", f"""WITH {FIXTURES_SQL} SELECT grp, CAST(played AS VARCHAR) AS played, row_number() OVER (PARTITION BY grp, played ORDER BY event_id) AS position, event_id FROM fixtures""")
def _(t):
    """Fixtures of each group and match day in order, as numbered rows."""
    f = t.fixtures().select("grp", F.col("played").cast("string").alias("played"), "event_id")
    return positions(f, ["grp", "played"], [F.col("event_id")])


@query("recent_rating", "D41", f"""SELECT user_id, {rnd("avg(value) FILTER (value >= 20 AND event_type <> 'error')", 6)} AS rating FROM events GROUP BY 1""")
def _(t):
    rated = F.when((F.col("value") >= 20) & (F.col("event_type") != "error"), F.col("value"))
    return t.events.groupBy("user_id").agg(F.round(F.avg(rated), 6).alias("rating"))


@query("coverage_flags", "B15, B21, B17", """SELECT o_orderkey, count(l_orderkey) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS n_rated,
    CASE WHEN count(l_orderkey) = 0 THEN 'no_lineup' WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'no_ratings' ELSE 'ok' END AS reason FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(t):
    from touchline.plans.audit import coverage

    matches = t.orders.where(F.col("o_orderstatus") != "P").select("o_orderkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", 1.0).alias("rating"))
    return coverage(matches, rows, "o_orderkey", "rating")
