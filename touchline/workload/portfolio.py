"""Agency portfolio on customers (players), orders (transfers) and nations (agencies)."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.text import contains_any
from touchline.operators import history
from touchline.operators.aggregates import nested_top, portfolio_summary
from touchline.operators.ordered import upper_median
from touchline.plans.portfolio import enrich_players
from touchline.workload.registry import query

TODAY = "2001-08-02"
HOME_WORDS = ["urgent", "high"]

TRANSFER_SQL = """
tr AS (SELECT o_custkey AS player_id, o_orderkey AS transfer_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS fee,
       o_orderstatus = 'P' AS is_loan, o_orderpriority AS from_club, o_orderstatus AS to_club FROM orders),
span AS (SELECT player_id, min(date) AS first_date, max(date) AS last_date,
         (round(date_diff('day', min(date), max(date)) / 365.25, 1) + 0.0) AS career_years, max(fee) AS peak_value FROM tr GROUP BY 1),
since AS (SELECT player_id, date AS since_date, method FROM (
           SELECT *, CASE WHEN fee > 100000 AND NOT is_loan THEN 'last_paid_transfer' ELSE 'last_transfer' END AS method,
             row_number() OVER (PARTITION BY player_id ORDER BY CASE WHEN fee > 100000 AND NOT is_loan THEN 0 ELSE 1 END, date DESC, transfer_id) AS rn
           FROM tr WHERE NOT is_loan) WHERE rn = 1),
export AS (SELECT player_id, date AS export_date, to_club AS export_club FROM (
           SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY date, transfer_id) AS rn FROM tr
           WHERE regexp_matches(lower(from_club), 'urgent|high') AND NOT regexp_matches(lower(to_club), 'urgent|high|f')) WHERE rn = 1)"""


def transfers(t):
    """Orders as transfers: priority is the club sold by, status the club bought by."""
    return t.orders.select(
        F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("transfer_id"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("fee"), (F.col("o_orderstatus") == "P").alias("is_loan"),
        F.col("o_orderpriority").alias("from_club"), F.col("o_orderstatus").alias("to_club"),
    )


def exported(df):
    return contains_any(F.col("from_club"), HOME_WORDS) & ~contains_any(F.col("to_club"), [*HOME_WORDS, "f"])


@query("career_span", "D33, H07", f"""WITH {TRANSFER_SQL} SELECT player_id, CAST(first_date AS VARCHAR) AS first_date,
    CAST(last_date AS VARCHAR) AS last_date, career_years, peak_value FROM span""")
def _(t):
    out = history.career_span(transfers(t), ["player_id"], "date", "fee")
    return out.withColumns({"first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")})


@query("latest_move_by_class", "E13", f"WITH {TRANSFER_SQL} SELECT player_id, CAST(since_date AS VARCHAR) AS since_date, method FROM since")
def _(t):
    tr = transfers(t)
    paid = (F.col("fee") > 100000) & ~F.col("is_loan")
    out = history.latest_by_class(
        tr, ["player_id"], [(paid, "last_paid_transfer"), (~F.col("is_loan"), "last_transfer")], "date", "transfer_id", ["date"]
    )
    return out.select("player_id", F.col("date").cast("string").alias("since_date"), "method")


@query("first_move_abroad", "E12, H03", f"WITH {TRANSFER_SQL} SELECT player_id, CAST(export_date AS VARCHAR) AS export_date, export_club FROM export")
def _(t):
    tr = transfers(t)
    out = history.first_where(tr, ["player_id"], exported(tr), ["date", "transfer_id"], ["date", "to_club"])
    return out.select("player_id", F.col("date").cast("string").alias("export_date"), F.col("to_club").alias("export_club"))


def portfolio(t):
    players = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("n_name").alias("agency"),
        F.col("c_mktsegment").alias("club"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("market_value"),
    )
    return enrich_players(players, transfers(t), paid_over=100000, home_words=HOME_WORDS, abroad_words=["f"])


@query("portfolio_summary", "L01, D01, D02, D03, D33, E12, E13, C01", f"""WITH {TRANSFER_SQL},
fees AS (SELECT player_id, sum(fee) AS fees FROM tr GROUP BY 1),
p AS (SELECT c_custkey AS player_id, c_name AS name, n_name AS agency, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS mv,
      fees, since_date, export_date, date_diff('day', first_date, DATE '{TODAY}') / 365.25 AS age
      FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN fees ON fees.player_id = c_custkey
      LEFT JOIN span ON span.player_id = c_custkey LEFT JOIN since ON since.player_id = c_custkey LEFT JOIN export ON export.player_id = c_custkey),
top AS (SELECT agency, string_agg(name, '|' ORDER BY rn) AS top5 FROM (SELECT agency, name,
        row_number() OVER (PARTITION BY agency ORDER BY coalesce(mv, 0) DESC, name) AS rn FROM p) WHERE rn <= 5 GROUP BY 1),
med AS (SELECT agency, (list_sort(list(mv) FILTER (mv IS NOT NULL)))[CAST(count(mv) // 2 + 1 AS BIGINT)] AS median_mv FROM p GROUP BY 1)
SELECT agency, count(*) AS n_players, count(export_date) AS n_exported, round(count(export_date) * 100.0 / count(*), 1) AS pct_exported,
  round(sum(mv), 2) AS total_mv, round(avg(mv)) AS avg_mv, max(mv) AS top_player_mv, round(sum(fees), 2) AS total_fees_generated,
  round(sum(fees) / count(*)) AS avg_fees_per_player, count(fees) AS n_with_fees, round(avg(age), 1) AS avg_age,
  round(count(since_date) * 100.0 / count(*), 1) AS agency_since_coverage, any_value(median_mv) AS median_mv, any_value(top5) AS top5
FROM p JOIN top USING (agency) JOIN med USING (agency) GROUP BY agency""")
def _(t):
    enriched = portfolio(t)
    out = portfolio_summary(
        enriched, "agency", "market_value", "total_fees", F.col("first_export_date").isNotNull(),
        F.datediff(F.lit(TODAY).cast("date"), F.col("first_date")) / 365.25, F.col("since_date"), "name", "club",
    )
    top5 = F.array_join(F.transform("players_top5_mv", lambda s: s["name"]), "|")
    return out.withColumns({"top5": top5, "total_mv": F.round("total_mv", 2), "total_fees_generated": F.round("total_fees_generated", 2)}).drop("players_top5_mv")


@query("upper_median", "D02", """SELECT o_custkey % 1000 AS bucket,
    (list_sort(list(o_totalprice)))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median_price FROM orders GROUP BY 1""")
def _(t):
    return upper_median(t.orders.select((F.col("o_custkey") % 1000).alias("bucket"), "o_totalprice"), ["bucket"], "o_totalprice", "median_price")


@query("nested_top_per_group", "D03", """SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), '|' ORDER BY rn) AS top_orders FROM (
    SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS rn
    FROM lineitem) WHERE rn <= 5 GROUP BY 1""")
def _(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey")]
    out = nested_top(t.lineitem, ["l_suppkey"], order, 5, ["l_orderkey"], "top")
    return out.select("l_suppkey", F.array_join(F.transform("top", lambda s: s["l_orderkey"].cast("string")), "|").alias("top_orders"))
