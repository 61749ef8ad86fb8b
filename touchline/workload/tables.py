"""The driver's tables and the football-shaped views Spark derives from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.joins import match_sides
from touchline.operators.ordered import top_n
from touchline.session import durable


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def team_lines(self) -> DataFrame:
        """First two lines of each order with the nation and region of their supplier."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]
        lines = top_n(self.lineitem.select("l_orderkey", *order), ["l_orderkey"], [F.col(c) for c in order], 2, "rn")
        supplier = self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        nation = self.nation.select("n_nationkey", F.col("n_name").alias("team"), F.col("n_regionkey").alias("r_regionkey"))
        return lines.join(supplier, "l_suppkey").join(nation, "n_nationkey").join(self.region, "r_regionkey")

    def fixtures(self) -> DataFrame:
        """Orders with two lines of different nations as matches."""
        lines = self.team_lines()
        side = lambda rn, c: F.max(F.when(F.col("rn") == rn, F.col(c)))
        both = lines.groupBy(F.col("l_orderkey").alias("event_id")).agg(
            side(1, "team").alias("home"), side(2, "team").alias("away"), side(1, "r_name").alias("grp"),
            (side(1, "l_quantity").cast("int") % 5).alias("score_home"), (side(2, "l_quantity").cast("int") % 5).alias("score_away"),
            F.max(F.when(F.col("rn") == 1, F.col("l_quantity") * F.col("l_discount"))).alias("xg_home"),
            F.max(F.when(F.col("rn") == 2, F.col("l_quantity") * F.col("l_discount"))).alias("xg_away"),
        ).where(F.col("home") != F.col("away"))
        orders = self.orders.select(
            F.col("o_orderkey").alias("event_id"), F.month("o_orderdate").alias("round_num"), F.to_date("o_orderdate").alias("played"),
            F.col("o_custkey").alias("referee"),
        )
        return both.join(orders, "event_id")

    def sides(self) -> DataFrame:
        return match_sides(self.fixtures(), {"xg": ("xg_home", "xg_away"), "opp_xg": ("xg_away", "xg_home")}, ["event_id", "round_num", "played"])

    def transfers(self) -> DataFrame:
        """Orders as transfers of a customer: date, fee, loan flag, clubs named by priority and status."""
        return self.orders.select(
            F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("transfer_id"), F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("fee"), (F.col("o_orderstatus") == "P").alias("is_loan"),
            F.col("o_orderpriority").alias("to_club"),
        )

    def daily(self) -> DataFrame:
        """Daily mean value per user as the raw points of a series."""
        return self.events.groupBy(F.col("user_id"), F.dayofmonth("ts").alias("minute")).agg(F.avg("value").alias("value"))

    def players(self) -> DataFrame:
        """Parts as players with season totals from their order lines."""
        line = self.lineitem.groupBy(F.col("l_partkey").alias("player_id")).agg(
            F.sum("l_quantity").alias("minutes"), F.count("*").alias("games"),
            F.count_if(F.col("l_returnflag") == "R").alias("goals"), F.count_if(F.col("l_returnflag") == "A").alias("assists"),
            F.sum(F.col("l_discount")).alias("xg"), F.sum(F.col("l_tax") / 2).alias("xa"),
            F.sum("l_linenumber").alias("shots"), F.count_if(F.col("l_linestatus") == "F").alias("key_passes"),
            F.count_if(F.col("l_tax") > 0.06).alias("yellow"),
        )
        part = self.part.select(
            F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("team"),
            F.element_at(F.array(*[F.lit(p) for p in "GDMF"]), F.col("p_size") % 4 + 1).alias("pos"), (F.col("p_retailprice") / 100).alias("price"),
        )
        return part.join(line, "player_id")

    def stored_players(self) -> DataFrame:
        """The player table written once, for jobs that read it several times."""
        if "_players" not in self.__dict__:
            self._players = durable(self.players())
        return self._players


# The same views as SQL, for the checks.
FIXTURES_SQL = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS rn FROM lineitem),
team_lines AS (SELECT l.*, n_name AS team, r_name FROM lines l JOIN supplier ON l_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE rn <= 2),
fixtures AS (SELECT a.l_orderkey AS event_id, a.team AS home, b.team AS away, a.r_name AS grp,
            CAST(a.l_quantity AS INTEGER) % 5 AS score_home, CAST(b.l_quantity AS INTEGER) % 5 AS score_away,
            a.l_quantity * a.l_discount AS xg_home, b.l_quantity * b.l_discount AS xg_away,
            CAST(month(o_orderdate) AS INTEGER) AS round_num, CAST(o_orderdate AS DATE) AS played, o_custkey AS referee
            FROM team_lines a JOIN team_lines b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2 AND a.team <> b.team
            JOIN orders ON o_orderkey = a.l_orderkey),
sides AS (SELECT event_id, round_num, played, TRUE AS is_home, home AS team, away AS opponent, score_home AS gf, score_away AS ga,
            xg_home AS xg, xg_away AS opp_xg FROM fixtures
          UNION ALL SELECT event_id, round_num, played, FALSE, away, home, score_away, score_home, xg_away, xg_home FROM fixtures)"""

DAILY_SQL = """
daily AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS minute, avg(value) AS value FROM events GROUP BY 1, 2)"""

SERIES_SQL = DAILY_SQL + """,
grid AS (SELECT user_id, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT user_id FROM daily), generate_series(1, 30) g(t)),
series AS (SELECT user_id, t, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS value
           FROM grid LEFT JOIN daily ON grid.user_id = daily.user_id AND grid.t = daily.minute)"""
SERIES_SQL = SERIES_SQL.replace("SELECT user_id, t, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t",
                                "SELECT grid.user_id, t, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY grid.user_id ORDER BY t")

PLAYERS_SQL = """
players AS (SELECT p_partkey AS player_id, p_name AS name, p_brand AS team, substr('GDMF', CAST(p_size % 4 + 1 AS BIGINT), 1) AS pos,
            p_retailprice / 100 AS price, sum(l_quantity) AS minutes, count(*) AS games,
            count(*) FILTER (l_returnflag = 'R') AS goals, count(*) FILTER (l_returnflag = 'A') AS assists,
            sum(l_discount) AS xg, sum(l_tax / 2) AS xa, CAST(sum(l_linenumber) AS BIGINT) AS shots,
            count(*) FILTER (l_linestatus = 'F') AS key_passes, count(*) FILTER (l_tax > 0.06) AS yellow
            FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""


def rnd(expr: str, digits: int = 4) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
