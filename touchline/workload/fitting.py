"""Regressions, classification, AUC, podium chances and squad plans."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import models
from touchline.operators.podium import podium
from touchline.plans import transfers
from touchline.workload.registry import query
from touchline.workload.tables import PLAYERS_SQL, rnd  # noqa: F401

RIDGE_SQL = """
s AS (SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS g, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
   stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1y, covar_pop(l_discount, l_extendedprice) AS c2y, var_pop(l_extendedprice) AS vy
   FROM lineitem GROUP BY ROLLUP (l_returnflag)),
w AS (SELECT *, ((n + 1) * n * c1y / s1 - n * c12 / (s1 * s2) * n * c2y / s2) / ((n + 1) * (n + 1) - (n * c12 / (s1 * s2)) ** 2) AS b1,
   ((n + 1) * n * c2y / s2 - n * c12 / (s1 * s2) * n * c1y / s1) / ((n + 1) * (n + 1) - (n * c12 / (s1 * s2)) ** 2) AS b2 FROM s),
f AS (SELECT *, my - b1 / s1 * m1 - b2 / s2 * m2 AS icpt, 1 - (n * vy - 2 * (b1 * n * c1y / s1 + b2 * n * c2y / s2) + n * (b1 * b1 + b2 * b2 + 2 * b1 * b2 * c12 / (s1 * s2))) / (n * vy) AS r2 FROM w)"""


def ridge_model(t):
    return models.ridge(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"], "l_extendedprice")


@query("ridge_by_group", "K02, D24", f"""WITH {RIDGE_SQL}, x AS (SELECT *, unnest(['l_quantity', 'l_discount']) AS feature, unnest([b1, b2]) AS cs, unnest([b1 / s1, b2 / s2]) AS cr FROM f)
SELECT g AS l_returnflag, feature, n, {rnd('cs')} AS coef_std, {rnd('cr')} AS coef_raw, {rnd('icpt')} AS intercept, {rnd('r2', 6)} AS r2 FROM x""")
def _(t):
    out = ridge_model(t)
    return out.withColumns({c: F.round(c, 4) for c in ("coef_std", "coef_raw", "intercept")} | {"r2": F.round("r2", 6)})


@query("rescored_corrections", "K03, L05", f"""WITH {RIDGE_SQL}, c AS (SELECT o_orderkey, CAST(o_orderkey % 3 - 1 AS DOUBLE) AS delta FROM orders WHERE o_orderstatus = 'P'),
j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, icpt + b1 / s1 * l_quantity + b2 / s2 * l_discount AS p, icpt + b1 / s1 * (l_quantity + delta) + b2 / s2 * l_discount AS q FROM lineitem JOIN c ON o_orderkey = l_orderkey JOIN f ON g = l_returnflag)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rnd('greatest(1.0, least(60000.0, p))', 2)} AS predicted, {rnd('greatest(1.0, least(60000.0, q)) - greatest(1.0, least(60000.0, p))', 2)} AS change FROM j""")
def _(t):
    fixes = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 - 1).cast("double").alias("delta"))
    out = models.rescore(t.lineitem, fixes, ridge_model(t), "l_returnflag", ["l_quantity", "l_discount"], "l_quantity", ["l_orderkey"], 1.0, 60000.0)
    out = out.where(F.col("l_linenumber").isNotNull())
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("predicted", 2).alias("predicted"), F.round("change", 2).alias("change"))


def labelled(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select(
        "doc_id", "quality", (F.col("n_chars") / 1000).alias("size"), F.log1p("n_chars").alias("log_size"), F.col("toxic").cast("double").alias("toxic")
    )


def newton_sql(steps: int = 10) -> str:
    """Logistic regression of three standardised features with a unit penalty on their weights, by Newton steps from zero."""
    n = 4
    x = ["1.0", "z1", "z2", "z3"]
    sql = """d AS (SELECT doc_id, quality, n_chars / 1000 AS x1, ln(1 + n_chars) AS x2, CAST(toxic AS DOUBLE) AS x3 FROM labels JOIN documents USING (doc_id)),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1, coalesce(nullif(stddev_pop(x2), 0), 1) AS s2, coalesce(nullif(stddev_pop(x3), 0), 1) AS s3 FROM d),
z AS (SELECT doc_id, quality, CAST(quality AS DOUBLE) AS y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3 FROM d, m),
b0 AS (SELECT 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3)"""
    for k in range(1, steps + 1):
        h = [f"sum(p * (1 - p) * {x[i]} * {x[j]}){' + 1' if i == j > 0 else ''} AS h{i}{j}" for i in range(n) for j in range(n)]
        g = [f"sum((p - y) * {x[i]}){f' + c{i}' if i else ''} AS g{i}" for i in range(n)]
        sql += f""",
a{k} AS (SELECT c0, c1, c2, c3, {', '.join(h + g)} FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * z1 + c2 * z2 + c3 * z3))) AS p FROM z, b{k - 1}) GROUP BY c0, c1, c2, c3)"""
        last = f"a{k}"
        for t in range(n - 1):  # eliminate column t below the diagonal
            cols = [f"h{i}{j} - h{i}{t} / h{t}{t} * h{t}{j} AS h{i}{j}" if i > t else f"h{i}{j}" for i in range(n) for j in range(n)]
            cols += [f"g{i} - h{i}{t} / h{t}{t} * g{t} AS g{i}" if i > t else f"g{i}" for i in range(n)]
            sql += f",\ne{k}_{t} AS (SELECT c0, c1, c2, c3, {', '.join(cols)} FROM {last})"
            last = f"e{k}_{t}"
        for i in range(n - 1, -1, -1):
            known = "".join(f" - h{i}{j} * d{j}" for j in range(i + 1, n))
            sql += f",\ns{k}_{i} AS (SELECT *, (g{i}{known}) / h{i}{i} AS d{i} FROM {last})"
            last = f"s{k}_{i}"
        sql += f",\nb{k} AS (SELECT c0 - d0 AS c0, c1 - d1 AS c1, c2 - d2 AS c2, c3 - d3 AS c3 FROM {last})"
    return sql + f",\nfit AS (SELECT * FROM b{steps})"


FEATURES = ["size", "log_size", "toxic"]


@query("logistic_coefficients", "K04", f"WITH {newton_sql()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {rnd(f'c{i}', 3)} AS coefficient FROM fit" for i, f in [*enumerate(FEATURES, 1), (0, "intercept")]))
def _(t):
    coefs, _scored = models.logistic(labelled(t), FEATURES, "quality")
    return coefs.withColumn("coefficient", F.round("coefficient", 3) + 0.0)


@query("logistic_auc", "K04, E18", f"""WITH {newton_sql()}, sc AS (SELECT quality, round(c0 + c1 * z1 + c2 * z2 + c3 * z3, 9) AS v FROM z, fit), r AS (SELECT quality, avg(rk) OVER (PARTITION BY v) AS rk FROM (SELECT *, row_number() OVER (ORDER BY v) AS rk FROM sc))
SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg,
  {rnd('(sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1))', 3)} AS auc FROM r""")
def _(t):
    """Area under the curve of the fitted score."""
    _coefs, scored = models.logistic(labelled(t), FEATURES, "quality")
    return models.auc(scored.withColumn("score", F.round("score", 9)), "score", "quality").withColumn("auc", F.round("auc", 3))


@query("auc_of_score", "E18, K04", f"""WITH d AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, avg(rk) OVER (PARTITION BY n_chars) AS rk FROM (SELECT *, row_number() OVER (ORDER BY n_chars) AS rk FROM d))
SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg,
  {rnd('(sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1))', 6)} AS auc FROM r""")
def _(t):
    return models.auc(labelled(t), "size", "quality").withColumn("auc", F.round("auc", 6))


@query("roc_curve", "E18", f"""WITH d AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)), s AS (SELECT n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM d GROUP BY 1)
SELECT {rnd('n_chars / 1000', 3)} AS size, {rnd('sum(p) OVER (ORDER BY n_chars DESC) / (SELECT sum(p) FROM s)', 6)} AS tpr, {rnd('sum(n) OVER (ORDER BY n_chars DESC) / (SELECT sum(n) FROM s)', 6)} AS fpr FROM s""")
def _(t):
    return models.roc_curve(labelled(t), "size", "quality").select(F.round("size", 3).alias("size"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("ols_residuals", "K07", f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {rnd('l_extendedprice - (a + b * l_quantity)', 2)} AS residual FROM lineitem, f""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return models.with_residual(rows, "l_quantity", "l_extendedprice").withColumn("residual", F.round("residual", 2)).drop("l_quantity")


@query("ols_by_group", "K07", f"""SELECT l_returnflag, count(*) AS n, {rnd('regr_slope(l_extendedprice, l_quantity)')} AS slope, {rnd('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {rnd('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2 FROM lineitem GROUP BY 1""")
def _(t):
    out = models.simple_ols(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("podium_chances", "E19", f"""WITH d AS (SELECT CAST(day(ts) AS INTEGER) AS d, user_id AS u, avg(value) / 200 AS x FROM events GROUP BY 1, 2),
p AS (SELECT d, u, exp(x / 0.4) / sum(exp(x / 0.4)) OVER (PARTITION BY d) AS p FROM d),
g AS (SELECT a.d, a.u AS j, b.u AS k, a.p * b.p / ((1 - a.p) * (1 - a.p - b.p)) AS g FROM p a JOIN p b ON a.d = b.d AND a.u <> b.u),
t AS (SELECT d, sum(g) AS g FROM g GROUP BY 1), r AS (SELECT d, j AS u, sum(g) AS r FROM g GROUP BY 1, 2), c AS (SELECT d, k AS u, sum(g) AS c FROM g GROUP BY 1, 2),
q AS (SELECT b.d, b.u, sum(a.p / (1 - a.p)) * any_value(b.p) AS p2 FROM p a JOIN p b ON a.d = b.d AND a.u <> b.u GROUP BY 1, 2)
SELECT p.d AS match_day, p.u AS user_id, {rnd('p.p', 6)} AS p1, {rnd('q.p2', 6)} AS p2, {rnd('p.p * (t.g - r.r - c.c)', 6)} AS p3 FROM p JOIN q ON q.d = p.d AND q.u = p.u JOIN t ON t.d = p.d JOIN r ON r.d = p.d AND r.u = p.u JOIN c ON c.d = p.d AND c.u = p.u""")
def _(t):
    d = t.events.groupBy(F.dayofmonth("ts").alias("match_day"), "user_id").agg((F.avg("value") / 200).alias("x"))
    out = podium(d, ["match_day"], "user_id", F.col("x"))
    return out.select("match_day", "user_id", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p3")])


PLAN_SQL = f"""WITH RECURSIVE {PLAYERS_SQL}, pool AS (SELECT *, row_number() OVER (ORDER BY xpts DESC, id) AS k FROM
  (SELECT player_id AS id, pos, price, round(xg * 5 + xa * 3, 6) AS xpts FROM players) WHERE xpts > 0 AND price > 0),
shapes AS (SELECT * FROM (VALUES {', '.join(f'({i}, {d}, {m}, {f})' for i, (d, m, f) in enumerate(transfers.FORMATIONS))}) v(formation, d, m, f)),
walk AS (SELECT s_suppkey AS manager_id, formation, CAST(0 AS BIGINT) AS k, 90.0::DOUBLE + s_acctbal / 100 AS money, 0.0::DOUBLE AS points, 1 AS g, d, m, f FROM supplier, shapes
  UNION ALL SELECT manager_id, formation, k + 1, CASE WHEN buy THEN money - price ELSE money END, CASE WHEN buy THEN points + xpts ELSE points END,
    g - CAST(buy AND pos = 'G' AS INTEGER), d - CAST(buy AND pos = 'D' AS INTEGER), m - CAST(buy AND pos = 'M' AS INTEGER), f - CAST(buy AND pos = 'F' AS INTEGER)
  FROM (SELECT w.*, p.price, p.xpts, p.pos, p.price <= w.money AND CASE p.pos WHEN 'G' THEN g WHEN 'D' THEN d WHEN 'M' THEN m ELSE f END > 0 AS buy FROM walk w JOIN pool p ON p.k = w.k + 1 WHERE g + d + m + f > 0)),
done AS (SELECT * FROM walk WHERE g + d + m + f = 0)
SELECT s_suppkey AS manager_id, formation, {rnd('points')} AS total, {rnd('money')} AS money_left FROM supplier LEFT JOIN done ON manager_id = s_suppkey QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY points DESC, formation) = 1"""


@query("best_squad_plans", "K05, J03", PLAN_SQL)
def _(t):
    managers = t.supplier.select(F.col("s_suppkey").alias("manager_id"), (F.lit(90.0) + F.col("s_acctbal") / 100).alias("budget"))
    pool = t.players().select(F.col("player_id").alias("id"), F.col("pos").alias("position"), "price", F.round(F.col("xg") * 5 + F.col("xa") * 3, 6).alias("xpts"))
    out = transfers.best_transfers(transfers.formation_plans(managers), pool, ["manager_id", "formation"])
    return out.select("manager_id", "formation", F.round("total", 4).alias("total"), F.round("money_left", 4).alias("money_left"))
