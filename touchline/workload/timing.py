"""Minute series and event studies on daily user activity."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import series as se
from touchline.workload.registry import query
from touchline.workload.tables import DAILY_SQL, SERIES_SQL, rnd  # noqa: F401

# Two-sided p-value of t with whole degrees of freedom d, by the finite series in closed terms.
P_SQL = """CASE WHEN d = 1 THEN 1 - 2 / pi() * atan(abs(t_stat))
  WHEN d % 2 = 0 THEN 1 - sin(atan(abs(t_stat) / sqrt(d))) * (SELECT sum(exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1)) * power(cos(atan(abs(t_stat) / sqrt(d))), 2 * k)) FROM generate_series(0, CAST(d // 2 - 1 AS BIGINT)) g(k))
  ELSE 1 - 2 / pi() * (atan(abs(t_stat) / sqrt(d)) + sin(atan(abs(t_stat) / sqrt(d))) * coalesce((SELECT sum(exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(cos(atan(abs(t_stat) / sqrt(d))), 2 * k + 1)) FROM generate_series(0, CAST((d - 3) // 2 AS BIGINT)) g(k)), 0)) END"""

EVENTS_SQL = SERIES_SQL + """,
ev AS (SELECT event_id, user_id, CAST(day(ts) AS INTEGER) AS minute, event_type, user_id % 2 = 0 AS is_home, value FROM events WHERE event_type IN ('error', 'purchase')),
win AS (SELECT ev.*, CAST(o AS INTEGER) AS "offset", CASE WHEN is_home THEN s.value ELSE -s.value END AS signed FROM ev, generate_series(-5, 10) g(o), series s WHERE s.user_id = ev.user_id AND s.t = ev.minute + o)"""


def series(t):
    return se.densify(t.daily(), "user_id", F.col("minute"), ["minute"], "value", 1, 30)


def triggers(t):
    e = t.events.where(F.col("event_type").isin("error", "purchase"))
    return e.select("event_id", "user_id", F.dayofmonth("ts").alias("minute"), "event_type", (F.col("user_id") % 2 == 0).alias("is_home"))


@query("densified_series", "E01, J04, D11", f"WITH {SERIES_SQL} SELECT user_id, t, {rnd('value')} AS value FROM series")
def _(t):
    return series(t).withColumn("value", F.round("value", 4))


@query("autocorrelation", "E02", f"""WITH {SERIES_SQL}, c AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS c FROM series),
l AS (SELECT a.user_id, k AS lag, sum(a.c * b.c) AS s FROM c a, (SELECT unnest([1, 2, 3, 5, 10]) AS k), c b WHERE a.user_id = b.user_id AND b.t = a.t - k GROUP BY 1, 2), v AS (SELECT user_id, sum(c * c) AS v FROM c GROUP BY 1)
SELECT user_id, lag, {rnd('CASE WHEN v > 1e-12 THEN s / v ELSE 0 END')} AS ac FROM l JOIN v USING (user_id)""")
def _(t):
    return se.autocorrelation(series(t), "user_id", [1, 2, 3, 5, 10]).withColumn("ac", F.round("ac", 4))


@query("autocorrelation_test", "K01, E02, D12, J02", f"""WITH {SERIES_SQL}, c AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS c FROM series),
l AS (SELECT a.user_id, k AS lag, sum(a.c * b.c) AS s FROM c a, (SELECT unnest([1, 2, 3, 5, 10]) AS k), c b WHERE a.user_id = b.user_id AND b.t = a.t - k GROUP BY 1, 2), v AS (SELECT user_id, sum(c * c) AS v FROM c GROUP BY 1),
ac AS (SELECT lag, CASE WHEN v > 1e-12 THEN s / v ELSE 0 END AS ac FROM l JOIN v USING (user_id)),
st AS (SELECT lag, count(*) AS n, avg(ac) AS mean, stddev_pop(ac) / sqrt(count(*)) AS se, avg(ac) / sqrt(var_samp(ac) / count(*)) AS t_stat, count(*) - 1 AS d FROM ac GROUP BY 1)
SELECT lag, n, {rnd('mean')} AS mean, {rnd('se')} AS se, {rnd(P_SQL)} AS p_value FROM st""")
def _(t):
    ac = se.autocorrelation(series(t), "user_id", [1, 2, 3, 5, 10])
    out = se.mean_with_test(ac, ["lag"], "ac")
    return out.select("lag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "se", "p_value")])


@query("minute_profile", "D11, L06", f"""WITH {SERIES_SQL} SELECT t, {rnd('avg(value)', 6)} AS mean, {rnd('stddev_pop(value)', 6)} AS std, {rnd('quantile_cont(value, 0.25)', 6)} AS p25, {rnd('quantile_cont(value, 0.75)', 6)} AS p75 FROM series GROUP BY 1""")
def _(t):
    out = se.profile(series(t))
    return out.select("t", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p75")])


@query("pre_event_mean", "E03", f"""WITH {SERIES_SQL}, p AS (SELECT user_id, t, avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM series)
SELECT event_id, {rnd('m', 6)} AS pre_mean FROM events e JOIN p ON p.user_id = e.user_id AND p.t = day(e.ts) WHERE event_type IN ('error', 'purchase')""")
def _(t):
    pre = se.pre_mean(series(t), "user_id").select("user_id", F.col("t").alias("minute"), "pre_mean")
    return triggers(t).join(pre, ["user_id", "minute"]).select("event_id", F.round("pre_mean", 6).alias("pre_mean"))


@query("event_windows", "C15, D13, B12", f"""WITH {EVENTS_SQL} SELECT event_id, count(*) AS points, {rnd('avg(signed) FILTER ("offset" < 0)', 6)} AS pre_mean, {rnd('avg(signed) FILTER ("offset" > 0)', 6)} AS post_mean
    FROM win GROUP BY 1 HAVING count(*) >= 15 AND count(*) FILTER ("offset" < 0) > 0 AND count(*) FILTER ("offset" > 0) > 0""")
def _(t):
    w = se.signed_windows(triggers(t), series(t), "user_id", 5, 10)
    out = se.event_means(w, ["event_id"], 15)
    return out.select("event_id", "points", F.round("pre_mean", 6).alias("pre_mean"), F.round("post_mean", 6).alias("post_mean"))


@query("event_study", "K09, J01, D13, K01", f"""WITH {EVENTS_SQL.replace("ev AS (", "ev0 AS (").replace("),\nwin", "),\nev AS (SELECT event_id, user_id, minute, 'error' AS selector, is_home FROM ev0 WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, minute, 'error_rival', NOT is_home FROM ev0 WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, minute, 'purchase', is_home FROM ev0 WHERE event_type = 'purchase'),\nwin")},
m AS (SELECT selector, event_id, avg(signed) FILTER ("offset" < 0) AS pre, avg(signed) FILTER ("offset" > 0) AS post FROM win GROUP BY 1, 2 HAVING count(*) >= 15 AND pre IS NOT NULL AND post IS NOT NULL),
st AS (SELECT selector, count(*) AS n, avg(pre) AS mean_pre, avg(post) AS mean_post, avg(post - pre) AS mean_delta, avg(post - pre) / sqrt(var_samp(post - pre) / count(*)) AS t_stat, count(*) - 1 AS d FROM m GROUP BY 1)
SELECT selector, n, {rnd('mean_pre')} AS mean_pre, {rnd('mean_post')} AS mean_post, {rnd('mean_delta')} AS mean_delta, {rnd('t_stat')} AS t_stat, {rnd(P_SQL, 6)} AS p_value FROM st""")
def _(t):
    e = F.col("event_type")
    selectors = {"error": (e == "error", False), "error_rival": (e == "error", True), "purchase": (e == "purchase", False)}
    out = se.event_study(triggers(t), series(t), "user_id", selectors)
    return out.select("selector", "n", *[F.round(c, 4).alias(c) for c in ("mean_pre", "mean_post", "mean_delta", "t_stat")], F.round("p_value", 6).alias("p_value"))


@query("event_trajectory", "D12", f"""WITH {EVENTS_SQL} SELECT event_type, "offset", count(*) AS n, {rnd('avg(signed)')} AS mean, {rnd('stddev_pop(signed) / sqrt(count(*))')} AS se FROM win GROUP BY 1, 2""")
def _(t):
    w = se.signed_windows(triggers(t), series(t), "user_id", 5, 10)
    out = se.trajectory(w, ["event_type"])
    return out.select("event_type", "offset", "n", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


@query("effect_half_life", "D14", f"""WITH {EVENTS_SQL}, tr AS (SELECT "offset" AS o, avg(signed) AS m FROM win GROUP BY 1), s AS (SELECT avg(m) FILTER (o < 0) AS b, max(m) FILTER (o > 0) AS p FROM tr)
SELECT {rnd('b')} AS baseline, {rnd('p')} AS peak, (SELECT min(o) FROM tr, s WHERE o > 0 AND m <= b + (p - b) * 0.5) AS half_life FROM s""")
def _(t):
    w = se.signed_windows(triggers(t), series(t), "user_id", 5, 10)
    out = se.half_life(se.trajectory(w, []))
    return out.select(F.round("baseline", 4).alias("baseline"), F.round("peak", 4).alias("peak"), "half_life")


@query("context_comparison", "K08, K01", f"""WITH {EVENTS_SQL}, m AS (SELECT event_id, avg(signed) FILTER ("offset" < 0) AS pre, avg(signed) FILTER ("offset" > 0) AS post FROM win WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT count(*) FILTER (pre > 0) AS n1, avg(post) FILTER (pre > 0) AS m1, var_samp(post) FILTER (pre > 0) AS v1, count(*) FILTER (pre <= 0) AS n2, avg(post) FILTER (pre <= 0) AS m2, var_samp(post) FILTER (pre <= 0) AS v2 FROM m WHERE pre IS NOT NULL AND post IS NOT NULL),
st AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_stat, n1 + n2 - 2 AS d FROM s)
SELECT n1 AS n_1, {rnd('m1')} AS mean_1, n2 AS n_2, {rnd('m2')} AS mean_2, {rnd('t_stat')} AS t_stat, {rnd(P_SQL, 6)} AS p_value FROM st""")
def _(t):
    e = triggers(t).where(F.col("event_type") == "purchase")
    m = se.event_means(se.signed_windows(e, series(t), "user_id", 5, 10), ["event_id"], 10)
    out = se.compare_groups(m.withColumn("announced", F.col("pre_mean") > 0), "announced", "post_mean")
    return out.select("n_1", F.round("mean_1", 4).alias("mean_1"), "n_2", F.round("mean_2", 4).alias("mean_2"), F.round("t_stat", 4).alias("t_stat"), F.round("p_value", 6).alias("p_value"))


@query("dominance_by_team", "D15, D16, L06", f"""WITH {SERIES_SQL} SELECT user_id % 7 AS team, count(*) AS minutes, count(*) FILTER (value > 60) AS dominant, {rnd('count(*) FILTER (value > 60) * 100.0 / count(*)', 1)} AS pct_dominant FROM series GROUP BY 1""")
def _(t):
    from touchline.operators.aggregates import share

    s = series(t).withColumn("team", F.col("user_id") % 7)
    high = F.col("value") > 60
    return s.groupBy("team").agg(F.count("*").alias("minutes"), F.count_if(high).alias("dominant"), share(high).alias("pct_dominant"))
