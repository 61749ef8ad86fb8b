import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import ordered as od


@pytest.fixture(scope="module")
def skewed():
    """One key holds more than a third of the rows."""
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}"), i, float(rng.randrange(40)), None if rng.random() < 0.6 else float(i)) for i in range(900)]
    rng.shuffle(rows)
    return rows


def test_running_totals_and_carry(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i int, v double, w double")
    got = {(r.k, r.i): (r.total, r.n) for r in od.running_totals(df, ["k"], [F.col("i")], {"total": F.col("v"), "n": F.lit(1)}).collect()}
    carried = {(r.k, r.i): r.last for r in od.carry_forward(df, ["k"], ["i"], "w", "last").collect()}
    total, n, last = {}, {}, {}
    for k, i, v, w in sorted(skewed, key=lambda r: r[1]):
        total[k], n[k] = total.get(k, 0) + v, n.get(k, 0) + 1
        last[k] = w if w is not None else last.get(k)
        assert got[(k, i)] == (pytest.approx(total[k]), n[k])
        assert carried[(k, i)] == last[k]
    assert len(got) == len(skewed) == len(carried)


def test_null_keys_survive(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 1.0)], "k string, i int, v double")
    got = sorted((r.k or "", r.i, r.total) for r in od.running_totals(df, ["k"], [F.col("i")], {"total": F.col("v")}).collect())
    assert got == [("", 1, 2.0), ("", 2, 5.0), ("a", 1, 1.0)]


def test_order_statistics(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i int, v double, w double")
    med = {r.k: r.m for r in od.upper_median(df, ["k"], "v", "m").collect()}
    pct = {r.k: (r.a, r.b) for r in od.percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}).collect()}
    groups = {}
    for k, _i, v, _w in skewed:
        groups.setdefault(k, []).append(v)
    for k, vs in groups.items():
        vs.sort()
        assert med[k] == vs[len(vs) // 2]
        for got, p in zip(pct[k], (0.25, 0.9)):
            pos = (len(vs) - 1) * p
            lo = int(pos)
            hi = min(lo + 1, len(vs) - 1)
            assert got == pytest.approx(vs[lo] + (vs[hi] - vs[lo]) * (pos - lo))


def test_constant_and_wide_values(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4 + [("b", 1e300), ("b", 1.0), ("b", 2.0), ("b", -3.0)], "k string, v double")
    assert {r.k: r.m for r in od.upper_median(df, ["k"], "v", "m").collect()} == {"a": 5.0, "b": 2.0}
    assert od.upper_median(df, [], "v", "m").first().m == 5.0


def test_dense_ranks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 7), ("c", 7), ("d", 1)], "n string, g int")
    assert {r.n: r["rank"] for r in od.dense_ranks(df, "g").collect()} == {"b": 1, "c": 1, "a": 2, "d": 3}


def test_next_after(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")], "team string, day int, id string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 3, 12), ("a", 3, 11), ("a", 9, 13)], "team string, d int, ev int")
    got = {r.id: r.next_ev for r in od.next_after(left, right, ["team"], "day", "d", ["ev"], ["ev"]).collect()}
    assert got == {"x": 11, "y": 13, "z": None}


def test_top_n_overall(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    got = [(r.id, r["rank"]) for r in od.top_n_overall(df, [F.col("v").desc(), F.col("id")], 3).orderBy("rank").collect()]
    assert got == [(9, 1), (19, 2), (29, 3)]


@pytest.mark.parametrize("most", [10_000, 40])
def test_order_statistics_on_skewed_values(spark, most):
    """An outlier, a heavy value, wide longs and decimals; ``most`` small enough to narrow again and again."""
    import math
    from decimal import Decimal

    rng = random.Random(7)
    rows = [("a", 10**12)] + [("a", rng.randrange(1000)) for _ in range(20_000)]
    rows += [("b", 2**53 + rng.randrange(50)) for _ in range(500)] + [("c", 5)] * 300 + [("c", rng.randrange(10**9)) for _ in range(300)] + [("d", 7), (None, 1), (None, 3)]
    rows += [("e", int(math.exp(rng.random() * 40))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long")
    ranks = {"low": lambda n: F.floor(n / 10), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1, "least": lambda n: n * 0}
    got = {r.k: (r.low, r.mid, r.top, r.least) for r in od.order_statistics(df, ["k"], "v", ranks, most).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for vs in groups.values():
        vs.sort()
    assert got == {k: (vs[len(vs) // 10], vs[len(vs) // 2], vs[-1], vs[0]) for k, vs in groups.items()}
    every = sorted(v for _, v in rows)
    assert od.order_statistics(df, [], "v", ranks, most).first().mid == every[len(every) // 2]
    dec = spark.createDataFrame([(Decimal(f"{i}.{i:018d}"),) for i in range(999)], "v decimal(38, 18)")
    assert od.upper_median(dec, [], "v", "m").first().m == Decimal(f"499.{499:018d}")


def test_no_interval_is_crowded_by_an_outlier(spark):
    """200,000 values and one of 1e12: no interval holds over 2 % of the rows."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("_v"), F.lit(0).alias("g"))
    df = df.union(spark.createDataFrame([(1e12, 0)], "_v double, g int"))
    bounds = od.rank_intervals(df, ["g"], {"m": lambda n: F.floor(n / 2), "q": lambda n: F.floor(n / 4)}).first()
    for name in "mq":
        assert df.where((F.col("_v") >= bounds[f"_lo_{name}"]) & (F.col("_v") <= bounds[f"_hi_{name}"])).count() < 0.02 * 200_001


def test_order_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert od.upper_median(empty, ["k"], "v", "m").count() == 0
    assert od.upper_median(spark.createDataFrame([("a", None)], "k string, v long"), ["k"], "v", "m").count() == 0


def test_next_after_keeps_all_digits(spark):
    """Times beyond 2**53 that differ by one, and dates."""
    base = 2**60
    left = spark.createDataFrame([("a", base, 1), ("a", base + 1, 2), ("a", base + 3, 3)], "k string, t long, id int")
    right = spark.createDataFrame([("a", base + 1, 10), ("a", base + 2, 20), ("a", -base, 30)], "k string, t long, v int")
    got = {r.id: r.next_v for r in od.next_after(left, right, ["k"], "t", "t", ["v"], ["v"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}
    day = lambda df: df.withColumn("t", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("t") - base).cast("int")))
    got = {r.id: r.next_v for r in od.next_after(day(left), day(right.where("v < 30")), ["k"], "t", "t", ["v"], ["v"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}
