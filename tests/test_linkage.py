import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import joins, linkage

FIRST, LAST = ["juan", "luis", "ana", "jo"], ["perez", "silva", "sosa", "diaz", "paz"]


def matches(a: str, b: str) -> bool:
    shared = set(a.split()) & set(b.split())
    return a == b or any(len(w) > 3 for w in shared)


def people(rng, n):
    return [" ".join([rng.choice(FIRST)] * (rng.random() < 0.8) + [rng.choice(LAST)] + ["x"] * (rng.random() < 0.1)) for _ in range(n)]


def test_fuzzy_first_and_ambiguity(spark):
    rng = random.Random(1)
    left, right = people(rng, 40), people(rng, 15)
    a = spark.createDataFrame(list(enumerate(left)), "lid int, name string")
    b = spark.createDataFrame([(100 + i, i, n) for i, n in enumerate(right)], "rid int, ord int, name string")
    got = {r.lid: (r.match_id, r.ambiguous) for r in linkage.fuzzy_first(a, b, "lid", "rid", "ord").collect()}
    for i, n in enumerate(left):
        hits = [100 + j for j, m in enumerate(right) if matches(n, m)]
        assert got.get(i) == ((hits[0], len(hits) > 1) if hits else None)


def test_cascade(spark):
    right = [(1, 0, "juan perez"), (2, 1, "ana silva"), (3, 2, "luis silva"), (4, 3, "ana silva")]
    b = spark.createDataFrame(right, "rid int, ord int, name string")
    a = spark.createDataFrame([(1, "juan perez"), (2, "j perez"), (3, "luis m silva"), (4, "zoe silva"), (5, "nobody"), (6, "ana silva")], "lid int, name string")
    got = {r.lid: (r.match_id, r.stage) for r in linkage.cascade_match(a, b, "lid", "rid", "ord").collect()}
    assert got == {1: (1, "exact"), 2: (1, "last_token"), 3: (3, "first_and_last"), 4: (None, None), 5: (None, None), 6: (4, "exact")}


def test_link_fixtures(spark):
    rng = random.Random(5)
    teams = ["club alpha", "alpha fc", "beta", "gamma city", "city", "delta"]

    def games(n, base):
        out = []
        for i in range(n):
            h, a = rng.sample(teams, 2)
            known = rng.random() < 0.7
            out.append((base + i, h, a, rng.randrange(2) if known else None, rng.randrange(2) if known else None))
        return out

    left, right = games(40, 0), games(25, 100)
    schema = "id int, home string, away string, score_home int, score_away int"
    a = spark.createDataFrame(left, schema).withColumnRenamed("id", "lid")
    b = spark.createDataFrame(right, schema).withColumnRenamed("id", "rid").withColumn("ord", F.col("rid"))
    got = {r.lid: r.match_id for r in linkage.link_fixtures(a, b, "lid", "rid", "ord").collect()}
    for i, h, w, sh, sa in left:
        want = next((j for j, rh, rw, rsh, rsa in right if matches(h, rh) and matches(w, rw) and (sh is None or rsh is None or (sh == rsh and sa == rsa))), None)
        assert got[i] == want


def test_match_scorers(spark):
    rng = random.Random(9)
    rows_a, rows_b, want = [], [], []
    for m in range(30):
        a, b = people(rng, rng.randrange(5)), people(rng, rng.randrange(5))
        rows_a += [(m, i, n) for i, n in enumerate(a)]
        rows_b += [(m, i, n) for i, n in enumerate(b)]
        used = set()
        for n in a:
            hit = next((j for j, x in enumerate(b) if j not in used and matches(n, x)), None)
            if hit is not None:
                used.add(hit)
        want += [(m, "a", i, n) for i, n in enumerate(a) if not any(matches(n, x) for x in b)]
        want += [(m, "b", j, x) for j, x in enumerate(b) if j not in used]
    schema = "match_id int, ordinal int, name string"
    out = linkage.match_scorers(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema), ["match_id"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_match_scorers_of_a_long_side(spark):
    a = spark.range(10_001).selectExpr("1 as match_id", "cast(id as int) as ordinal", "element_at(array('juan perez', 'luis sosa', 'zz'), cast(id % 3 as int) + 1) as name")
    b = spark.range(9_000).selectExpr("1 as match_id", "cast(id as int) as ordinal", "element_at(array('pedro perez', 'ana silva', 'l sosa'), cast(id % 3 as int) + 1) as name")
    got = {}
    for r in linkage.match_scorers(a, b, ["match_id"]).collect():
        got[(r.source, r.name)] = got.get((r.source, r.name), 0) + 1
    assert got == {("a", "zz"): 3333, ("b", "ana silva"): 3000}


@pytest.mark.parametrize("rounds", [16, 1])
def test_match_scorers_of_crowded_sides(spark, rounds):
    """Few tokens shared by many names, repeated names, nulls and equal ordinals; the fold takes over after one round."""
    rng = random.Random(2)
    tokens = ["perez", "silva", "sosa", "juan", "luis"]
    name = lambda: None if rng.random() < 0.05 else " ".join(rng.sample(tokens, rng.randrange(1, 3)))
    rows = {s: [(m, rng.randrange(8), name()) for m in range(6) for _ in range(rng.randrange(25))] for s in "ab"}
    want = []
    for m in range(6):
        a, b = (sorted((r for r in rows[s] if r[0] == m), key=lambda r: (r[1], r[2] or "")) for s in "ab")
        used = set()
        for r in a:
            hit = [j for j, x in enumerate(b) if r[2] and x[2] and matches(r[2], x[2])]
            if not hit:
                want.append((m, "a", r[1], r[2]))
            used |= set([j for j in hit if j not in used][:1])
        want += [(m, "b", x[1], x[2]) for j, x in enumerate(b) if j not in used]
    schema = "match_id int, ordinal int, name string"
    out = linkage.match_scorers(spark.createDataFrame(rows["a"], schema), spark.createDataFrame(rows["b"], schema), ["match_id"], rounds=rounds)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_top_matchups_cut_before_the_pairs(spark):
    rng = random.Random(5)
    players = [(i, f"t{i % 6}", rng.choice([rng.random() * 3, 0.5, 0.5 + 1e-7 * rng.random()])) for i in range(900)] + [(1000, "t9", 1.0), (1001, "t9", None)]
    strengths = [(f"t{i}", 0.5 + i / 3) for i in range(6)] + [("t9", 1.0)]
    pairs = [(a, b) for a, _ in strengths for b, _ in strengths if a < b]
    df = spark.createDataFrame(players, "player_id int, team string, v double")
    got = joins.top_matchups(spark.createDataFrame(pairs, "home string, away string"), df, spark.createDataFrame(strengths, "team string, f double"), F.col("v"), F.col("f"), 40)
    found = {}
    for r in got.collect():
        found.setdefault((r.home, r.away), {})[r["rank"]] = r.player_id
    factor = dict(strengths)
    for h, a in pairs:
        rows = [(-round(v * factor[a if t == h else h], 6), i) for i, t, v in players if t in (h, a) and v is not None]
        assert [found[h, a][k + 1] for k in range(40)] == [i for _, i in sorted(rows)[:40]]


def test_setpiece_roles_by_the_rarest_token(spark):
    """One token is in a third of the names: it is no key unless a taker is called nothing else."""
    players = [(i, "A", ["silva" if i % 3 == 0 else f"x{i}", f"n{i}"]) for i in range(3000)]
    takers = [("A", "pk", i, ["silva", f"n{3 * i}"]) for i in range(50)] + [("A", "ck", 0, ["zz", "silva"])]
    p = spark.createDataFrame(players, "player_id int, team string, name_tokens array<string>")
    t = spark.createDataFrame(takers, "team string, kind string, idx int, taker_tokens array<string>")
    got = {(r.player_id, r.idx) for r in joins.setpiece_roles(p, t).collect()}
    assert got == {(3 * i, i) for i in range(50)}


def test_setpiece_roles(spark):
    players = spark.createDataFrame([(1, "A", ["juan", "perez"]), (2, "A", ["silva"]), (3, "B", ["perez"])], "player_id int, team string, name_tokens array<string>")
    takers = spark.createDataFrame([("A", "pk", 0, ["silva"]), ("A", "pk", 1, ["perez"]), ("A", "ck", 1, ["perez", "juan"]), ("A", "fk", 0, [])], "team string, kind string, idx int, taker_tokens array<string>")
    got = {(r.player_id, r.role) for r in joins.setpiece_roles(players, takers).collect()}
    assert got == {(2, "pk_primary"), (1, "pk_secondary"), (1, "ck_primary")}


def test_short_sides_are_matched_without_rounds(spark, monkeypatch):
    """Short sides never reach the rounds; with a lower bound the long ones do, and the leftovers are the same."""
    rng = random.Random(7)
    tokens = ["perez", "silva", "sosa", "juan", "luis"]
    name = lambda: None if rng.random() < 0.1 else " ".join(rng.sample(tokens, rng.randrange(1, 3)))
    rows = {s: [(m, i, name()) for m in [None, 2**60 + 1, *range(6)] for i in range(rng.randrange(12))] for s in "ab"}
    frames = [spark.createDataFrame(rows[s], "match_id long, ordinal int, name string") for s in "ab"]
    leftovers = lambda: sorted(map(str, map(tuple, linkage.match_scorers(*frames, ["match_id"]).collect())))
    monkeypatch.setattr(linkage, "SIDE", 8)
    mixed = leftovers()
    monkeypatch.undo()
    monkeypatch.setattr(linkage, "_first_choices", None)
    assert leftovers() == mixed


def test_rows_that_cannot_meet_stay_out_of_the_join(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, null, id) as k", "id as v")
    few = spark.createDataFrame([(7,), (7,), (31,), (2**40,), (None,)], "k long")
    left = joins.may_meet(rows, few, ["k"])
    got = {r.k for r in left.collect()}
    assert {7, 31} <= got and len(got) < 50 and left.columns == ["k", "v"]
    assert joins.may_meet(rows, few.selectExpr("cast(k as double) as k"), ["k"]) is rows


def test_a_table_of_one_row_group_is_dealt_by_its_rows(spark, monkeypatch):
    from touchline import session

    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    dealt = session.spread(spark.range(0, 20_000, 1, 8).toDF("player_id"), "player_id")
    assert dealt.rdd.getNumPartitions() == 20 and max(dealt.rdd.glom().map(len).collect()) < 1500
    players = spark.range(20_000).selectExpr("id as player_id", "'A' as team", "array('silva') as name_tokens")
    takers = spark.createDataFrame([("A", "pk", 0, ["silva"])], "team string, kind string, idx int, taker_tokens array<string>")
    out = joins.setpiece_roles(players, takers)
    assert out.count() == 20_000
