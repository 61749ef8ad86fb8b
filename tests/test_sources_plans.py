import glob
import json
import math
import tempfile
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from touchline import session
from touchline.operators import history, models
from touchline.plans import audit, league, portfolio, strength, tournament, transfers
from touchline.sources import feeds, readers, schemas, sinks


def test_keyed_and_named_json(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"11": {"name": "a", "mv": 5}, "12": {"name": "b"}}))
    got = {(r.pid, r.name, r.mv) for r in readers.read_keyed(spark, str(tmp_path / "k.json"), "pid", "struct<name: string, mv: long>").collect()}
    assert got == {("11", "a", 5), ("12", "b", None)}
    (tmp_path / "n.json").write_text(json.dumps({"fixtures": [{"id": 1}, {"id": 2}], "x": 3}))
    assert [(r.ordinal, r.id) for r in readers.read_named_array(spark, str(tmp_path / "n.json"), "fixtures", "struct<id: long>").collect()] == [(0, 1), (1, 2)]
    empty = readers.optional(spark, str(tmp_path / "none.json"), "id long", lambda p: readers.read_lines(spark, p, "id long"))
    assert empty.count() == 0 and empty.columns == ["id"]


def test_publish_upsert_sync(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, version int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 1)], "id int, v string, version int")
    sinks.publish(a, str(tmp_path / "t"), "001")
    sinks.publish(sinks.upsert(a, b, ["id"], "version"), str(tmp_path / "t"), "002")
    assert {(r.id, r.v) for r in sinks.latest(spark, str(tmp_path / "t")).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert (tmp_path / "t" / "runs" / "001").exists()
    cur = spark.createDataFrame([("A", 1, "k"), ("A", 2, "k"), ("B", 3, "k")], "team string, pid int, note string")
    snap = spark.createDataFrame([("A", 2, "n"), ("A", 4, "n")], "team string, pid int, note string")
    assert {tuple(r) for r in sinks.sync_members(cur, snap, "team", "pid").collect()} == {("A", 2, "k"), ("A", 4, "n"), ("B", 3, "k")}
    sinks.write_csv(a, str(tmp_path / "csv"), [F.col("id").desc()])
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["2", "1"]
    done = spark.createDataFrame([(1, 0), (2, 5)], "id int, n int")
    assert {r.id for r in sinks.pending(a.select("id"), done, ["id"], F.col("n") == 0).collect()} == {1}


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "r int, v string"), path, ["r"])
    sinks.write_table(spark.createDataFrame([(2, "c")], "r int, v string"), path, ["r"])
    assert {(r.r, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def match_feed(spark):
    inc = [
        {"incidentType": "goal", "incidentClass": "regular", "time": 10, "isHome": True, "player": {"id": 1, "name": "a"}, "homeScore": 1, "awayScore": 0},
        {"incidentType": "goal", "incidentClass": "ownGoal", "time": 20, "isHome": True, "player": {"id": 9, "name": "z"}, "homeScore": 2, "awayScore": 0},
        {"incidentType": "goal", "incidentClass": "penalty", "time": 30, "isHome": False, "player": {"id": 8, "name": "y"}, "rescinded": True},
        {"incidentType": "substitution", "time": 60, "addedTime": 2, "isHome": True, "playerIn": {"id": 3}, "playerOut": {"id": 1}},
        {"incidentType": "substitution", "time": 70, "isHome": False, "playerIn": {"id": 7}, "playerOut": {"id": 8}},
        {"incidentType": "card", "incidentClass": "red", "time": 80, "isHome": False, "player": {"id": 9, "name": "z"}},
        {"incidentType": "period", "text": "FT", "time": 90, "addedTime": 5},
    ]
    df = spark.createDataFrame([(1, 100, 200, json.dumps(inc))], "event_id long, home_id long, away_id long, j string")
    return feeds.incidents(df.withColumn("incidents", F.from_json("j", f"array<{schemas.INCIDENT}>")))


def test_incidents_and_minutes(spark):
    inc = match_feed(spark)
    goals = [(r.minute, r.is_own_goal, r.team_id) for r in feeds.goals(inc).orderBy("ordinal").collect()]
    assert goals == [(10.0, False, 100), (20.0, True, 100)]
    card = feeds.cards(inc).first()
    assert card.misses_next and card.team_id == 200
    lineup = spark.createDataFrame(
        [(1, 1, "starter", True, "a", None), (1, 2, "starter", True, "b", None), (1, 3, "bench", True, "c", None), (1, 4, "bench", True, "d", None), (1, 5, "missing", True, "e", None), (1, 8, "starter", False, "y", None)],
        "match_id long, player_id long, status string, is_home boolean, name string, reason string",
    )
    stats = spark.createDataFrame([(1, 1, 1, 0, 7.5, None, None, 0, 4, 2)], "match_id long, player_id long, goals int, assists int, rating double, xg double, xa double, saves int, shots int, key_passes int")
    got = {r.player_id: r for r in tournament.match_records(lineup, inc, stats).collect()}
    assert {k: (r.mins, r.status) for k, r in got.items()} == {
        1: (61, "starter"), 2: (95, "starter"), 3: (34, "sub_in"), 5: (0, "missing"), 7: (25, "sub_in"), 8: (70, "starter")
    }
    assert got[1].xg == pytest.approx(0.5) and got[1].xa == pytest.approx(0.16) and got[5].reason == "absent" and got[7].is_home is False


LINEUP = "match_id long, player_id long, status string, is_home boolean, name string, reason string"
SUBS = "match_id long, minute int, added int, player_out long, player_in long, is_home boolean, ordinal int"


def test_minutes_deal_matches_over_tasks_by_rows(spark, monkeypatch):
    """A task's rows do not grow with the table."""
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    of = F.floor(F.col("id") / 11)
    lineup = spark.range(22_000).select(of.alias("match_id"), F.col("id").alias("player_id"), F.lit("starter").alias("status"), F.lit(True).alias("is_home"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("reason"))
    ends = spark.range(2000).select(F.col("id").alias("match_id"), F.lit(90).alias("minute"), (F.col("id") % 4).cast("int").alias("added"))
    got = history.player_minutes(lineup, spark.createDataFrame([(7, 60, 0, 77, 1, True, 1)], SUBS), ends)
    sizes = got.rdd.glom().map(len).collect()
    assert len(sizes) == 22 and max(sizes) < 2200 and sum(sizes) == 22_001
    assert {(r.player_id, r.mins) for r in got.where("match_id = 7 and player_id in (1, 77, 78)").collect()} == {(1, 33), (77, 60), (78, 93)}


def test_minutes_of_rows_without_match_or_player(spark):
    """They meet no substitution and no whistle; repeated entries of a player count once, a starter's before a missing one's."""
    lineup = spark.createDataFrame(
        [(None, 1, "starter", True, "a", None), (1, None, "starter", True, "b", None), (None, 2, "bench", True, "c", None), (1, 3, "missing", True, "d", None), (1, 3, "starter", True, "d", None), (None, 4, "missing", True, "e", None)], LINEUP
    )
    subs = spark.createDataFrame([(None, 60, 0, 1, 4, False, 1), (1, 70, 1, None, None, True, 2), (1, 80, None, 3, 6, False, 3), (1, None, 0, 6, 7, True, 4)], SUBS)
    ends = spark.createDataFrame([(None, 120, 0), (1, 90, 4), (1, 45, 3)], "match_id long, minute int, added int")
    got = {(r.match_id, r.player_id): (r.mins, r.status, r.is_home) for r in history.player_minutes(lineup, subs, ends).collect()}
    assert got == {(None, 1): (90, "starter", True), (1, None): (94, "starter", True), (1, 3): (80, "starter", True), (None, 4): (30, "sub_in", False), (1, 6): (14, "sub_in", False)}


def test_roster_page(spark):
    html = '<table><tr><td><a href="/juan/profil/spieler/77">Juan <b>P</b></a></td><td>x</td><td class="r">€1,20M</td></tr><tr><td>head</td></tr></table>'
    r = feeds.roster_rows(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(x.player_id, x.name, x.market_value) for x in r] == [(77, "Juan P", 1_200_000)]


def test_agency_report(spark):
    players = spark.createDataFrame(
        [(1, "a", "AG", "c1", 100.0, "2000-01-01", None), (2, "b", "AG", "c2", 300.0, "1990-01-01", False), (3, "c", "AG", "c3", None, None, None), (4, "bad", "AG", "c", 9.0, None, True)],
        "player_id int, name string, agency string, club string, market_value double, birth string, error boolean",
    ).withColumn("birth_date", F.to_date("birth"))
    tr = spark.createDataFrame(
        [(1, 1, "2018-01-01", 0.0, False, "River Plate", "Boca"), (1, 2, "2020-06-01", 50.0, False, "Boca", "Porto"), (1, 3, "2021-06-01", 0.0, True, "Porto", "Lyon"), (2, 1, "2019-01-01", 0.0, False, "X", "Y")],
        "player_id int, transfer_id int, d string, fee double, is_loan boolean, from_club string, to_club string",
    ).withColumn("date", F.to_date("d"))
    enriched = {r.player_id: r for r in portfolio.enrich_players(players, tr, ["river", "boca"]).collect()}
    assert (str(enriched[1].since_date), enriched[1].method, enriched[1].first_export_club) == ("2020-06-01", "last_paid_transfer", "Porto")
    assert (enriched[2].method, enriched[3].method) == ("last_transfer", "no_transfers")
    r = portfolio.agency_report(players, tr, ["river", "boca"], F.lit("2026-01-01").cast("date")).first()
    assert (r.n_players, r.n_exported, r.pct_exported, r.total_mv, r.median_mv, r.total_fees_generated, r.n_with_fees) == (3, 1, 33.3, 400.0, 300.0, 50.0, 1)
    assert [x["name"] for x in r.players_top5_mv] == ["b", "a", "c"] and r.avg_age == pytest.approx(31.0, abs=0.1)


def test_audits(spark):
    inc = spark.createDataFrame([(1, 5, "regular", None), (1, 5, "regular", None), (1, 6, "ownGoal", None), (1, 7, "regular", True)], "event_id int, player_id int, class string, rescinded boolean")
    lin = spark.createDataFrame([(1, 5, 1), (1, 7, 1), (1, 8, 0)], "event_id int, player_id int, goals int")
    got = {(r.player_id, r.count_a, r.count_b, r.direction) for r in audit.count_audit(inc, lin, "goals").collect()}
    assert got == {(5, 2, 1, "a_over_b"), (7, 0, 1, "b_over_a")}
    fx = "match_id int, home string, away string, score_home int, score_away int, ordinal int"
    gl = "match_id int, side string, ordinal int, name string, kind string"
    out = audit.name_audit(
        spark.createDataFrame([(1, "club nacional", "danubio", 2, 0, 0), (1, "club nacional", "danubio", 2, 0, 1)], fx), spark.createDataFrame([(70, "nacional", "danubio fc", 2, 0, 0)], fx),
        spark.createDataFrame([(1, "home", 0, "j perez", "regular"), (1, "home", 1, "luis sosa", "owngoal")], gl),
        spark.createDataFrame([(70, "home", 0, "juan perez", "regular"), (70, "home", 1, "otro nombre", "regular")], gl),
    )
    assert [tuple(r) for r in out.collect()] == [(70, "home", "b", 1, "otro nombre")]
    table = audit.corrected_scorers(
        spark.createDataFrame([(1, "a", 3), (2, "b", 2), (3, "c", 0)], "player_id int, name string, goals int"), spark.createDataFrame([(2, "manual", 1, "press")], "player_id int, kind string, delta int, note string")
    )
    assert {r.player_id: (r.corrected, r.place) for r in table.collect()} == {1: (3, 1), 2: (3, 1)}


def test_scorer_totals_of_any_length(spark):
    goals = spark.range(4002).select((F.col("id") % 2).alias("p"), F.col("id").alias("m"))
    out = audit.scorer_totals(goals, ["p"], ["m"]).collect()
    assert {r.total for r in out} == {2001}
    assert sorted((r.p, r.position, r.m) for r in out) == [(p, i + 1, 2 * i + p) for p in range(2) for i in range(2001)]


def test_lineups_and_intake(spark):
    played = spark.createDataFrame([("A", i, 100 - i) for i in range(13)], "team string, player_id int, mins int")
    squads = spark.createDataFrame([("A", i) for i in range(15)], "team string, player_id int")
    got = {r.player_id: (r.status, r.reason) for r in tournament.carry_lineups(played, squads, squads.where("player_id = 0"), spark.createDataFrame([(12, "missing")], "player_id int, status string")).collect()}
    assert got[0] == ("missing", "suspension") and got[12] == ("missing", "manual") and got[10] == ("starter", None) and got[11] == ("sub_in", None) and got[14] == ("rotation", None)
    flat = [(1, 10, 20, i, 100 + i, "n", pos, mins, None, None, 1, 2, 1) for i, (pos, mins) in enumerate([("G", 90), ("D", 90), ("F", 3), ("G", 90), ("M", 30)])]
    rows = tournament.intake_flat(spark.createDataFrame(flat, "event_id int, home_id int, away_id int, ordinal int, player_id int, name string, position string, mins int, xg double, xa double, goals int, shots int, key_passes int"))
    assert {(r.player_id, r.team_id, r.status, r.xg) for r in rows.collect()} == {(100, 10, "starter", 0.5), (101, 10, "starter", 0.5), (103, 20, "starter", 0.5), (104, 20, "sub_in", 0.5)}


def test_form_update_is_idempotent(spark):
    schema = "player_id int, event_id int, ts int, mins int, xg double, xa double, weight double"
    form = spark.createDataFrame([(1, 1, 1, 90, 0.4, 0.1, 1.0), (1, 2, 2, 10, 9.0, 9.0, 1.0)], schema)
    rows = spark.createDataFrame([(1, 3, 3, 90, 1.0, 0.0, 1.0), (1, 1, 1, 90, 7.0, 7.0, 1.0)], schema)
    kept, level = tournament.update_form(form, rows, 3.0)
    again, _ = tournament.update_form(kept, rows, 3.0)
    assert sorted(map(str, kept.select(*form.columns).collect())) == sorted(map(str, again.select(*form.columns).collect()))
    w = [3.0, 0.82**2]  # the ten-minute match keeps its place in the decay
    assert level.first().form_xg_90 == pytest.approx((1.0 * w[0] + 0.4 * w[1]) / sum(w))


def test_best_plan_against_search(spark):
    slots = [("G", 2.0, 5.0, False)] + [("D", 3.0 + i, 4.0, False) for i in range(4)] + [("M", 2.0 + i, 6.0, i == 3) for i in range(4)] + [("F", 4.0, 7.0, False), ("F", 1.0, 3.0, False)]
    pool = [(i, "GDMF"[i % 4], 3.0 + (i * 7 % 11) / 2, 1.0 + (i * 5 % 17) / 3) for i in range(60)]
    squad = spark.createDataFrame([(1, 6.0, slots)], "manager_id int, bank double, slots array<struct<pos: string, xpts: double, price: double, must_sell: boolean>>")
    cands = spark.createDataFrame(pool, "id int, position string, price double, xpts double")
    got = transfers.best_transfers(transfers.keep_plans(squad), cands, ["formation", "keep_set"]).first()
    menu = sorted(pool, key=lambda c: (-c[3], c[0]))
    best = -1.0
    for d, m, f in transfers.FORMATIONS:
        for keep in combinations(range(11), 5):
            kept = [slots[i] for i in keep]
            need = {p: n - sum(s[0] == p for s in kept) for p, n in zip("GDMF", (1, d, m, f))}
            if min(need.values()) < 0 or any(s[3] for s in kept):
                continue
            money = 6.0 + sum(s[2] for i, s in enumerate(slots) if i not in keep)
            total, left = sum(s[1] for s in kept), dict(need)
            for _id, pos, price, x in menu:
                if left[pos] and price <= money:
                    left[pos], money, total = left[pos] - 1, money - price, total + x
            if not any(left.values()):
                best = max(best, total)
    assert got.total == pytest.approx(best)


def test_league_and_cup_projection_by_hand(spark):
    cols = "player_id int, name string, team string, pos string, minutes double, games int, xg double, xa double, shots int, key_passes int, goals int, yellow int, pen_goals int, set_piece boolean, bonus_count int, price double, form_xg_90 double, form_xa_90 double, consistency double, minutes_override double"
    players = spark.createDataFrame([(1, "a", "A", "F", 900.0, 10, 4.0, 1.0, 30, 10, 5, 2, 0, False, 1, 10.0, None, None, 80.0, None), (2, "b", "B", "M", 50.0, 1, 0.1, 0.1, 1, 1, 0, 0, 0, False, 0, 1.0, None, None, None, None)], cols)
    teams = spark.createDataFrame([("A", 1.0, 1.2, 0.9, 0.8, 3.0, 60.0, 4, 0.0, 0.0), ("B", 0.9, 1.0, 1.1, 1.0, 4.0, 40.0, 3, 0.5, 0.2)], "team string, xg_pg double, gf_pg double, gc_pg double, xgc_pg double, sot_pg double, def_score double, fdr int, box_vuln double, wide_vuln double")
    fx = spark.createDataFrame([(7, "A", "B")], "event_id int, home string, away string")
    r = league.project_league(players, fx, teams).collect()
    assert len(r) == 1  # fifty minutes are not enough
    r = r[0]
    xg, xa = 0.4, 0.1
    s = (1 + 10 / 100 * 0.6) * 1.12 * 82 / 90 * 1.0667
    gm, am = 1.0 + 0.5 * 0.10, 1.0 + 0.2 * 0.06  # complete striker
    pg, pa = xg * s * round(gm, 3) * 0.85, xa * s * round(am, 3) * 0.38
    pcs = min(0.6, max(0.03, math.exp(-((0.8 * 0.6 + 0.9 * 0.4) * 0.55 + 0.9 * 0.45) * 0.85)))
    scored = (1.0 * 0.65 + 1.2 * 0.35) * 1.0 / 0.82 * 1.15
    total = pg * 4 + pa * 3 + 82 / 90 * 2 - 0.2 + pg * 0.28 / scored * 3
    assert r.player_type == "complete_striker" and r.p_goal == pytest.approx(pg) and r.p_cs == pytest.approx(pcs)
    bonus = 0.1 * (1 + 0.1 / 0.3 * 2)
    assert r.xpts == pytest.approx(total * (0.94 + 0.12 * 0.8) + bonus, abs=1e-3)

    cup = spark.createDataFrame(
        [(1, "a", "A", "F", 0.9, 0.8, 900.0, 10, 4.0, 1.0, 30, 10, 2, 300.0, 4, 0.5, 0.2, None, None, 0, None)],
        "player_id int, name string, team string, pos string, club_quality double, schedule_quality double, club_mins double, club_games int, club_xg double, club_xa double, shots int, key_passes int, yellow int, intl_mins double, intl_games int, intl_xg double, intl_xa double, form_xg_90 double, form_xa_90 double, form_n int, consistency double",
    )
    prior = spark.createDataFrame([("F", 0.3, 0.1)], "pos string, prior_xg double, prior_xa double")
    lineup = spark.createDataFrame([(7, 1, "starter")], "event_id int, player_id int, status string")
    roles = spark.createDataFrame([(1, "pk_primary")], "player_id int, role string")
    fx = fx.selectExpr("*", "1.5D as lambda_home", "1.1D as lambda_away")
    out = tournament.project_players(cup, fx, teams, prior, lineup, roles, ["A"]).first()
    c, i = 0.4 * 0.9, 0.5 / 300 * 90 * 0.8
    xg = (0.7 * c * 10 + 0.3 * i * 4) / (0.7 * 10 + 0.3 * 4) + 0.12
    eff = 10 + 4 * 0.5
    xr = round(eff / (eff + 8) * xg + 8 / (eff + 8) * 0.3, 4)
    assert out.xg_90 == pytest.approx(xr, abs=1e-4)
    strength_ = (1 + 10 / 100 * 0.5) * 1.15 * 85 / 90
    gm = {"complete_striker": 1.05, "box_striker": 1.07, "pressing_fwd": 1.025, "wide_fwd": 1.01, "poacher": 1.055}[out.player_type]
    assert out.p_goal == pytest.approx(min(0.45, xr * strength_ * gm * 0.55), rel=1e-6)
    assert (out.role, out.p_play) == ("starter", 0.92) and out.p_cs == pytest.approx(math.exp(-1.1))


def test_weighted_matches_and_gates(spark):
    hist = spark.createDataFrame([("A", 1, 2), ("B", 1, 0)], "team string, event_id int, gf int")
    res = spark.createDataFrame([("A", 1, 2, 1), ("A", 9, 3, 2), ("B", 9, 1, 7)], "team string, event_id int, gf int, round_num int")
    got = {(r.team, r.event_id, r.weight) for r in strength.weighted_matches(res, hist, {1: 8, 2: 12}).collect()}
    assert got == {("A", 1, 1), ("B", 1, 1), ("A", 9, 12)}
    p = spark.createDataFrame([(1, 4.0, 0.9, 0.9, "starter", None, 45.0), (2, 4.0, 0.9, 0.9, "starter", None, None)], "id int, xpts double, mins_share double, p_play double, role string, lineup_status string, recent double")
    got = {r.id: r for r in tournament.gate_by_recent_minutes(p, "recent").collect()}
    assert got[1].xpts == pytest.approx(4.0 * (0.5 / 0.9) * (0.6 / 0.9), abs=0.01) and got[1].role == "rotation" and got[2].xpts == 4.0


def test_links_of_any_markup(spark):
    page = """<a href="/1">one</a> <A class="c>d" HREF='/2'>two</A> <a name=x>no</a> <a rel=nofollow href=/3 >three</a> <abbr href="/no">x</abbr> <a data-href="/no" href="/4"><b>four</b></a>"""
    rows = feeds.page_links(spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id int, html string"), ["page_id"]).collect()
    assert [(r.ordinal, r.href, r.name) for r in rows] == [(0, "/1", "one"), (1, "/2", "two"), (2, "/3", "three"), (3, "/4", "<b>four</b>")]


def test_embedded_payload_ends_at_its_brace(spark):
    pages = ['const D = {"k": 1};', 'const D={"k": 2}\n</script>', 'const D = {"k": 3, "s": "a }; b", "o": {"x": 1}}; var e = {};', "const E = {};"]
    rows = feeds.embedded_json(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string"), "D", "struct<k: int, s: string>").collect()
    assert [r.payload and (r.payload.k, r.payload.s) for r in rows] == [(1, None), (2, None), (3, "a }; b"), None]


def test_published_pointer_moves_and_rolls_back(spark, tmp_path):
    root = str(tmp_path)
    for run in ("run9", "run10"):
        sinks.publish(spark.createDataFrame([(run,)], "name string"), root, run)
        assert sinks.latest(spark, root).first().name == run
    sinks.point(spark, root, "run9")
    assert sinks.latest(spark, root).first().name == "run9"


def test_plans_keep_managers_and_skip_owned(spark):
    squads = [(1, 0.0, [("G", 1.0, 1.0, False)] * 11, [1]), (2, 100.0, [("D", 1.0, 1.0, False)] * 13, [])]
    df = spark.createDataFrame(squads, "manager_id int, bank double, slots array<struct<pos: string, xpts: double, price: double, must_sell: boolean>>, owned array<int>")
    plans = transfers.keep_plans(df, keep=3).join(df.select("manager_id", "owned"), "manager_id", "right")
    pool = [(i, "GDMF"[i % 4], 1.0 + i % 3, 50.0 - i) for i in range(40)]
    got = {r.manager_id: r for r in transfers.best_transfers(plans, spark.createDataFrame(pool, "id int, position string, price double, xpts double"), ["manager_id", "formation", "keep_set"]).collect()}
    assert got[1].total is None and got[2].total > 0 and bin(got[2].keep_set).count("1") == 3


def test_tables_leave_no_shuffle_files(spark):
    """Steps of a job do not add up on disk."""
    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*"))
    before, setting = files(), spark.conf.get(session.CLEANUP, "false")
    out = session.durable(spark.range(10_000).repartition(7, "id"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 10_000 and spark.conf.get(session.CLEANUP, "false") == setting


def test_audit_links_before_it_pairs_scorers(spark):
    """Links and goals are written part by part; the last step reads them and links nothing again. Null and repeated keys stay as they are."""
    fx = "match_id int, home string, away string, score_home int, score_away int, ordinal int"
    gl = "match_id int, side string, ordinal int, name string, kind string"
    provider = [(i, f"club{i}x fc", f"rival{i}", i % 3, 0, i) for i in range(40)] + [(None, "club1x", "rival1", 1, 0, 50), (3, "club3x", "rival3", 0, 0, 60)]
    feed = [(100 + i, f"club{i}x", f"rival{i} sc", i % 3 + (i % 5 == 0), 0, i) for i in range(40)] + [(None, "club2x", "rival2", 2, 0, -1)]
    goals = lambda base: [(base + i, "home", n, f"name{n}", "regular") for i in range(40) for n in range(2)] + [(None, "home", 0, "nobody", "regular")]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((provider, fx), (feed, fx), (goals(0), gl), (goals(100)[:-1] + [(101, "home", 9, "other", "regular")] * 2, gl))]
    out = audit.name_audit(*frames)
    assert "score_home" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(101, "home", "b", 9, "other")] * 2


def test_plans_meet_one_slice_at_a_time(spark, monkeypatch):
    """A step sends one slice of the candidates, and plans walk over many slices and parts to the same result."""
    pool = [(i, "GDMF"[i % 4], 5.0 + (i * 7 % 11) - (i > 150) * 4, 300.0 - i) for i in range(200)]
    cands = spark.createDataFrame(pool, "id int, position string, price double, xpts double")
    plans = spark.createDataFrame([(k, 12.0 + k, 0.0, 1, 1, 1, 1, [0, 1, 5]) for k in range(12)], "manager_id int, budget double, keep_points double, need_G int, need_D int, need_M int, need_F int, owned array<int>")
    broadcast, sent = F.broadcast, []
    monkeypatch.setattr(models.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr(models, "buyable", lambda candidates, most: candidates)
    got = {r.manager_id: (r.total, r.money_left, [c["id"] for c in r.chosen or []]) for r in models.best_plan(plans, ["manager_id"], ["manager_id"], cands, list("GDMF"), 40).collect()}
    assert len(sent) > 1 and set(sent) == {1}
    for k in range(12):
        money, left, bought, total = 12.0 + k, dict.fromkeys("GDMF", 1), [], 0.0
        for i, pos, price, x in pool:
            if i not in (0, 1, 5) and left[pos] and price <= money:
                money, left[pos], total = money - price, 0, total + x
                bought.append(i)
        assert got[k] == ((total, money, bought) if not any(left.values()) else (None, None, [])) or (got[k][0] is None and any(left.values()))


def test_swaps_and_plans_send_no_squads_through_the_driver(spark, monkeypatch):
    slot = "array<struct<id: int, pos: string, xpts: double, price: double, must_sell: boolean>>"
    squads = spark.createDataFrame([(1, 6.0, [(7, "G", 1.0, 2.0, False), (8, "D", 1.0, 2.0, False)], [7, 8])], f"manager_id int, bank double, slots {slot}, owned array<int>")
    assert transfers.keep_plans(squads, 1, [(3, 4, 3)], ("owned",)).select("owned").distinct().collect() == [([7, 8],)]
    best = spark.createDataFrame([(1, 1, 3.0, [("D", 9, 2.5)])], "manager_id int, keep_set int, total double, chosen array<struct<position: string, id: int, xpts: double>>")
    plans, swaps = [], transfers.swaps
    monkeypatch.setattr(transfers, "swaps", lambda sold, bought, keys: plans.extend(d._jdf.queryExecution().executedPlan().toString() for d in (sold, bought)) or swaps(sold, bought, keys))
    out = transfers.planned_swaps(session.durable(squads), session.durable(best))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert [(r.sold, r.bought, r.over_replaced) for r in out.collect()] == [(8, 9, 1.5)]


def test_shares_give_each_row_once(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k"), "id")
    assert sorted(r.id for r in session.in_shares(lambda mine: rows.where(mine(F.col("k")))).collect()) == list(range(1000))
