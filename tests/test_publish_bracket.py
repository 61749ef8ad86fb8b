"""Publishing by several writers, and brackets of any shape."""
from concurrent.futures import ThreadPoolExecutor

import pytest

from touchline.plans import bracket
from touchline.sources import markers, sinks


def one(spark, name):
    return spark.createDataFrame([(name,)], "name string").coalesce(1)


def test_two_publishers_leave_both_runs_and_one_winner(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: sinks.publish(one(spark, f"run{k}"), root, f"run{k}"), range(2)))
    assert {spark.read.parquet(f"{root}/runs/run{k}").first().name for k in range(2)} == {"run0", "run1"}
    log = {r.number: r.text for r in markers.markers(spark, f"{root}/pointer").collect()}
    assert sorted(log) == [1, 2] and sorted(log.values()) == ["run0", "run1"]
    assert sinks.latest(spark, root).first().name == log[2]


def test_a_number_is_created_once(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: markers.create_new(spark, f"{tmp_path}/x", f"writer {k}"), range(4)))
    assert sum(made) == 1


def test_a_publisher_that_dies_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish(one(spark, "first"), root, "first")
    one(spark, "second").write.parquet(f"{root}/runs/second")  # died before it moved the pointer
    assert sinks.latest(spark, root).first().name == "first"
    markers.create_new(spark, f"{root}/pointer/{2:0{markers.WIDTH}d}", "")  # died between creating and writing the marker
    assert sinks.latest(spark, root).first().name == "first"
    assert sinks.point(spark, root, "second") == 3
    assert sinks.latest(spark, root).first().name == "second"


def test_the_pointer_moves_only_from_what_was_seen(spark, tmp_path):
    root = str(tmp_path)
    for run in ("a", "b"):
        one(spark, run).write.parquet(f"{root}/runs/{run}")
    sinks.point(spark, root, "a", check=True)
    with pytest.raises(ValueError):
        sinks.point(spark, root, "b", expected="c", check=True)
    assert sinks.latest(spark, root).first().name == "a"
    sinks.point(spark, root, "b", expected="a", check=True)
    assert sinks.latest(spark, root).first().name == "b"


@pytest.fixture
def play(spark):
    """Project a bracket in which the team of the smaller number is stronger."""
    teams = [f"t{i:02d}" for i in range(1, 30)]
    strengths = spark.createDataFrame([(t, 3.0 - i / 10, 1.0) for i, t in enumerate(teams)], "team string, alpha double, beta double")
    form = spark.createDataFrame([(t, 1.0, 1.0) for t in teams], "team string, att_mult double, def_mult double")

    def run(first, edges, results=()):
        f = spark.createDataFrame(first, "event_id long, home string, away string")
        e = bracket.ladder(f) if edges is None else spark.createDataFrame(edges, "event_id long, from_a long, from_b long")
        r = spark.createDataFrame(list(results), "pair string, res_home string, res_away string, res_score_home int, res_score_away int, pens string")
        return {x.event_id: (x["round"], x.home, x.away, x.winner, x.confirmed) for x in bracket.project_bracket(f, e, strengths, form, r, []).collect()}

    return run


def test_bracket_with_an_odd_one_out(play):
    first = [(i, f"t{2 * i:02d}", f"t{2 * i + 1:02d}") for i in range(1, 6)]
    got = play(first, None)
    assert [got[i][3] for i in range(1, 6)] == ["t02", "t04", "t06", "t08", "t10"]
    assert got[6][:4] == (2, "t02", "t04", "t02") and got[8][:4] == (2, "t10", None, "t10")
    assert got[10][:4] == (3, "t10", None, "t10") and got[11][:4] == (4, "t02", "t10", "t02") and len(got) == 11


def test_bracket_of_uneven_depth_and_results(play):
    first = [(1, "t01", "t02"), (2, "t03", "t04"), (3, "t05", None)]
    result = [("t01|t02", "t02", "t01", 2, 0, None), ("t02|t03", "t02", "t03", 1, 1, "away")]
    got = play(first, [(10, 1, 2), (20, 10, 3)], result)
    assert got[1] == (1, "t01", "t02", "t02", True)
    assert got[10] == (2, "t02", "t03", "t03", True)
    assert got[20][:4] == (3, "t03", "t05", "t03")


def test_bracket_edges_in_a_circle(play):
    with pytest.raises(ValueError):
        play([(1, "t01", "t02")], [(2, 3, 1), (3, 2, 1)])
