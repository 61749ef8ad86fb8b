import json
import random

import pytest

from touchline.sources import keyed


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_is_read_in_ranges(spark, tmp_path, small_ranges, indent):
    rng = random.Random(1)
    notes = ["plain", "a } b", "{{", '"quoted" }', "back\\slash\\", "\\", "", "é } ü", '\\"}', "x" * 900]
    data = {f"key {i} }}": {"n": i, "note": rng.choice(notes), "list": [{"x": j, "s": rng.choice(notes)} for j in range(rng.randrange(4))]} for i in range(120)}
    (tmp_path / "a.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.json").write_text(json.dumps({"only": {"n": -1, "note": None, "list": []}}))
    path = str(tmp_path / "*.json")
    assert keyed.pieces(spark, path).select("_file", "_start").distinct().count() > 10
    rows = keyed.read_keyed_ranges(spark, path, "key", "struct<n: int, note: string, list: array<struct<x: int, s: string>>>").collect()
    got = {r["key"]: {"n": r.n, "note": r.note, "list": [x.asDict() for x in r.list]} for r in rows}
    assert got == {**data, "only": {"n": -1, "note": None, "list": []}} and len(rows) == len(data) + 1
