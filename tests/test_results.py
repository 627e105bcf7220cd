"""The source of result files against what was written and the readers of reports."""

import json

import pytest
from pyspark.sql import functions as F

from stipple.sources import reports, results


def load(spark, path, kind, types=None):
    return results.read(spark, str(path), kind, types)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


RECORDS = {"A": {"n_cells": 3, "vmr_curve": [1.5, float("nan"), 2.0], "scales_um": [1.0, 2.0, 4.0], "p_value": 0.01}, "B": {"n_cells": 2, "vmr_curve": [1.0], "skewness_curve": [0.5], "n_mocks_used": 7}}


def test_records_are_those_of_the_plain_reader(spark, tmp_path):
    put(tmp_path / "a.json", RECORDS)
    plain = reports.read_fingerprints(spark, str(tmp_path / "a.json"))
    ours = load(spark, tmp_path, "fingerprints").select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, ours.collect()))
    assert {f.name: f.dataType for f in plain.schema} == {f.name: f.dataType for f in ours.schema}


def test_written_pairs_and_trials_come_back(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "B", [0.1, 0.2], [True, False]), ("A", "C", [0.3, None], [False, False])], "type_a string, type_b string, correlation_curve array<double>, significant_scales array<boolean>")
    reports.write_document(reports.pair_records(pairs).drop("type_a", "type_b"), str(tmp_path / "pairs"), "key")
    got = load(spark, tmp_path / "pairs", "pairs").select(*pairs.columns).orderBy("type_b").collect()
    assert got == pairs.orderBy("type_b").collect()
    trials = spark.createDataFrame([(t, n, 5 + t, [1.0 * t]) for t in range(3) for n in "AB"], "trial long, type string, n_cells long, vmr_curve array<double>")
    reports.write_trials(trials, str(tmp_path / "trials"))
    got = load(spark, tmp_path / "trials", "trials").select(*trials.columns)
    assert sorted(got.collect()) == sorted(trials.collect())
    assert got.where("trial = 1 and type = 'B'").collect() == trials.where("trial = 1 and type = 'B'").collect()


def test_curves_and_reports(spark, tmp_path):
    put(tmp_path / "c" / "nm.json", {"vmr": [1, 2], "scales_nm": [10, 20], "null_mean": [0.5]})
    put(tmp_path / "c" / "um.json", {"vmr": [3], "scales_um": [1, None]})
    rows = load(spark, tmp_path / "c", "curves").orderBy("unit", "place").drop("file", "error").collect()
    assert [tuple(r) for r in rows] == [("nm", 0, 10.0, 1.0, 0.5, None), ("nm", 1, 20.0, 2.0, None, None), ("um", 0, 1.0, 3.0, None, None), ("um", 1, None, None, None, None)]
    put(tmp_path / "r" / "a.json", {"analysis": "x", "results": {"A": {"n": 1}, "B": {"n": 2}}})
    put(tmp_path / "r" / "b.json", {"analysis": "y", "results": [{"n": 3}]})
    rows = load(spark, tmp_path / "r", "report").orderBy("file", "key").drop("file", "error").collect()
    assert [tuple(map(lambda v: v and (json.loads(v) if v[0] == "{" else v), r)) for r in rows] == [({"analysis": "x"}, "A", {"n": 1}), ({"analysis": "x"}, "B", {"n": 2}), ({"analysis": "y"}, None, {"n": 3})]


BAD = {"cut.json": '{"A": {"n_cells": 3, "vmr', "empty.json": "", "list.json": "[1, 2]", "flat.json": '{"A": 1}', "binary.json": "\x00\x01", "deep.json": "[" * 100_000}


@pytest.mark.parametrize("kind", ["fingerprints", "pairs", "trials", "curves", "report"])
def test_bad_files_are_rows_and_lose_no_others(spark, tmp_path, kind):
    for name, text in BAD.items():
        put(tmp_path / name, text)
    good = {"fingerprints": RECORDS, "pairs": {"A__x__B": {}}, "trials": [RECORDS], "curves": {"vmr": [1.0], "scales_um": [1.0]}, "report": {"results": [{"n": 1}]}}[kind]
    put(tmp_path / "good.json", good)
    rows = load(spark, tmp_path, kind)
    bad = rows.where("error is not null").select("file").collect()
    assert sorted(r.file.rpartition("/")[2] for r in bad) == sorted(BAD)
    assert rows.where("error is null").count() == (2 if kind in ("fingerprints", "trials") else 1)
    if kind in ("fingerprints", "trials"):
        assert rows.where("type = 'A'").count() == 1


def test_a_file_that_turns_bad_half_way_gives_its_error_alone(spark, tmp_path):
    put(tmp_path / "a.json", {"A__x__B": {"peak_correlation": 1.0}, "C": {}})
    rows = load(spark, tmp_path, "pairs").collect()
    assert len(rows) == 1 and "no pair of types: C" in rows[0].error
    put(tmp_path / "t" / "t.json", [{"A": {}}, {"A": 1}])
    trials = load(spark, tmp_path / "t", "trials")
    assert trials.where("trial = 0").count() == 0 and trials.where("error is not null").count() == 1


def test_values_of_other_types_are_null(spark, tmp_path):
    put(tmp_path / "a.json", {"A": {"n_cells": "3", "vmr_curve": [1, "x", True, None], "p_value": True, "chi_squared": 1e400, "n_mocks_used": 2.5, "scales_um": 7}})
    r = load(spark, tmp_path, "fingerprints").first()
    assert (r.n_cells, r.vmr_curve, r.p_value, r.chi_squared, r.n_mocks_used, r.scales_um) == (None, [1.0, None, None, None], None, None, None, None)


def test_inventory_hidden_files_and_patterns(spark, tmp_path):
    put(tmp_path / "a" / "f.json", RECORDS)
    put(tmp_path / "a" / "_SUCCESS", "")
    put(tmp_path / "a" / ".f.crc", "x")
    put(tmp_path / "a" / "_temporary" / "0" / "f.json", RECORDS)
    put(tmp_path / "b" / "t.json", [RECORDS, {}])
    put(tmp_path / "b" / "cut.txt", '{"A"')
    rows = load(spark, tmp_path, "files").orderBy("file").collect()
    assert [(r.file.rpartition("/")[2], r.kind, r.records, r.error is None) for r in rows] == [("f.json", "fingerprints", 2, True), ("cut.txt", None, None, False), ("t.json", "trials", 2, True)]
    assert all(r.bytes for r in rows)
    for pattern, n in (("*/*.json", 2), ("a", 1), ("[b]/*", 2), ("?/f.json", 1), ("*", 3), ("*/x", 0)):
        assert load(spark, tmp_path / pattern, "files").count() == n, pattern
    assert load(spark, f"file:{tmp_path}/a/f.json", "files").count() == 1


def test_nothing_there(spark, tmp_path):
    (tmp_path / "none").mkdir()
    put(tmp_path / "o" / "a.json", "{}")
    assert load(spark, tmp_path / "none", "fingerprints").count() == 0
    assert load(spark, tmp_path / "o", "fingerprints").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        load(spark, tmp_path / "missing", "fingerprints").count()
    with pytest.raises(Exception, match="kind must be one of"):
        load(spark, tmp_path, "figures").count()


def test_types_that_are_wanted(spark, tmp_path):
    put(tmp_path / "f" / "a.json", RECORDS)
    put(tmp_path / "f" / "cut.json", BAD["cut.json"])
    put(tmp_path / "t" / "t.json", [RECORDS, {"B": {}}])
    put(tmp_path / "p" / "p.json", {"A__x__B": {}, "B__x__C": {}, "C__x__D": {}})
    named = lambda kind, types: sorted((r.asDict().get("type") or r.asDict().get("type_a") or "bad") for r in load(spark, tmp_path / kind[0], kind, types).collect())
    assert named("fingerprints", ["A", "C"]) == ["A", "bad"] and named("fingerprints", []) == ["bad"]
    assert named("trials", ["B"]) == ["B", "B"]
    assert named("pairs", ["B"]) == ["A", "B"] and named("pairs", ["A", "D"]) == ["A", "C"]
    results.register(spark)
    assert spark.read.format("stipple_results").option("types", '["A"]').load(str(tmp_path / "f")).where("error is null").count() == 1


def test_uses_of_one_table_do_not_disturb_each_other(spark, tmp_path):
    for name in "ab":
        put(tmp_path / f"{name}.json", RECORDS)
    rows = load(spark, tmp_path, "fingerprints")
    first = str(tmp_path / "a.json")
    for condition, n in (("type = 'A'", 2), ("type = 'A' or n_cells = 2", 4), ("type = 'B' and type = 'A'", 0), ("type is null", 0), (f"file = '{first}'", 2), ("true", 4)):
        assert rows.where(condition).count() == n, condition
    a, b = rows.where("type = 'A'").select("file"), rows.where("type = 'B'").select("file")
    assert a.join(b, "file").count() == 2 and a.unionAll(b).count() == 4
    assert rows.rdd.getNumPartitions() == 2
