"""Readings under locked headers, in batch and as a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioworks.operators import readings as rd
from folioworks.plans.telemetry import column_codes, take_in
from folioworks.sources.status import HINT_SCHEMA, no_hints, read_status
from folioworks.streaming import TelemetryTables, run_telemetry
from folioworks.streaming.telemetry import append_batch

from fixtures import poll, write_status

FIRST = [
    poll("p1", "d1", "2024-01-01T00:00:00", ("temp_current", 215), ("humidity", 60), ("on", True)),
    poll("p2", "d2", "2024-01-01T00:00:00", ("humidity", 50)),
    poll("p3", "d1", "2024-01-01T01:00:00", ("temp_current", -7), ("humidity", 61), ("temp_current", 33)),
]
SECOND = [
    poll("p4", "d1", "2024-01-02T00:00:00", ("humidity", 62), ("wind", 5), ("Alpha", "x")),
    poll("p5", "d2", "2024-01-02T00:00:00", ("temp_current", 9)),
    poll("p6", "d2", "2024-01-02T00:00:00", ("timestamp", "oops"), ("humidity", 1.5)),
    poll("p7", "d1", "2024-01-02T02:00:00"),
    {"poll_id": "p8", "device_id": "d1", "polled_at": "2024-01-02T03:00:00", "success": False,
     "code": 1106, "msg": "no"},
    {"poll_id": "p9", "device_id": "d1", "polled_at": "2024-01-02T04:00:00", "code": 5, "msg": "?"},
    poll("pa", "d3", "2024-01-02T05:00:00", ("b", 1), ("B", 2), ("a", 3)),
]


def landed(spark, tmp_path, responses):
    write_status(tmp_path / "in", "one", responses)
    return read_status(spark, str(tmp_path / "in"))


def known_hints(spark):
    return spark.createDataFrame([(1106, "no permission: ask the owner"), (7, "x")], HINT_SCHEMA)


def values(df, codes):
    rows = df.select("poll_id", *[F.to_json(F.col(c)).alias(c) for c in codes]).collect()
    return {
        r.poll_id: tuple(None if r[c] is None else json.loads(r[c]) for c in codes) for r in rows
    }


def test_gate_guard_and_errors(spark, tmp_path):
    intake = take_in(landed(spark, tmp_path, FIRST + SECOND), known_hints(spark), "Falha")
    assert [r.poll_id for r in intake.empty.collect()] == ["p7"]
    got = {r.poll_id: r.message for r in intake.errors.collect()}
    assert got["p9"] == "Falha (code=5): ?"
    assert got["p8"].startswith("Falha (code=1106): no\nDica: no permission")
    assert intake.readings.select("poll_id").distinct().count() == 7
    bare = take_in(landed(spark, tmp_path, SECOND), no_hints(spark), "Falha").errors.collect()
    assert {r.message for r in bare} == {"Falha (code=5): ?", "Falha (code=1106): no"}


def test_headers_follow_the_first_poll(spark, tmp_path):
    intake = take_in(landed(spark, tmp_path, FIRST + SECOND), known_hints(spark), "x")
    got = {r.device_id: r.codes for r in rd.derive_headers(intake.readings).collect()}
    assert got == {"d1": ["humidity", "on", "temp_current"], "d2": ["humidity"], "d3": ["B", "a", "b"]}


def test_last_value_of_a_repeated_code(spark, tmp_path):
    readings = take_in(landed(spark, tmp_path, FIRST), known_hints(spark), "x").readings
    got = rd.last_per_code(readings).filter("poll_id = 'p3' and code = 'temp_current'").collect()
    assert [(r.pos, r.value.toPython()) for r in got] == [(2, 3.3)]


def test_one_map_per_poll(spark):
    rows = [("d", "p", 0, "a", 1), ("d", "p", 3, "b", 2), ("d", "p", 2, "a", 3), ("d", "p", 4, None, 4), ("d", "p", 5, "c", None),
            ("d", "q", 0, None, 5), ("e", "p", 1, "a", None), ("e", "p", 0, "a", 6)]
    readings = spark.createDataFrame(rows, "device_id string, poll_id string, pos int, code string, value int").withColumn(
        "polled_at", F.lit("2024-01-01").cast("timestamp_ntz")).repartition(3)
    got = {(r.device_id, r.poll_id): r["values"] for r in rd.poll_maps(readings).collect()}
    assert got == {("d", "p"): {"a": 3, "b": 2, "c": None}, ("d", "q"): {}, ("e", "p"): {"a": None}}
    wide = {(r.device_id, r.poll_id): (r.a, r.b, r.z) for r in rd.to_wide(readings, ["a", "b", "z"]).collect()}
    assert wide == {("d", "p"): (3, 2, None), ("d", "q"): (None, None, None), ("e", "p"): (None, None, None)}
    plan = rd.to_wide(readings, [f"c{k}" for k in range(50)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "max_by" not in plan


CODES = ("humidity", "on", "temp_current")
EXPECTED = {
    "p1": (60, True, 21.5), "p2": (50, None, None), "p3": (61, None, 3.3), "p4": (62, None, None),
    "p5": (None, None, None), "p6": (1.5, None, None),
}
DRIFT = {"p4": ["Alpha", "wind"], "p5": ["temp_current"], "p6": ["timestamp"]}


def test_locked_columns_and_drift(spark, tmp_path):
    polls = FIRST + SECOND[:-1]
    readings = take_in(landed(spark, tmp_path, polls), known_hints(spark), "x").readings
    headers = rd.derive_headers(readings)
    assert column_codes(headers) == list(CODES)
    locked = rd.lock_columns(readings, headers, CODES)
    assert values(locked, CODES) == EXPECTED
    assert locked.filter("poll_id = 'p1'").first()["timestamp"] == "2024-01-01 00:00:00"
    assert {r.poll_id: r.new_codes for r in rd.drift(readings, headers).collect()} == DRIFT


def test_stream_equals_batch_and_keeps_headers(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    check = str(tmp_path / "check")
    write_status(source, "one", FIRST)
    run_telemetry(spark, source, target, check)
    write_status(source, "two", SECOND[:-1])
    tables = run_telemetry(spark, source, target, check)
    assert values(tables.rows(spark), CODES) == EXPECTED
    drift = spark.read.parquet(tables.path("drift")).collect()
    assert {r.poll_id: r.new_codes for r in drift} == DRIFT
    assert {r.device_id for r in tables.headers(spark).collect()} == {"d1", "d2"}
    assert spark.read.parquet(tables.path("errors")).count() == 2
    run_telemetry(spark, source, target, check)
    assert tables.rows(spark).count() == 6


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    tables = TelemetryTables(str(tmp_path / "out"))
    hints = known_hints(spark)
    first = landed(spark, tmp_path, FIRST)
    append_batch(first, 0, tables, hints)
    append_batch(first, 0, tables, hints)
    write_status(tmp_path / "later", "two", SECOND[:-1])
    second = read_status(spark, str(tmp_path / "later"))
    append_batch(second, 1, tables, hints)
    append_batch(second, 1, tables, hints)
    assert values(tables.rows(spark), CODES) == EXPECTED
    assert tables.headers(spark).count() == 2


def test_too_many_columns_are_refused(spark):
    headers = spark.createDataFrame([("d", ["a", "b", "c"])], "device_id string, codes array<string>")
    old = spark.conf.get("spark.sql.pivotMaxValues")
    try:
        spark.conf.set("spark.sql.pivotMaxValues", 2)
        with pytest.raises(ValueError):
            column_codes(headers)
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)


def test_a_new_checkpoint_adds_to_the_tables(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write_status(source, "one", FIRST)
    run_telemetry(spark, source, target, str(tmp_path / "check1"))
    later = str(tmp_path / "in2")
    write_status(later, "two", SECOND[:-1])
    tables = run_telemetry(spark, later, target, str(tmp_path / "check2"))
    assert values(tables.rows(spark), CODES) == EXPECTED
    drift = spark.read.parquet(tables.path("drift")).collect()
    assert {r.poll_id: r.new_codes for r in drift} == DRIFT
    assert tables.headers(spark).count() == 2
