"""Reading, merging, importing, exporting."""

import json

from tidemark.schema import REPORTS
from tidemark.sources import sinks, tables


def _rows(spark, rows):
    return spark.createDataFrame(rows, "mmsi long, name string, ship_type string, length double, width double")


def test_two_merges_in_a_row(spark, tmp_path):
    path = str(tmp_path / "ships")
    sinks.upsert(spark, path, _rows(spark, [(1, "A", "", 1.0, 1.0), (2, "B", "", 1.0, 1.0)]), sinks.SHIP_KEY)
    for n, name in ((2, "B2"), (3, "C")):
        sinks.upsert(spark, path, _rows(spark, [(n, name, "", 2.0, 2.0)]), sinks.SHIP_KEY)
    out = tables.read_ships(spark, path)
    assert out.columns == ["mmsi", "name", "ship_type", "length", "width"]
    assert {r["mmsi"]: r["name"] for r in out.collect()} == {1: "A", 2: "B2", 3: "C"}
    assert [p.name for p in tmp_path.iterdir()] == ["ships"]


def test_imports(spark, tmp_path):
    csv = tmp_path / "ships.csv"
    csv.write_text("﻿mmsi,name,length\n1.0,A,10\n,B,1\n2,,1\n3,C,x\n", encoding="utf-8")
    sinks.import_ships(spark, str(csv), str(tmp_path / "s"))
    assert {(r["mmsi"], r["length"], r["width"]) for r in tables.read_ships(spark, str(tmp_path / "s")).collect()} == {(1, 10.0, 0.0), (3, 0.0, 0.0)}
    points = [{"mmsi": 1, "timestamp": "2024-06-01T00:00:00", "longitude": 122.0, "latitude": 30.5, "speed": 3}, {"mmsi": 1, "timestamp": 1717200060, "longitude": 122.0, "latitude": 99.0}]
    file = tmp_path / "points.json"
    file.write_text(json.dumps(points))
    for _ in range(2):
        report = {r["item"]: r["n"] for r in sinks.import_reports(spark, str(file), str(tmp_path / "r")).collect()}
        assert report["bounds"] == 1 and report["kept"] == 1
    assert tables.read_reports(spark, str(tmp_path / "r")).count() == 1


def test_export(spark, data, tmp_path):
    rows = tables.reports(spark, data).select(REPORTS.names)
    sinks.export_csv(rows, str(tmp_path / "out"), limit=7)
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert back.count() == 7 and back.columns == REPORTS.names
