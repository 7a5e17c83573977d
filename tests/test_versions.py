"""The versioned table: readers, two writers, crashes at each step, streams into it."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks, tables
from tidemark.sources.versions import LOG, Conflict, Table
from tidemark.streaming import windows

SHIP = "mmsi long, name string, ship_type string, length double, width double"


def _ships(spark, *rows):
    return spark.createDataFrame([(m, n, "", 1.0, 1.0) for m, n in rows], SHIP)


def _names(df):
    return {r["mmsi"]: r["name"] for r in df.collect()}


def test_readers_keep_what_they_began_to_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Table(spark, path)
    assert table.version() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert sinks.upsert(spark, path, _ships(spark, (1, "a"), (1, "again")), sinks.SHIP_KEY) == 1
    before = table.read()
    assert before.count() == 2  # the first rows stay as they come
    sinks.upsert(spark, path, _ships(spark, (1, "b"), (2, "c")), sinks.SHIP_KEY)
    assert before.count() == 2 and _names(tables.read_ships(spark, path)) == {1: "b", 2: "c"} and table.read(1).count() == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, _ships(spark, (0, "first")), sinks.SHIP_KEY)
    table = Table(spark, path)
    table.commit(_ships(spark, (0, "x")), 1)
    with pytest.raises(Conflict):
        table.commit(_ships(spark, (0, "y")), 1)
    assert sum(p.name.startswith("data-") for p in (tmp_path / "t").iterdir()) == 2
    threads = [threading.Thread(target=sinks.upsert, args=(spark, path, _ships(spark, (k, f"n{k}")), sinks.SHIP_KEY)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert _names(table.read()) == {0: "x"} | {k: f"n{k}" for k in range(1, 5)} and table.version() == 6


@pytest.mark.parametrize("way", ["_link", "_rename"])
def test_a_log_entry_is_never_replaced(spark, tmp_path, monkeypatch, way):
    table = Table(spark, str(tmp_path / "t"))
    monkeypatch.setattr(table, "_link", getattr(table, way))
    table._publish(1, "one")
    with pytest.raises(Conflict):
        table._publish(1, "two")
    log = tmp_path / "t" / LOG
    assert (log / f"{1:020d}.json").read_text() == "one" and not [p for p in log.iterdir() if p.name.endswith(".tmp")]


@pytest.mark.parametrize("step", ["_publish", "_link"])
def test_a_dead_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, _ships(spark, (1, "a")), sinks.SHIP_KEY)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Table, step, dies)
        sinks.upsert(spark, path, _ships(spark, (1, "b")), sinks.SHIP_KEY)
    table = Table(spark, path)
    assert table.version() == 1 and _names(table.read()) == {1: "a"}
    sinks.upsert(spark, path, _ships(spark, (2, "c")), sinks.SHIP_KEY)
    assert _names(table.read()) == {1: "a", 2: "c"}
    table.vacuum(keep=1)
    assert _names(table.read()) == {1: "a", 2: "c"}
    assert sum(p.name.startswith("data-") for p in (tmp_path / "t").iterdir()) == 1


def test_a_plain_folder_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    _ships(spark, (1, "a"), (2, "b")).write.parquet(path)
    table = Table(spark, path)
    assert table.version() == 0 and _names(tables.read_ships(spark, path)) == {1: "a", 2: "b"}
    with pytest.raises(ValueError):
        table.add(_ships(spark, (3, "c")))
    sinks.upsert(spark, path, _ships(spark, (2, "B")), sinks.SHIP_KEY)
    assert _names(tables.read_ships(spark, path)) == {1: "a", 2: "B"}
    table.vacuum()
    assert _names(tables.read_ships(spark, path)) == {1: "a", 2: "B"} and not list((tmp_path / "t").glob("part-*"))


def _reports(spark, *rows):
    at = lambda k: datetime.datetime(2024, 6, 1) + datetime.timedelta(minutes=k)
    return spark.createDataFrame([(m, at(t), float(x), 1.0, 5.0) for m, t, x in rows], "mmsi long, timestamp timestamp_ntz, longitude double, latitude double, speed double")


def _run(spark, source, schema, make, **how):
    q = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).trigger(availableNow=True)
    for k, v in how.items():
        q = q.option(k, v)
    q = q.start()
    q.awaitTermination()
    return q


def test_latest_positions_with_late_batches_and_a_restart(spark, tmp_path):
    source, path, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    batches = [[(1, 5, 5), (1, 4, 4), (2, 1, 1)], [(1, 3, 3), (2, 2, 2), (3, 0, 0)], [(3, 0, 0.5), (1, 1, 9)], [(2, 9, 9), (2, 9, 8)], [(4, 1, 1)]]
    sizes = []

    def make(stream):
        sink = windows.latest_sink(path, fold_after=3)

        def write(batch, number):
            sizes.append(batch.count())
            sink(batch, number)

        return windows.latest_updates(stream).writeStream.outputMode("update").foreachBatch(write)

    for k, rows in enumerate(batches):
        frame = _reports(spark, *rows)
        frame.coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3, 4):
            _run(spark, source, frame.schema, make, checkpointLocation=done)
    got = {(r["mmsi"], r["longitude"]) for r in windows.latest_positions(spark, path).collect()}
    assert got == {(1, 5.0), (2, 9.0), (3, 0.5), (4, 1.0)}
    assert sum(sizes) == 2 + 2 + 1 + 1 + 1  # reports that are older than the state go no further
    table = Table(spark, path)
    assert len(table.entry(table.version())["data"]) < 3
    # the batch that was last committed comes again
    assert table.add(_reports(spark, (1, 99, 99)).withColumn("_batch", F.lit(0).cast("long")), ("latest", 0)) is None


def test_repeats_go_across_a_restart(spark, tmp_path):
    source, done, out = (str(tmp_path / x) for x in ("in", "done", "out"))
    first = [(m, t, m + t) for m in range(3) for t in range(10)]
    for rows in (first + first[:7], first[5:] + [(7, 9, 1), (7, 9, 2)]):
        frame = _reports(spark, *rows)
        frame.coalesce(1).write.mode("append").parquet(source)
        _run(spark, source, frame.schema, lambda s: windows.deduplicated(s, "30 minutes").writeStream.format("parquet"), checkpointLocation=done, path=out)
    got = [tuple(r) for r in spark.read.parquet(out).select("mmsi", F.minute("timestamp")).collect()]
    assert sorted(got) == sorted({(m, t) for m, t, _ in first} | {(7, 9)})


def test_trips_as_a_stream_across_a_restart(spark, tmp_path):
    source, done, out = (str(tmp_path / x) for x in ("in", "done", "out"))
    parts = [[(1, 0, 0), (1, 5, 0), (2, 3, 0)], [(1, 12, 0), (1, 40, 0), (2, 4, 0)], [(1, 45, 0), (2, 60, 0)], [(9, 300, 0)], [(9, 600, 0)]]
    for k, rows in enumerate(parts):
        frame = _reports(spark, *rows)
        frame.coalesce(1).write.mode("append").parquet(source)
        if k in (1, 4):
            _run(spark, source, frame.schema, lambda s: windows.trips(s).writeStream.format("parquet").outputMode("append"), checkpointLocation=done, path=out)
    whole = windows.trips(spark.read.parquet(source)).where("mmsi < 9")
    got = spark.read.parquet(out).where("mmsi < 9")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 4
