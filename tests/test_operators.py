"""Geometry, rules and invariants on small inputs."""

import collections
import datetime
import itertools
import math
from functools import reduce

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import Box, Query, effective_box, parse_time
from tidemark.functions import geo
from tidemark.functions.quantile import with_percentile
from tidemark.operators import cleaning, interaction, kde, meeting, metrics, rot, store, traffic
from tidemark.plans import registry
from tidemark.ranges import in_range
from tidemark.sources import generator, tables
from tidemark.streaming import windows


def _reports(spark, rows):
    return spark.createDataFrame(rows, "mmsi long, timestamp string, longitude double, latitude double, speed double, course double").withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "ship_type": F.lit("bulk"), "name": F.lit("A")})


@pytest.mark.parametrize("d, want", [(-340, 20), (340, -20), (0, 0), (20, 20), (-20, -20), (179, 179), (-179, -179), (180, -180), (-180, -180)])
def test_wrap(spark, d, want):
    assert spark.range(1).select(geo.wrap_deg(F.lit(float(d)))).first()[0] == pytest.approx(want)


def test_colregs_cases(spark):
    cases = [
        (0, 0, 12, 5, "overtaking", "give way"), (180, 0, 5, 12, "overtaking", "stand on"), (90, 5, 15, 5, "overtaking", "give way"), (90, 5, 5, 15, "overtaking", "stand on"),
        (10, 170, 5, 5, "head-on", "both give way"), (45, 90, 5, 5, "crossing", "give way"), (225, 90, 5, 5, "crossing", "stand on"),
    ]
    df = spark.createDataFrame([tuple(map(float, c[:4])) + c[4:] for c in cases], "rb double, hd double, a double, b double, s string, r string")
    situation, duty = geo.colregs(*(F.col(c) for c in ("rb", "hd", "a", "b")))
    assert df.where((situation != F.col("s")) | (duty != F.col("r"))).count() == 0


def test_colregs_sweep(spark):
    df = spark.range(360).select(F.col("id").cast("double").alias("rb"), F.explode(F.array(*(F.lit(float(x)) for x in (0, 30, 60, 90, 120, 150, 170, 180)))).alias("hd"))
    situation, _ = geo.colregs(F.col("rb"), F.col("hd"), F.lit(10.0), F.lit(9.0))
    other = df.where(situation == "other")
    assert {r["rb"] for r in other.collect()} <= {0.0, 180.0}
    assert other.count() < 0.01 * df.count()


def test_crossing_sign(spark):
    def sign(track, barrier):
        (a, b), (c, d) = track
        return spark.range(1).select(geo.crossing_sign(*(F.lit(float(x)) for x in (a, b, c, d)), barrier)).first()[0]

    assert sign(((-1, 0.5), (1, 0.5)), ((0.0, 0.0), (0.0, 1.0))) == -sign(((1, 0.5), (-1, 0.5)), ((0.0, 0.0), (0.0, 1.0))) != 0
    assert sign(((0, 0), (1, 0)), ((0.0, 1.0), (1.0, 1.0))) == 0


def _kept(points, tolerance):
    """Places of the points that stay: the ends, and what the halves at the farthest point keep if that is farther than the tolerance."""

    def far(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        length = math.dist(a, b)
        return abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / length if length >= 1e-12 else -1.0

    def inner(low, high):
        where = max(range(low + 1, high), key=lambda k: far(points[k], points[low], points[high]), default=None)
        if where is None or far(points[where], points[low], points[high]) <= tolerance:
            return set()
        return {where} | inner(low, where) | inner(where, high)

    return {0, len(points) - 1} | inner(0, len(points) - 1)


def test_simplified_small_tracks(spark):
    tracks = {1: ([(0, 0), (0.001, 0.0001), (0.002, 0), (0.003, -0.0001), (0.004, 0)], 0.0005, [0, 4]), 2: ([(0, 0), (1, 0), (1, 1)], 0.01, [0, 1, 2]), 3: ([(0, 0), (1, 0), (1, 1), (0, 0)], 0.01, [0, 3])}
    for points, tolerance, want in tracks.values():
        points = [tuple(map(float, p)) for p in points]
        rows = _reports(spark, [(1, f"2024-06-01 00:00:{k:02d}", *p, 0.0, 0.0) for k, p in enumerate(points)])
        assert sorted(r["timestamp"].second for r in traffic.simplified(rows, tolerance).collect()) == want == sorted(_kept(points, tolerance))


def test_section_totals_reconcile(spark, data):
    found = traffic.crossings(tables.reports(spark, data))
    t = traffic.section_totals(found).first()
    assert t["seaward"] + t["landward"] == t["total"] == sum(r["n"] for r in traffic.section_hourly(found).collect())


def test_kernel():
    k = kde.gaussian(2.0)
    assert len(k) % 2 == 1 and k == k[::-1] and sum(k) == pytest.approx(1.0)
    assert kde.gaussian(0) == [1.0]


@pytest.mark.parametrize("bad", [{"bandwidth": 0}, {"box": Box(122, 30, 121, 31)}, {"bin_size": 0}])
def test_kde_guards(bad):
    with pytest.raises(ValueError):
        kde.Raster(**bad)


def test_kde_against_numpy(spark, data):
    raster = kde.Raster(box=Box(121.8, 30.2, 122.6, 31.0), bandwidth=0.05, grid=40)
    rows = tables.reports(spark, data)
    p = rows.where(raster.box.contains()).select("longitude", "latitude").toPandas()
    b = raster.box
    counts = np.histogram2d(p.longitude, p.latitude, bins=(raster.nx, raster.ny), range=((b.west, b.east), (b.south, b.north)))[0]
    k = np.array(raster.kernel)
    r = len(k) // 2
    pad = np.pad(counts, r)
    smooth = sum(w * pad[i : i + raster.nx, :] for i, w in enumerate(k))
    smooth = sum(w * smooth[:, i : i + raster.ny] for i, w in enumerate(k)) / raster.bin_nm2
    got = np.zeros_like(counts)
    for x in kde.density(rows, raster).collect():
        got[x["ix"], x["iy"]] = x["density"]
    assert np.allclose(got, smooth)


def test_wider_kernel_lowers_the_peak(spark, data):
    rows = tables.reports(spark, data)
    low, high = (kde.summary(rows, kde.Raster(bandwidth=w, bin_size=0.01, grid=40)).first() for w in (0.08, 0.01))
    assert low["bin_peak"] < high["bin_peak"] and low["points"] > high["points"]


def test_scorecard_has_twelve_rows(spark, data):
    rows = {r["indicator"]: r["value"] for r in metrics.scorecard(tables.reports(spark, data), kde.Raster(bandwidth=0.1, grid=20)).collect()}
    assert len(rows) == 12 and 0 <= rows["flow_balance"] <= 1 and rows["max_density_nm2"] >= rows["avg_density_nm2"]


def test_near_pairs_equal_all_pairs(spark, data):
    reps = interaction.representatives(tables.reports(spark, data))
    lat0 = interaction.mean_latitude(reps).first()[0]
    key = ["bucket", "own_mmsi", "target_mmsi"]
    for radius in (20.0, 40.0):
        near = {tuple(r) for r in interaction.pairs(reps, radius).where(F.col("d0_nm") <= radius).select(key).collect()}
        everything = {tuple(r) for r in interaction.pairs(reps, None, lat0).where(F.col("d0_nm") <= radius).select(key).collect()}
        assert near == everything and everything


def _anchorage(spark, n):
    """Half of the ships within a few metres, the others all over; in two buckets."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(n):
        x, y = (122.2 + rng.normal(0, 1e-4), 30.9 + rng.normal(0, 1e-4)) if k % 2 else (rng.uniform(121.4, 123.2), rng.uniform(29.7, 31.5))
        rows += [(k // 600, k, float(x), float(y), float(rng.uniform(0, 15)), float(rng.uniform(0, 360)))]
    return spark.createDataFrame(rows, "bucket long, mmsi long, longitude double, latitude double, speed double, course double")


def test_crowded_cells_are_dealt_out(spark):
    reps = _anchorage(spark, 900)
    key, block = ["bucket", "own_mmsi", "target_mmsi"], 32
    rows = lambda df: sorted(map(tuple, df.select(*key, F.round("d0_nm", 9), F.round("dcpa_nm", 9)).collect()))
    dealt = rows(interaction.pairs(reps, 3.0, 30.5, block))
    assert dealt == rows(interaction.pairs(reps, 3.0, 30.5)) == rows(interaction.pairs(reps, None, 30.5).where("d0_nm <= 3.000003")) and len(dealt) > 300 * 299 / 2
    sides = [reps.select("bucket", F.lit(0).alias("level"), F.floor("longitude").alias("cx"), F.floor("latitude").alias("cy"), F.col("mmsi").alias(f"{p}_mmsi")) for p in ("own", "target")]
    met = interaction.meetings(*sides, block)
    assert met.count() == met.distinct().count()
    sizes = [r["count"] for r in met.groupBy("bucket", "cx", "cy", "a", "b").count().collect()]
    assert max(sizes) < 3 * block * block and len(sizes) > 100


def _odd_ships(spark, n):
    """The anchorage's ships with 20 minutes of reports, some of them missing a value, some with values beyond all ships."""
    at = F.timestamp_seconds(1717200000 + F.col("bucket") * 600 + F.col("mmsi") % 600).cast("timestamp_ntz").alias("timestamp")
    odd = {"speed": ((11, None), (13, math.nan), (15, math.inf), (17, 1e200), (19, 1e9), (20, 1e9)), "longitude": ((23, None), (25, math.nan)), "course": ((29, None), (31, math.nan), (33, math.inf))}
    pick = lambda c: reduce(lambda e, o: F.when(F.col("mmsi") == o[0], F.lit(o[1]).cast("double")).otherwise(e), odd.get(c, ()), F.col(c)).alias(c)
    return _anchorage(spark, n).select(F.when(F.col("mmsi") != 35, F.col("mmsi")).alias("mmsi"), at, *map(pick, ("longitude", "latitude", "speed", "course")))


@pytest.mark.parametrize("block, grid", [(meeting.BLOCK, 40), (32, 7), (300, 1100)])
def test_hotspots_count_every_encounter(spark, block, grid):
    reports, box = _odd_ships(spark, 1200), Box(121.5, 29.8, 122.9, 31.3)
    got = interaction.hotspots(reports, grid, 100_000, box, min_nm=0.0005, block=block).collect()
    want = interaction.conflict_hotspots(interaction.encounters(reports, min_nm=0.0005), grid, 100_000, box).collect()
    rows = lambda found: [tuple(round(x, 9) for x in r) for r in found]
    assert rows(got) == rows(want) and sum(r["n"] for r in got) > 10_000
    assert interaction.hotspots(reports.where("false")).count() == 0


def test_hotspots_make_no_row_a_pair(spark):
    """Ships that move to a task grow with the ships and with crowds of blocks, and two ships meet once."""
    n, block = 3000, 128
    ships = _anchorage(spark, n).select("bucket", "mmsi", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("longitude") * 95e3).alias("x"), (F.col("latitude") * 111e3).alias("y"))
    rows = meeting.dealt(ships, 11112.0, block).select("bucket", "cx", "cy", "a", "b", "looks", F.struct("lon", "lat").alias("ship")).toPandas()
    assert len(rows) < 5 * n + n * n // block and len(meeting.dealt(ships, 11112.0).toPandas()) == 5 * n
    assert rows.groupby(["bucket", "cx", "cy", "a", "b", "looks"]).size().max() < 2 * block
    met = collections.Counter()
    for (*_, b), group in rows.groupby(["bucket", "cx", "cy", "a", "b"]):
        own, other = ([tuple(s) for s in group.ship[group.looks == looks]] for looks in (True, False))
        met.update(frozenset(p) for p in itertools.product(own, other))
        met.update(frozenset(p) for p in itertools.combinations(own, 2) if b == 0)
    places = {}
    for r in ships.collect():
        places.setdefault((r["bucket"], math.floor(r["x"] / 11112.0), math.floor(r["y"] / 11112.0)), []).append((r["lon"], r["lat"]))
    want = sum(len(own) * len(places.get((b, x + i, y + j), ())) for (b, x, y), own in places.items() for i in (-1, 0, 1) for j in (-1, 0, 1)) - n
    assert max(met.values()) == 1 and len(met) == want // 2


def test_layers_read_the_events_once(spark, data):
    """What three layers share is written down, and the conflicts among it are no rows of pairs."""
    plan = registry.QUERIES["layer_maxima"](spark, data)._jdf.queryExecution().toString()
    assert "events.parquet" not in plan and "own_mmsi" not in plan
    assert "own_mmsi" not in registry.QUERIES["conflict_hotspots"](spark, data)._jdf.queryExecution().toString()


def test_halves_go_away_from_zero_as_in_sql(spark):
    x = [(121.4 + k / 1e5 + (121.4 + (k + 1) / 1e5)) / 2 for k in range(0, 180_000, 97)] + [0.00005, -0.00005, -2.5, 0.49999999999999994, 0.0]
    duck = duckdb.connect()
    for digits in (0, 4, 5):
        want = [duck.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in x]
        assert (meeting.half_up(np.array(x), digits) / 10.0**digits).tolist() == want
        assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(meeting.half_up(F.col("x"), digits) / 10.0**digits).collect()] == want


def test_each_ship_looks_as_far_as_it_reaches(spark):
    reps = _anchorage(spark, 300)
    reach = F.when(F.col("mmsi") == 7, 2160.0).when(F.col("mmsi") % 5 == 0, None).when(F.col("mmsi") % 7 == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("mmsi") % 9 - 5))
    reps = reps.withColumns({"reach_nm": reach, "tag": F.col("mmsi") + 1})
    for both in (False, True):
        got = interaction.pairs(reps, None, 30.5, both=both)
        want = interaction.pairs(reps.drop("reach_nm"), None, 30.5, both=both).join(reps.select(F.col("mmsi").alias("own_mmsi"), "reach_nm"), "own_mmsi").where("d0_nm <= reach_nm * 1.000001")
        rows = lambda df: sorted(map(tuple, df.select("own_mmsi", "target_mmsi", "own_tag", F.round("d0_nm", 9)).collect()))
        assert rows(got) == rows(want) and got.where("own_mmsi = 7").count() == (299 if both else 292)
    # the ship that reaches everywhere costs one more row of each ship, and nothing of the others' work
    assert interaction.pairs(reps.withColumn("reach_nm", F.lit(None).cast("double")), None).count() == 0


def test_domain_of_a_ship_of_a_thousand_kilometres(spark):
    reports = _anchorage(spark, 60).select("mmsi", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), "longitude", "latitude", "speed", "course")
    ships = spark.createDataFrame([(k, 1e6 if k == 3 else 150.0 + k) for k in range(58)] + [(4, 1.0), (58, None)], "mmsi long, length double")
    got = interaction.domain_pairs(reports, ships)
    assert got.where("own_mmsi = 3").count() == 56 and got.where("own_mmsi >= 58").count() == 0
    others = interaction.domain_pairs(reports, ships.where("mmsi <> 3"))
    key = ["own_mmsi", "target_mmsi", "radius_nm"]
    assert sorted(got.where("own_mmsi <> 3").select(key).collect()) == sorted(others.select(key).collect())


def test_head_on_pair_and_parallel_pair(spark):
    t = "2024-06-01 00:00:00"
    rows = _reports(spark, [(1, t, 122.0, 30.0, 10.0, 0.0), (2, t, 122.0, 30.01, 10.0, 180.0)])
    p = interaction.pairs(interaction.representatives(rows), None, 30.005).first()
    assert p["dcpa_nm"] < 1e-6
    assert p["tcpa_min"] == pytest.approx(0.01 * C.M_PER_DEG / (2 * 10 * C.KN_TO_MS) / 60, abs=0.02)
    side = _reports(spark, [(1, t, 122.0, 30.0, 10.0, 90.0), (2, t, 122.01, 30.0, 10.0, 90.0)])
    q = interaction.pairs(interaction.representatives(side), None, 30.0).first()
    assert q["tcpa_min"] is None and q["bearing"] == pytest.approx(0.0, abs=1e-6)


def test_angles_fall_as_in_sql(spark):
    """Courses of whole tenths that differ by 22.5 or 157.5 degrees, and ships dead ahead: the last bit tells the situation."""
    courses = [(k / 10, (k + d) % 3600 / 10) for k in range(3600) for d in (225, -225, 1575, -1575)]
    got = spark.createDataFrame(courses, "a double, b double").select("a", "b", geo.heading_difference(F.col("a"), F.col("b"))).collect()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE c AS SELECT k / 10 AS a, (k + d + 3600) % 3600 / 10 AS b FROM range(3600) t(k), (VALUES (225), (-225), (1575), (-1575)) u(d)")
    want = duck.execute("SELECT a, b, abs((((b - a) + 180) % 360 + 360) % 360 - 180) FROM c").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    rays = [(x, y, c / 10) for x, y in ((0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (-1.0, -1.0), (-1.0, 0.0), (1e-14, 1.0), (-1e-14, 1.0)) for c in range(0, 3600, 5)]
    got = spark.createDataFrame(rays, "x double, y double, c double").select("x", "y", "c", geo.relative_bearing(F.col("x"), F.col("y"), F.col("c"))).collect()
    assert [r[3] for r in got] == [duck.execute("SELECT ((degrees(atan2(?, ?)) - ?) % 360 + 360) % 360", r).fetchone()[0] for r in rays]
    geo.register_sql_functions(spark)
    assert spark.sql("SELECT heading_difference(0.1D, 22.6D), relative_bearing(1e-14D, 1D, 0D)").first() == tuple(duck.execute("SELECT abs((((22.6::DOUBLE - 0.1::DOUBLE) + 180) % 360 + 360) % 360 - 180), ((degrees(atan2(1e-14, 1)) - 0) % 360 + 360) % 360").fetchone())


def test_domain_radii(spark):
    r = lambda m, b, n: spark.range(1).select(geo.domain_radius_nm(m, F.lit(float(b)), F.lit(float(n)))).first()[0]
    assert r("fujii", 0, 200) == pytest.approx(4 * 200 / 1852) and r("fujii", 90, 200) == pytest.approx(1.6 * 200 / 1852)
    assert r("fujii", 0, 400) == pytest.approx(2 * r("fujii", 0, 200))
    assert [r("goodwin", b, 100) for b in (0, 90, 270)] == [0.85, 0.70, 0.45]
    with pytest.raises(ValueError):
        geo.domain_radius_nm("none", F.lit(0.0), F.lit(1.0))


def test_symmetric_domains_hold_the_one_sided_ones(spark, data):
    r, s = tables.reports(spark, data), tables.ships(spark, data)
    key = ["bucket", "own_mmsi", "target_mmsi"]
    one = {tuple(x) for x in interaction.domain_pairs(r, s, "goodwin", 30.0).select(key).collect()}
    both = {tuple(x) for x in interaction.domain_pairs(r, s, "goodwin", 30.0, symmetric=True).select(key).collect()}
    assert one <= both and len(both) > len(one)


def test_cleaning_rules_and_their_order(spark):
    t = lambda m: f"2024-06-01 00:{m:02d}:00"
    raw = spark.createDataFrame(
        [
            (0, "1", t(0), "122.0", "30.5", "10"), (1, "1", t(0), "122.0", "30.5", "10"),  # repeat
            (2, "1", t(1), "122.9", "30.5", "10"),  # jump; the next is measured from here
            (3, "1", t(2), "122.0", "30.5", "10"), (4, "1", t(3), "122.001", "30.5", "10"),
            (5, "", t(4), "122.0", "30.5", "10"), (6, "1", "never", "122.0", "30.5", "10"), (7, "1", t(5), "x", "30.5", "10"),
            (8, "1", t(6), "100.0", "30.5", "99"), (9, "1", t(7), "122.0", "30.5", "41"), (10, "1", t(8), "122.002", "30.5", "40"), (11, "1", "1717200900", "122.003", "30.5", None),
        ],
        "n int, mmsi string, timestamp string, longitude string, latitude string, speed string",
    ).coalesce(1)
    marked = cleaning.judged(cleaning.typed(raw))
    reasons = [r["reason"] for r in marked.orderBy("_order").collect()]
    assert reasons == [None, "duplicate", "jump", "jump", None, "missing", "missing", "missing", "bounds", "overspeed", None, None]
    counts = {r["item"]: r["n"] for r in cleaning.report(marked).collect()}
    assert counts["total"] == 12 == sum(n for k, n in counts.items() if k != "total")


def test_timestamps(spark):
    df = spark.createDataFrame([("1717200000",), ("1717200000000",), ("2024-06-01T00:00:00Z",), ("2024-06-01T00:00:00.9+08:00",), ("no",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(cleaning.parse_timestamp(F.col("t"))).collect()] == ["2024-06-01 00:00:00"] * 4 + ["None"] * 2


def test_rot_filters_and_smoothing(spark, data):
    rows = tables.reports(spark, data)
    point, win = (rot.statistics(rot.base(rows, m)).first() for m in (0, 15))
    assert win["mean_abs"] < point["mean_abs"]
    bins = rot.distribution(rot.base(rows)).collect()
    assert sum(r["n"] for r in bins) == rot.base(rows).count()
    assert rot.sample(rot.base(rows), 50).collect() == rot.sample(rot.base(rows.repartition(7)), 50).collect()
    track = _reports(spark, [(1, f"2024-06-01 00:0{k}:00", float(k), float(k), 1.0, 0.0) for k in range(3)])
    assert sorted(store.smoothed(track, 5).collect()) == sorted(track.collect())


def test_context(spark, data):
    rows = tables.reports(spark, data)
    assert Box.of(1, 2, 3) is None and Box.filled(west=122.0) == Box(122.0, C.SOUTH, C.EAST, C.NORTH)
    assert effective_box(None, None) == Box.filled() and effective_box(Box(0, 0, 1, 1), None).east == 1
    with pytest.raises(ValueError):
        Query(start="x").apply(rows)
    assert Query(start="x", strict=False).apply(rows).count() == rows.count()
    assert parse_time("2024-06-01T00:00:00.7Z").second == 0
    assert "PushedFilters" in spark.read.parquet(f"{data}/events.parquet").where("user_id = 3")._jdf.queryExecution().toString()


def test_generator_is_reproducible(spark):
    a, b = (generator.generate(spark, 6, 100, seed=5).repartition(n).orderBy("mmsi", "timestamp").toPandas() for n in (1, 3))
    assert len(a) == 100 and a.equals(b) and a.mmsi.nunique() == 6 and a.course.between(0, 360).all()


def test_sql_functions(spark):
    geo.register_sql_functions(spark)
    assert spark.sql("SELECT wrap_deg(340D), haversine_km(122D, 30D, 122D, 31D)").first()[0] == -20


def test_track_source_reads_the_same_rows_however_dealt(spark):
    spark.dataSource.register(generator.TrackSource)
    want = generator.generate(spark, 7, 100, seed=5).orderBy("mmsi", "timestamp").toPandas()
    for parts in (1, 3, 50):
        df = spark.read.format("tidemark").options(ships=7, points=100, seed=5, partitions=parts).load()
        assert df.rdd.getNumPartitions() == min(parts, 7)
        assert df.orderBy("mmsi", "timestamp").toPandas().equals(want)
    assert spark.read.format("tidemark").options(ships=7, points=3).load().count() == 3
    with pytest.raises(Exception, match="1 or more"):
        spark.read.format("tidemark").options(ships=0).load().count()


def test_streams_equal_batches(spark, data, tmp_path):
    rows = tables.reports(spark, data)
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = windows.hopping(stream).writeStream.format("memory").queryName("hops").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    order = ["start_epoch", "gx", "gy"]
    assert spark.table("hops").orderBy(order).drop("mean_speed").collect() == windows.hopping(rows).orderBy(order).drop("mean_speed").collect()
    d = windows.deduplicated(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("memory").queryName("dedup").start()
    d.processAllAvailable()
    d.stop()
    assert spark.table("dedup").count() == rows.count()
    last = str(tmp_path / "last")
    s = stream.writeStream.foreachBatch(windows.latest_sink(last)).start()
    s.processAllAvailable()
    s.stop()
    assert windows.latest_positions(spark, last).count() == rows.select("mmsi").distinct().count()


def test_late_batches_move_no_ship_back(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1, 0, k)
    write, path = windows.latest_sink(str(tmp_path / "last")), str(tmp_path / "last")
    for k, batch in enumerate(([(1, at(5), 5.0), (2, at(1), 1.0)], [(1, at(3), 3.0), (2, at(2), 2.0), (3, at(0), 0.0)], [(3, at(0), 0.5)])):
        write(spark.createDataFrame(batch, "mmsi long, timestamp timestamp_ntz, longitude double"), k)
    assert {tuple(r) for r in windows.latest_positions(spark, path).select("mmsi", "longitude").collect()} == {(1, 5.0), (2, 2.0), (3, 0.5)}


def test_whole_tracks_are_simplified(spark):
    rng = np.random.default_rng(2)
    x, y = np.cumsum(rng.normal(0.01, 0.01, 6000)), np.cumsum(rng.normal(0, 0.0004, 6000))
    rows = [(m, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), float(x[k]), float(y[k])) for m, n in ((1, 6000), (2, 2), (3, 1), (4, 40)) for k in range(n)]
    reports = spark.createDataFrame(rows, "mmsi long, timestamp timestamp_ntz, longitude double, latitude double")
    got = {(r["mmsi"], r["longitude"], r["latitude"]) for r in traffic.simplified(reports).collect()}
    want = {(m, float(x[k]), float(y[k])) for m, n in ((1, 6000), (2, 2), (4, 40)) for k in _kept(list(zip(x[:n].tolist(), y[:n].tolist(), strict=True)), 0.002)} | {(3, float(x[0]), float(y[0]))}
    assert got == want and max(a for m, a, _ in got if m == 1) == float(x[-1])


def test_parts_are_split_in_rounds_or_by_one_task(spark):
    """Long parts by rounds, short ones by a task: the same points; ties, positions missing, ships without number, a zigzag as deep as it is long."""
    rng = np.random.default_rng(5)
    tracks = {1: rng.normal(size=(300, 2)), 2: np.round(rng.normal(size=(120, 2)), 0), None: np.cumsum(rng.normal(0, 0.01, (150, 2)), axis=0), 3: np.zeros((5, 2))}
    start = datetime.datetime(2024, 1, 1)
    rows = [(m, start + datetime.timedelta(seconds=k), *map(float, p)) for m, points in tracks.items() for k, p in enumerate(points)]
    rows += [(4, start + datetime.timedelta(seconds=k), None if k == 3 else float(k), float(k % 2)) for k in range(6)]
    reports = spark.createDataFrame(rows, "mmsi long, timestamp timestamp_ntz, longitude double, latitude double").repartition(5)
    got = [sorted((r["mmsi"] or 0, r["timestamp"]) for r in traffic.simplified(reports, 0.5, piece=n).collect()) for n in (traffic.PIECE, 90)]
    want = [(m or 0, start + datetime.timedelta(seconds=k)) for m, points in tracks.items() for k in _kept([tuple(p) for p in points.tolist()], 0.5)]
    assert got[0] == got[1] == sorted(want + [(4, start), (4, start + datetime.timedelta(seconds=5))])
    assert traffic.simplified(reports.where("false")).count() == 0
    deep = spark.range(10_000).select(F.lit(1).cast("long").alias("mmsi"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("timestamp"), F.col("id").cast("double").alias("longitude"), ((10_000 - F.col("id")) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)).alias("latitude"))
    assert traffic.simplified(deep).count() == 10_000


@pytest.mark.parametrize("share", [0.0, 0.33, 0.5, 0.95, 0.99, 1.0])
def test_exact_percentiles(spark, share):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000), "b": np.r_[np.zeros(700), 1.0], "c": [3.0], "d": [1.0, 2.0], "e": np.round(rng.exponential(size=999), 1), None: [4.0, 5.0, 7.0]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["p"] for r in with_percentile(df, F.col("x"), share, ("g",), "p").collect()}
    assert got == {g: pytest.approx(np.quantile(v, share)) for g, v in groups.items()} | {"f": None}
    assert with_percentile(df, F.col("x"), share).first()[0] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), share))
    for none in ("g = 'f'", "false"):
        assert [tuple(r) for r in with_percentile(df.where(none), F.col("x"), share, also=(F.count("*").alias("n"),)).collect()] == [(int(none != "false"), None)]


def test_ranges():
    with pytest.raises(ValueError):
        in_range(store.grid_density)(None, grid=201)
    with pytest.raises(ValueError):
        in_range(kde.Raster)(bandwidth=0.3)
    assert in_range(kde.Raster)(bandwidth=0.1).grid == 80
    for bad in (lambda: store.smoothed(None, 1), lambda: store.grid_cells(None, grid=0)):
        with pytest.raises(ValueError):
            bad()


def test_spline_keeps_ends_and_lines(spark):
    rows = [(1, f"2024-06-01 00:00:{k:02d}", float(k), float(2 * k), 5.0, 0.0) for k in range(6)] + [(2, "2024-06-01 00:00:00", 1.0, 1.0, 5.0, 0.0), (2, "2024-06-01 00:00:01", 3.0, 5.0, 5.0, 0.0)]
    got = {(r["mmsi"], r["timestamp"].second): (r["longitude"], r["latitude"]) for r in store.spline_smoothed(_reports(spark, rows)).collect()}
    assert {k: v for (m, k), v in got.items() if m == 1} == {k: pytest.approx((k, 2 * k)) for k in range(6)}
    assert got[2, 0] == got[2, 1] == (2.0, 3.0)


def test_unknown_ships_are_left_out(spark):
    rows = _reports(spark, [(m, "2024-06-01 00:00:00", 1.0, 1.0, 5.0, 0.0) for m in (1, 2, 3)])
    ships = spark.createDataFrame([(10, 1), (11, 1), (None, 2), (12, None)], "ship_id long, mmsi long")
    assert [(r["mmsi"], r["ship_id"]) for r in store.with_ship(rows, ships).collect()] == [(1, 10)]
