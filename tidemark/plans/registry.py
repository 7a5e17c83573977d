"""Named queries over the given tables and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import Box, Query
from tidemark.functions import geo
from tidemark.operators import cleaning, interaction, kde, metrics, rot, spline, store, traffic
from tidemark.sources.shared import cut
from tidemark.sources.sinks import REPORT_KEY, merged
from tidemark.sources.tables import PROJECTION_SQL, projected_reports, reports, ships
from tidemark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SMALL = Box(121.9, 30.2, 122.7, 31.0)
WINDOW = Query(box=SMALL, start="2024-06-01 00:10:00", end="2024-06-01T00:50:00Z")
AT = "2024-06-01 00:40:00"
RASTER = kde.Raster(bandwidth=0.06, grid=40)


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` goes behind the projection."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(reports(spark, sf_dir), ships(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = PROJECTION_SQL + sql
        return f

    return add


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _cell(col: str, low: float, high: float, grid: int) -> str:
    return f"floor(({col} - {_d(low)}) / {_d((high - low) / grid)})"


def _centre(g: str, low: float, high: float, grid: int) -> str:
    return f"{_d(low)} + ({g} + {_d(0.5)}) * {_d((high - low) / grid)}"


_STUDY = f"longitude BETWEEN {_d(C.WEST)} AND {_d(C.EAST)} AND latitude BETWEEN {_d(C.SOUTH)} AND {_d(C.NORTH)}"
_SMALL = f"longitude BETWEEN {_d(SMALL.west)} AND {_d(SMALL.east)} AND latitude BETWEEN {_d(SMALL.south)} AND {_d(SMALL.north)}"
_TIME = "timestamp >= TIMESTAMP '2024-06-01 00:10:00' AND timestamp <= TIMESTAMP '2024-06-01 00:50:00'"


def _grid_sql(grid: int, where: str = "true", name: str = "cells") -> str:
    return f", {name} AS (SELECT CAST({_cell('longitude', C.WEST, C.EAST, grid)} AS BIGINT) AS gx, CAST({_cell('latitude', C.SOUTH, C.NORTH, grid)} AS BIGINT) AS gy, count(*) AS n FROM ais WHERE {_STUDY} AND {where} GROUP BY 1, 2)"


def _density_sql(grid: int, where: str = "true") -> str:
    return _grid_sql(grid, where) + f" SELECT gx, gy, {_centre('gx', C.WEST, C.EAST, grid)} AS longitude, {_centre('gy', C.SOUTH, C.NORTH, grid)} AS latitude, n FROM cells"


# ---- store


@query(_density_sql(50))
def grid_density(r, s):
    return store.grid_density(r)


@query(_density_sql(30, f"{_TIME} AND ship_type = 'tanker'"))
def grid_density_by_type(r, s):
    return store.grid_density(r, grid=30, query=Query(start=WINDOW.start, end=WINDOW.end, ship_types=("tanker",)))


@query(" SELECT count(*) AS points, count(DISTINCT mmsi) AS ships, CAST(min(epoch) AS BIGINT) AS first_epoch, CAST(max(epoch) AS BIGINT) AS last_epoch, round(count(*) / count(DISTINCT mmsi), 2) AS points_per_ship FROM ais")
def dataset_statistics(r, s):
    return store.statistics(r)


@query(" SELECT coalesce(ship_type, 'other') AS ship_type, count(DISTINCT mmsi) AS ships FROM ais GROUP BY 1")
def ship_type_distribution(r, s):
    return store.type_distribution(r)


_LATEST = ", latest AS (SELECT * FROM ais QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY timestamp DESC) = 1)"
_SHIP_ROWS = """ SELECT CAST(s.mmsi AS VARCHAR) AS id, coalesce(s.name, '') AS name, coalesce(s.ship_type, '') AS ship_type, coalesce(length, 0) AS length, coalesce(width, 0) AS width,
 longitude, latitude, coalesce(speed, 0) AS speed, coalesce(course, 0) AS course, CASE WHEN coalesce(speed, 0) < 0.5 THEN 'anchored' ELSE 'underway' END AS status, CAST(epoch AS BIGINT) AS last_epoch
 FROM ships s LEFT JOIN latest l USING (mmsi) WHERE """


@query(_LATEST + _SHIP_ROWS + "s.ship_type = 'bulk' ORDER BY s.mmsi LIMIT 20 OFFSET 3")
def list_ships(r, s):
    return store.list_ships(s, r, limit=20, offset=3, ship_type="bulk")


@query(_LATEST + _SHIP_ROWS + f"{_SMALL} ORDER BY s.mmsi LIMIT 500")
def list_ships_bbox(r, s):
    return store.list_ships(s, r, box=SMALL)


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS k, count(*) OVER (PARTITION BY mmsi) AS total FROM ais)
 SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, longitude, latitude, concat(mmsi, '_', epoch) AS id, course AS heading, CASE WHEN speed < 0.5 THEN 'anchored' ELSE 'underway' END AS status FROM n WHERE (k - 1) % CAST(ceil(total / 25) AS BIGINT) = 0""")
def ship_trajectory_thinned(r, s):
    return store.points(store.thinned(r, 25)).select("mmsi", geo.epoch().alias("epoch"), "longitude", "latitude", "id", "heading", "status")


@query(""" SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, round(CASE WHEN count(*) OVER p >= 5 THEN avg(longitude) OVER w ELSE longitude END, 8) AS longitude, round(CASE WHEN count(*) OVER p >= 5 THEN avg(latitude) OVER w ELSE latitude END, 8) AS latitude
 FROM ais WINDOW p AS (PARTITION BY mmsi), w AS (PARTITION BY mmsi ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def trajectory_smoothed(r, s):
    return store.smoothed(r, 5).select("mmsi", geo.epoch().alias("epoch"), F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"))


@query(""", n AS (SELECT *, count(*) OVER p AS total, lag(longitude) OVER w AS lon1, lead(longitude) OVER w AS lon2, lag(latitude) OVER w AS lat1, lead(latitude) OVER w AS lat2, avg(longitude) OVER m AS mlon, avg(latitude) OVER m AS mlat
  FROM ais WINDOW p AS (PARTITION BY mmsi), w AS (PARTITION BY mmsi ORDER BY timestamp), m AS (PARTITION BY mmsi ORDER BY timestamp ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, round(CASE WHEN total < 4 THEN mlon ELSE coalesce((lon1 + 4 * longitude + lon2) / 6, longitude) END, 8) AS longitude, round(CASE WHEN total < 4 THEN mlat ELSE coalesce((lat1 + 4 * latitude + lat2) / 6, latitude) END, 8) AS latitude FROM n""")
def trajectory_splined(r, s):
    return store.spline_smoothed(r).select("mmsi", geo.epoch().alias("epoch"), F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"))


@query()
def trajectory_fitted(r, s):
    return spline.spline_fitted(r).select("mmsi", "place", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@query(" SELECT a.mmsi - 200000000 AS ship_id, CAST(epoch AS BIGINT) AS epoch, longitude, latitude FROM ais a JOIN ships s ON s.mmsi = a.mmsi AND s.length >= 100")
def reports_with_ship(r, s):
    long_ones = s.where("length >= 100").select((F.col("mmsi") - 200000000).alias("ship_id"), "mmsi")
    return store.with_ship(r, long_ones).select("ship_id", geo.epoch().alias("epoch"), "longitude", "latitude")


_FIXED = Box(120.5, 30.5, 122.5, 32.0)


@query(f""", g AS (SELECT CAST(least({_cell('longitude', _FIXED.west, _FIXED.east, 50)}, 49) AS INTEGER) AS gx, CAST(least({_cell('latitude', _FIXED.south, _FIXED.north, 50)}, 49) AS INTEGER) AS gy FROM ais
  WHERE longitude BETWEEN {_d(_FIXED.west)} AND {_d(_FIXED.east)} AND latitude BETWEEN {_d(_FIXED.south)} AND {_d(_FIXED.north)})
 SELECT gx, gy, round({_centre('gx', _FIXED.west, _FIXED.east, 50)}, 9) AS longitude, round({_centre('gy', _FIXED.south, _FIXED.north, 50)}, 9) AS latitude, count(*) AS n FROM g GROUP BY gx, gy""")
def fixed_grid_histogram(r, s):
    return store.fixed_grid(r, _FIXED).select("gx", "gy", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"), "n")


_SNAP = """, last AS (SELECT * FROM ais WHERE timestamp <= TIMESTAMP '2024-06-01 00:40:00'{} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY timestamp DESC) = 1)
 SELECT CAST(l.mmsi AS VARCHAR) AS id, CAST(epoch AS BIGINT) AS epoch, longitude, latitude, speed, course, coalesce(l.ship_type, 'other') AS ship_type, s.name, length FROM last l LEFT JOIN ships s USING (mmsi)"""


@query(_SNAP.format(""))
def snapshot_asof(r, s):
    return traffic.snapshot(r, s, AT)


@query(_SNAP.format(f" AND {_SMALL}"))
def snapshot_asof_bbox(r, s):
    return traffic.snapshot(r, s, AT, SMALL)


@query(f", b AS (SELECT min(longitude) AS w, min(latitude) AS s FROM ais) SELECT CAST(floor((longitude - w) / {_d(0.05)}) AS BIGINT) AS gx, CAST(floor((latitude - s) / {_d(0.05)}) AS BIGINT) AS gy, count(*) AS n FROM ais, b GROUP BY 1, 2")
def density_by_degree(r, s):
    return store.density_by_degree(r, 0.05)


@query(""", few AS (SELECT mmsi FROM ships ORDER BY mmsi LIMIT 5), n AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS k, count(*) OVER (PARTITION BY mmsi) AS total FROM ais WHERE mmsi IN (SELECT mmsi FROM few))
 SELECT concat(mmsi, '_', epoch) AS id, longitude, latitude, CASE WHEN speed < 0.5 THEN 'anchored' ELSE 'underway' END AS status FROM n WHERE (k - 1) % CAST(ceil(total / 50) AS BIGINT) = 0""")
def sample_tracks(r, s):
    return store.sample_tracks(r, s).select("id", "longitude", "latitude", "status")


@query(" SELECT mmsi, name, coalesce(ship_type, '') AS ship_type, length, width FROM ships WHERE mmsi = (SELECT min(mmsi) FROM ships)")
def ship_lookup(r, s):
    first = s.agg(F.min("mmsi").alias("mmsi"))
    return s.join(F.broadcast(first), "mmsi", "left_semi").select("mmsi", "name", F.coalesce("ship_type", F.lit("")).alias("ship_type"), "length", "width")


# ---- distributions and flows

_BINS = " UNION ALL ".join(f"SELECT {k} AS bin, {_d(a)} AS lo, {_d(b)} AS hi" for k, (a, b) in enumerate(zip(C.SPEED_EDGES, C.SPEED_EDGES[1:], strict=False)))


@query(f", b AS ({_BINS}) SELECT bin, count(mmsi) AS n FROM b LEFT JOIN ais ON speed >= lo AND (speed < hi OR bin = 7 AND speed = hi) GROUP BY 1")
def speed_histogram(r, s):
    return traffic.speed_histogram(r)


@query(" SELECT CAST(b.range AS INTEGER) AS bin, count(mmsi) AS n FROM range(16) b LEFT JOIN ais ON CAST(floor(course / CAST(22.5 AS DOUBLE)) AS BIGINT) % 16 = b.range GROUP BY 1")
def course_rose(r, s):
    return traffic.course_rose(r)


@query(" SELECT count(*) AS n, count(*) FILTER (speed < 0.5) AS anchored, count(*) FILTER (speed >= 0.5 AND speed < 3) AS maneuvering, count(*) FILTER (speed >= 3) AS underway FROM ais")
def behavior_split(r, s):
    return traffic.behaviour(r)


_CROSS = """, legs AS (SELECT *, lag(longitude) OVER w AS x1, lag(latitude) OVER w AS y1 FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
 tu AS (SELECT *, (longitude - x1) * {ey} - (latitude - y1) * {ex} AS d, ({ax} - x1) * {ey} - ({ay} - y1) * {ex} AS tn, ({ax} - x1) * (latitude - y1) - ({ay} - y1) * (longitude - x1) AS un FROM legs WHERE x1 IS NOT NULL),
 hits AS (SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, timestamp, longitude, latitude, CASE WHEN d > 0 THEN 'seaward' ELSE 'landward' END AS direction FROM tu
  WHERE abs(d) >= 1e-15 AND tn / d BETWEEN 0 AND 1 AND un / d BETWEEN 0 AND 1)""".format(ax=_d(122.0), ay=_d(30.8), ex=_d(1.0), ey=_d(30.8 - 30.8))


@query(_CROSS + " SELECT mmsi, epoch, longitude, latitude, direction FROM hits ORDER BY mmsi, epoch LIMIT 500")
def section_crossings(r, s):
    return traffic.first_crossings(traffic.crossings(r))


@query(_CROSS + " SELECT count(*) AS total, count(*) FILTER (direction = 'seaward') AS seaward, count(*) FILTER (direction = 'landward') AS landward FROM hits")
def section_flow_totals(r, s):
    return traffic.section_totals(traffic.crossings(r))


@query(_CROSS + " SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(*) AS n FROM hits GROUP BY 1")
def section_flow_hourly(r, s):
    return traffic.section_hourly(traffic.crossings(r))


@query(f""", c AS (SELECT *, CAST(trunc((longitude - {_d(C.WEST)}) / {_d((C.EAST - C.WEST) / 20)}) AS INTEGER) AS x, CAST(trunc((latitude - {_d(C.SOUTH)}) / {_d((C.NORTH - C.SOUTH) / 20)}) AS INTEGER) AS y FROM ais),
 e AS (SELECT arg_min(x, epoch) AS ox, arg_min(y, epoch) AS oy, arg_max(x, epoch) AS dx, arg_max(y, epoch) AS dy FROM c GROUP BY mmsi)
 SELECT ox, oy, dx, dy, count(*) AS n, {_centre('ox', C.WEST, C.EAST, 20)} AS ox_lon, {_centre('oy', C.SOUTH, C.NORTH, 20)} AS oy_lat, {_centre('dx', C.WEST, C.EAST, 20)} AS dx_lon, {_centre('dy', C.SOUTH, C.NORTH, 20)} AS dy_lat
 FROM e GROUP BY ox, oy, dx, dy ORDER BY n DESC, ox, oy, dx, dy LIMIT 20""")
def od_matrix(r, s):
    return traffic.od_matrix(r)


@query(_grid_sql(60) + " SELECT gx, gy, n FROM cells WHERE n >= 0.5 * (SELECT avg(n) FROM cells)")
def hot_cells(r, s):
    return traffic.hot_cells(r)


@query(_grid_sql(30) + """, hot AS (SELECT gx, gy, gx * 32 + gy AS id FROM cells WHERE n >= 1.2 * (SELECT avg(n) FROM cells)),
 reach(id, root) AS (SELECT id, id FROM hot UNION SELECT n.id, r.root FROM reach r JOIN hot h ON h.id = r.id JOIN hot n ON abs(n.gx - h.gx) + abs(n.gy - h.gy) = 1),
 comp AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), big AS (SELECT root, count(*) AS cells FROM comp GROUP BY 1 HAVING count(*) >= 3)
 SELECT root, gx, gy, b.cells FROM comp JOIN big b USING (root) JOIN hot USING (id)""")
def corridors(r, s):
    return traffic.corridors(r, grid=30, ratio=1.2)


_OFF = "abs((b.x - a.x) * (t.y - a.y) - (b.y - a.y) * (t.x - a.x)) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"


@query(f""", t AS (SELECT mmsi, epoch, longitude AS x, latitude AS y, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS n FROM ais),
 parts(mmsi, first, last) AS (SELECT mmsi, min(n), max(n) FROM t GROUP BY 1 UNION ALL
  SELECT mmsi, CASE half WHEN 0 THEN first ELSE -far.n END, CASE half WHEN 0 THEN -far.n ELSE last END FROM (
   SELECT p.mmsi, p.first, p.last, max({{'off': {_OFF}, 'n': -t.n}}) AS far FROM parts p JOIN t a ON a.mmsi = p.mmsi AND a.n = p.first JOIN t b ON b.mmsi = p.mmsi AND b.n = p.last
    JOIN t ON t.mmsi = p.mmsi AND t.n > p.first AND t.n < p.last WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) >= 1e-12 GROUP BY ALL) s, (VALUES (0), (1)) h(half) WHERE far.off > {_d(0.002)}),
 ends AS (SELECT mmsi, first AS n FROM parts UNION SELECT mmsi, last FROM parts)
 SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, x AS longitude, y AS latitude FROM ends JOIN t USING (mmsi, n)""")
def simplify_dp(r, s):
    return traffic.simplified(r, 0.002).select("mmsi", geo.epoch().alias("epoch"), "longitude", "latitude")


# ---- kernel density

_KERNEL = "kern(d, w) AS (VALUES " + ", ".join(f"({k - len(RASTER.kernel) // 2}, {_d(w)})" for k, w in enumerate(RASTER.kernel)) + ")"
_KBINS = f""", bins AS (SELECT CAST(least(floor((longitude - {_d(C.WEST)}) / {_d(C.EAST - C.WEST)} * {RASTER.nx}), {RASTER.nx - 1}) AS INTEGER) AS ix,
 CAST(least(floor((latitude - {_d(C.SOUTH)}) / {_d(C.NORTH - C.SOUTH)} * {RASTER.ny}), {RASTER.ny - 1}) AS INTEGER) AS iy, count(*) AS n FROM ais WHERE {_STUDY} GROUP BY 1, 2)"""
_KDE = f"""{_KBINS}, {_KERNEL}, kx AS (SELECT ix + d AS ix, iy, sum(n * w) AS v FROM bins, kern WHERE ix + d BETWEEN 0 AND {RASTER.nx - 1} GROUP BY 1, 2),
 ky AS (SELECT ix, iy + d AS iy, sum(v * w) / {_d(RASTER.bin_nm2)} AS density FROM kx, kern WHERE iy + d BETWEEN 0 AND {RASTER.ny - 1} GROUP BY 1, 2),
 axx AS (SELECT range AS gx, CAST(trunc(CAST(range * {RASTER.nx} AS DOUBLE) / {RASTER.grid}) AS BIGINT) AS ix FROM range({RASTER.grid})), axy AS (SELECT range AS gy, CAST(trunc(CAST(range * {RASTER.ny} AS DOUBLE) / {RASTER.grid}) AS BIGINT) AS iy FROM range({RASTER.grid})),
 surf AS (SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, density FROM ky JOIN axx USING (ix) JOIN axy USING (iy) WHERE density > 1e-9)"""


@query(_KBINS + " SELECT ix, iy, n FROM bins")
def kde_bins(r, s):
    return kde.bins(r, RASTER)


@query(_KDE + " SELECT gx, gy, round(density, 6) AS density FROM surf")
def kde_surface(r, s):
    return kde.surface(r, RASTER).select("gx", "gy", F.round("density", 6).alias("density"))


@query(_KDE + " SELECT gx, gy, round(density, 6) AS density FROM surf ORDER BY round(surf.density, 9) DESC, gx, gy LIMIT 10")
def kde_hotspots(r, s):
    return kde.peaks(kde.surface(r, RASTER)).select("gx", "gy", F.round("density", 6).alias("density"))


@query(_KDE + f" SELECT round((SELECT max(density) FROM ky), 6) AS bin_peak, round((SELECT sum(density) FROM ky) / {RASTER.nx * RASTER.ny}, 6) AS mean_density, round((SELECT max(density) FROM surf), 6) AS grid_peak, (SELECT count(*) FROM surf) AS points")
def kde_meta(r, s):
    return kde.summary(r, RASTER).select(*(F.round(c, 6).alias(c) for c in ("bin_peak", "mean_density", "grid_peak")), "points")


# ---- indicators

_BASE = "count(*) AS point_count, count(DISTINCT mmsi) AS ship_count, avg(speed) AS avg_speed_kn, stddev_samp(speed) AS speed_std_kn, quantile_cont(speed, 0.95) AS speed_p95_kn, avg(CASE WHEN speed < 3 THEN 1.0 ELSE 0.0 END) AS congestion_ratio"
_ENTROPY = "(SELECT sum(-p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ais GROUP BY floor((coalesce(course, 0) % 360) / CAST(22.5 AS DOUBLE))))"
_CONC = "(SELECT sum(CASE WHEN k <= greatest(1, floor(m * 0.05)) THEN density ELSE 0 END) / sum(density) FROM (SELECT density, row_number() OVER (ORDER BY round(density, 9) DESC, gx, gy) AS k, count(*) OVER () AS m FROM surf))"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f", b AS (SELECT {_BASE} FROM ais) SELECT point_count, ship_count, round(avg_speed_kn, 6) AS avg_speed_kn, round(speed_std_kn, 6) AS speed_std_kn, round(speed_p95_kn, 6) AS speed_p95_kn, round(congestion_ratio, 6) AS congestion_ratio FROM b")
def scorecard_base(r, s):
    return _rounded(metrics.scorecard_base(r))


@query(f" SELECT round({_ENTROPY}, 6) AS course_entropy_bits, round({_ENTROPY} / 4, 6) AS flow_balance")
def course_entropy(r, s):
    return _rounded(metrics.course_entropy(r))


@query(_KDE + f" SELECT round({_CONC}, 6) AS route_concentration")
def route_concentration(r, s):
    return _rounded(metrics.route_concentration(kde.surface(r, RASTER)))


@query(_KDE + f""", b AS (SELECT {_BASE}, (SELECT sum(density) FROM ky) / {RASTER.nx * RASTER.ny} AS avg_density_nm2, (SELECT max(density) FROM ky) AS max_density_nm2, {_ENTROPY} AS course_entropy_bits, {_CONC} AS route_concentration FROM ais),
 c AS (SELECT CAST(ship_count AS DOUBLE) AS ship_count, CAST(point_count AS DOUBLE) AS point_count, avg_speed_kn, speed_std_kn, speed_std_kn / avg_speed_kn AS speed_cv, speed_p95_kn, avg_density_nm2, max_density_nm2, course_entropy_bits / 4 AS flow_balance, course_entropy_bits, route_concentration, CAST(congestion_ratio AS DOUBLE) AS congestion_ratio FROM b)
 SELECT indicator, round(value, 6) AS value FROM (UNPIVOT c ON COLUMNS(*) INTO NAME indicator VALUE value)""")
def traffic_scorecard(r, s):
    return _rounded(metrics.scorecard(r, RASTER))


# ---- rates of turn


def _wrap(x: str) -> str:
    return f"((({x}) + 540) % 360) - 180"


_POINT = f""", pg AS (SELECT mmsi, ship_type, longitude, latitude, speed, course, hour(timestamp) AS hour, epoch - lag(epoch) OVER w AS dt_s, {_wrap('course - lag(course) OVER w')} AS d_course FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
 point AS (SELECT *, d_course / (dt_s / CAST(60 AS DOUBLE)) AS rot FROM pg WHERE dt_s > 0 AND dt_s <= 600)"""
_WIN = f""", wg AS (SELECT mmsi, arg_max(ship_type, epoch) AS ship_type, arg_max(longitude, epoch) AS longitude, arg_max(latitude, epoch) AS latitude, arg_max(speed, epoch) AS speed, arg_max(course, epoch) AS course,
 hour(max(timestamp)) AS hour, max(epoch) - min(epoch) AS dt_s, {_wrap('arg_max(course, epoch) - arg_min(course, epoch)')} AS d_course FROM ais GROUP BY mmsi, epoch // 900),
 win AS (SELECT *, d_course / (dt_s / CAST(60 AS DOUBLE)) AS rot FROM wg WHERE dt_s > 450 AND dt_s <= 900)"""
_ROT_COLS = " SELECT mmsi, ship_type, longitude, latitude, speed, course, CAST(hour AS INTEGER) AS hour, CAST(dt_s AS BIGINT) AS dt_s, round(d_course, 6) AS d_course, round(rot, 6) AS rot FROM "


@query(_POINT + _ROT_COLS + "point")
def rot_pointwise(r, s):
    return rot.base(r, 0).withColumns({c: F.round(c, 6) for c in ("d_course", "rot")})


@query(_WIN + _ROT_COLS + "win")
def rot_windowed(r, s):
    return rot.base(r).withColumns({c: F.round(c, 6) for c in ("d_course", "rot")})


@query(_WIN + """ SELECT count(*) AS n, round(avg(abs(rot)), 6) AS mean_abs, round(stddev_samp(rot), 6) AS stddev, round(quantile_cont(abs(rot), 0.95), 6) AS p95_abs, round(max(abs(rot)), 6) AS max_abs, round(avg(CASE WHEN abs(rot) >= 3 THEN 1.0 ELSE 0.0 END), 6) AS maneuver_ratio,
 round(avg(CASE WHEN rot <= -3 THEN 1.0 ELSE 0.0 END), 6) AS left_ratio, round(avg(CASE WHEN rot >= 3 THEN 1.0 ELSE 0.0 END), 6) AS right_ratio, round(avg(CASE WHEN abs(rot) < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS steady_ratio, round(avg(rot), 6) AS mean, round(avg(dt_s), 6) AS mean_dt_s FROM win""")
def rot_statistics(r, s):
    return _rounded(rot.statistics(rot.base(r)))


@query(_POINT + _WIN + ", a AS (SELECT (SELECT avg(abs(rot)) FROM point) AS pointwise, (SELECT avg(abs(rot)) FROM win) AS windowed) SELECT round(pointwise, 6) AS pointwise, round(windowed, 6) AS windowed, round(pointwise / windowed, 6) AS amplification FROM a")
def rot_noise_amplification(r, s):
    return _rounded(rot.noise_amplification(r))


@query(_WIN + " SELECT coalesce(ship_type, 'unknown') AS ship_type, count(*) AS n, round(avg(abs(rot)), 6) AS mean_abs, round(quantile_cont(abs(rot), 0.95), 6) AS p95_abs, round(avg(CASE WHEN abs(rot) >= 3 THEN 1.0 ELSE 0.0 END), 6) AS maneuver_ratio FROM win GROUP BY 1")
def rot_by_type(r, s):
    return _rounded(rot.by_type(rot.base(r)))


@query(_WIN + f" SELECT CAST(least(39, greatest(0, {_cell('longitude', C.WEST, C.EAST, 40)})) AS INTEGER) AS gx, CAST(least(39, greatest(0, {_cell('latitude', C.SOUTH, C.NORTH, 40)})) AS INTEGER) AS gy, count(*) AS n, round(avg(abs(rot)), 6) AS mean_abs, round(avg(CASE WHEN abs(rot) >= 3 THEN 1.0 ELSE 0.0 END), 6) AS maneuver_ratio, round(avg(longitude), 9) AS longitude, round(avg(latitude), 9) AS latitude FROM win GROUP BY 1, 2")
def rot_grid(r, s):
    cells = rot.grid(rot.base(r))
    return cells.select("gx", "gy", "n", *(F.round(c, d).alias(c) for c, d in (("mean_abs", 6), ("maneuver_ratio", 6), ("longitude", 9), ("latitude", 9))))


@query(_WIN + ", t AS (SELECT quantile_cont(abs(rot), 0.99) AS top FROM win), x AS (SELECT CAST(least(floor(abs(rot) / (top / 20)), 19) AS INTEGER) AS bin FROM win, t) SELECT CAST(b.range AS INTEGER) AS bin, round(b.range * ((SELECT top FROM t) / 20), 6) AS low, count(x.bin) AS n FROM range(20) b LEFT JOIN x ON x.bin = b.range GROUP BY b.range")
def rot_distribution(r, s):
    return _rounded(rot.distribution(rot.base(r)))


_SAMPLE = """, k AS (SELECT *, md5(concat_ws('|', mmsi, hour, CAST(round(longitude * 1000000) AS BIGINT), CAST(round(latitude * 1000000) AS BIGINT), '42')) AS key FROM win),
 smp AS (SELECT * FROM (SELECT * FROM k ORDER BY key, dt_s LIMIT 2000) WHERE ship_type IS NOT NULL)"""


@query(_WIN + _SAMPLE + _ROT_COLS + "smp")
def rot_sample(r, s):
    return rot.sample(rot.base(r)).withColumns({c: F.round(c, 6) for c in ("d_course", "rot")})


@query(_WIN + _SAMPLE + " " + " UNION ALL ".join(f"SELECT '{a}' AS axis, round(CAST(min({a}) AS DOUBLE), 6) AS low, round(CAST(max({a}) AS DOUBLE), 6) AS high FROM smp" for a in ("speed", "course", "rot", "longitude", "latitude", "hour")))
def multivariate_ranges(r, s):
    return _rounded(rot.axis_ranges(rot.sample(rot.base(r))))


@query(_WIN + _SAMPLE + " SELECT 'ship_type' AS axis, CAST(row_number() OVER (ORDER BY ship_type) - 1 AS INTEGER) AS place, ship_type AS category FROM (SELECT DISTINCT ship_type FROM smp)")
def multivariate_categories(r, s):
    return rot.axis_categories(rot.sample(rot.base(r)))


# ---- interaction

_K = f"{_d(C.M_PER_DEG)} * cos(radians((SELECT m FROM lat0)))"
_PAIRS = f""", rep AS (SELECT CAST(epoch // 600 AS BIGINT) AS bucket, mmsi, longitude, latitude, speed, course FROM ais QUALIFY row_number() OVER (PARTITION BY mmsi, epoch // 600 ORDER BY timestamp DESC) = 1),
 lat0 AS (SELECT CAST(sum(CAST(round(latitude * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 AS m FROM rep),
 pr AS (SELECT a.bucket, a.mmsi AS own_mmsi, b.mmsi AS target_mmsi, a.longitude AS alon, b.longitude AS blon, a.latitude AS alat, b.latitude AS blat, a.speed AS own_speed, b.speed AS target_speed, a.course AS ac, b.course AS bc,
  (b.longitude - a.longitude) * ({_K}) AS rx, (b.latitude - a.latitude) * {_d(C.M_PER_DEG)} AS ry,
  b.speed * {_d(C.KN_TO_MS)} * sin(radians(b.course)) - a.speed * {_d(C.KN_TO_MS)} * sin(radians(a.course)) AS wx, b.speed * {_d(C.KN_TO_MS)} * cos(radians(b.course)) - a.speed * {_d(C.KN_TO_MS)} * cos(radians(a.course)) AS wy
  FROM rep a JOIN rep b ON a.bucket = b.bucket AND a.mmsi < b.mmsi),
 tt AS (SELECT *, CASE WHEN wx * wx + wy * wy > 1e-9 THEN -(rx * wx + ry * wy) / (wx * wx + wy * wy) END AS t, ((degrees(atan2(rx, ry)) - ac) % 360 + 360) % 360 AS bearing, abs((((bc - ac) + 180) % 360 + 360) % 360 - 180) AS heading_diff FROM pr),
 cpa AS (SELECT *, sqrt(rx * rx + ry * ry) / 1852 AS d0_nm, sqrt((rx + wx * t) * (rx + wx * t) + (ry + wy * t) * (ry + wy * t)) / 1852 AS dcpa_nm, t / 60 AS tcpa_min FROM tt)"""
_ENC = _PAIRS + """, enc AS (SELECT *, (alon + blon) / 2 AS longitude, (alat + blat) / 2 AS latitude, dcpa_nm + tcpa_min / 60 AS risk, d0_nm < 0.1 AS degenerate,
 CASE WHEN heading_diff < 22.5 THEN 'overtaking' WHEN heading_diff > 157.5 THEN 'head-on' WHEN bearing > 0 AND bearing < 180 OR bearing > 180 AND bearing < 360 THEN 'crossing' ELSE 'other' END AS situation,
 CASE WHEN heading_diff < 22.5 THEN CASE WHEN bearing <= 67.5 OR bearing >= 292.5 THEN 'give way' WHEN bearing BETWEEN 112.5 AND 247.5 THEN 'stand on' WHEN own_speed > target_speed THEN 'give way' ELSE 'stand on' END
  WHEN heading_diff > 157.5 THEN 'both give way' WHEN bearing > 0 AND bearing < 180 THEN 'give way' WHEN bearing > 180 AND bearing < 360 THEN 'stand on' ELSE 'unclear' END AS responsibility
 FROM cpa WHERE tcpa_min > 0 AND tcpa_min <= 30 AND dcpa_nm <= 1 AND d0_nm <= 6)"""


@query(_PAIRS + " SELECT bucket, mmsi, longitude, latitude, speed, course FROM rep")
def bucket_representatives(r, s):
    return interaction.representatives(r)


@query(_PAIRS + " SELECT bucket, own_mmsi, target_mmsi, round(d0_nm, 6) AS d0_nm, round(dcpa_nm, 6) AS dcpa_nm, round(tcpa_min, 6) AS tcpa_min, round(bearing, 6) AS bearing, round(heading_diff, 6) AS heading_diff FROM cpa WHERE d0_nm <= 3")
def cpa_pairs(r, s):
    near = interaction.pairs(interaction.representatives(r), 3.0).where("d0_nm <= 3")
    return _rounded(near.select("bucket", "own_mmsi", "target_mmsi", "d0_nm", "dcpa_nm", "tcpa_min", "bearing", "heading_diff"))


@query(_ENC + " SELECT bucket, own_mmsi, target_mmsi, round(d0_nm, 6) AS d0_nm, round(dcpa_nm, 6) AS dcpa_nm, round(tcpa_min, 6) AS tcpa_min, situation, responsibility FROM enc WHERE NOT degenerate ORDER BY risk, bucket, own_mmsi, target_mmsi LIMIT 500")
def encounters(r, s):
    return _rounded(interaction.most_urgent(interaction.encounters(r)).select("bucket", "own_mmsi", "target_mmsi", "d0_nm", "dcpa_nm", "tcpa_min", "situation", "responsibility"))


@query(_ENC + " SELECT situation, count(*) AS n FROM enc WHERE NOT degenerate GROUP BY 1")
def encounter_situations(r, s):
    return interaction.situations(interaction.encounters(r))


@query(_ENC + " SELECT count(*) FILTER (degenerate) AS degenerate, count(*) FILTER (NOT degenerate) AS encounters FROM enc")
def encounter_degenerate(r, s):
    return interaction.encounters(r).agg(F.count_if("degenerate").alias("degenerate"), F.count_if(~F.col("degenerate")).alias("encounters"))


@query(_ENC + f""", c AS (SELECT CAST({_cell('round(longitude, 5)', C.WEST, C.EAST, 40)} AS BIGINT) AS gx, CAST({_cell('round(latitude, 5)', C.SOUTH, C.NORTH, 40)} AS BIGINT) AS gy, round(dcpa_nm, 4) AS dcpa FROM enc WHERE NOT degenerate)
 SELECT gx, gy, count(*) AS n, count(*) FILTER (dcpa < 0.3) AS severe, round(avg(dcpa), 3) AS mean_dcpa FROM c WHERE gx BETWEEN 0 AND 39 AND gy BETWEEN 0 AND 39 GROUP BY gx, gy ORDER BY n DESC, gx, gy LIMIT 30""")
def conflict_hotspots(r, s):
    return interaction.hotspots(r).select("gx", "gy", "n", "severe", F.round("mean_dcpa", 3).alias("mean_dcpa"))


@query(_WIN + _ENC + f""", hot AS (SELECT CAST({_cell('round(longitude, 5)', C.WEST, C.EAST, 40)} AS BIGINT) AS gx, CAST({_cell('round(latitude, 5)', C.SOUTH, C.NORTH, 40)} AS BIGINT) AS gy, count(*) AS n, count(*) FILTER (round(dcpa_nm, 4) < 0.3) AS severe FROM enc WHERE NOT degenerate GROUP BY 1, 2),
 cells AS (SELECT count(*) AS n FROM ais WHERE {_STUDY} GROUP BY {_cell('longitude', C.WEST, C.EAST, 50)}, {_cell('latitude', C.SOUTH, C.NORTH, 50)}),
 top AS (SELECT * FROM hot WHERE gx BETWEEN 0 AND 39 AND gy BETWEEN 0 AND 39 ORDER BY n DESC, gx, gy LIMIT 30)
 SELECT (SELECT max(n) FROM cells) AS max_density, greatest(coalesce(max(n), 1), 1) AS max_conflicts, greatest(coalesce(max(severe), 1), 1) AS max_severe,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM win GROUP BY greatest(0, least(39, {_cell('longitude', C.WEST, C.EAST, 40)})), greatest(0, least(39, {_cell('latitude', C.SOUTH, C.NORTH, 40)})))) AS max_samples FROM top""")
def layer_maxima(r, s):
    r = cut(r.select("mmsi", "timestamp", "longitude", "latitude", "speed", "course", "ship_type"))  # read three times
    return metrics.layer_maxima(store.grid_density(r), interaction.hotspots(r), rot.grid(rot.base(r)))


@query(" SELECT round(100 * CAST(count(*) FILTER (speed >= 3) AS DOUBLE) / count(speed), 6) AS underway_pct FROM ais")
def underway_share(r, s):
    return metrics.underway_share(traffic.behaviour(r)).select(F.round("underway_pct", 6).alias("underway_pct"))


def _domain_sql(model: str, scale: float) -> str:
    a, b = "4 * length", "1.6 * length"
    radius = f"({a}) * ({b}) / sqrt((({b}) * cos(radians(bearing))) * (({b}) * cos(radians(bearing))) + (({a}) * sin(radians(bearing))) * (({a}) * sin(radians(bearing)))) / 1852" if model == "fujii" else "CASE WHEN bearing <= 60 OR bearing >= 300 THEN 0.85 WHEN bearing < 180 THEN 0.7 ELSE 0.45 END"
    return _PAIRS + f", rad AS (SELECT cpa.*, ({radius}) * {_d(scale)} AS radius_nm FROM cpa JOIN ships ON ships.mmsi = own_mmsi), dom AS (SELECT *, 1 - d0_nm / radius_nm AS penetration, d0_nm * cos(radians(bearing)) AS along_nm, d0_nm * sin(radians(bearing)) AS cross_nm FROM rad WHERE d0_nm > 0 AND d0_nm <= radius_nm)"


_DOM = " SELECT bucket, own_mmsi, target_mmsi, round(d0_nm, 6) AS d0_nm, round(radius_nm, 6) AS radius_nm, round(penetration, 6) AS penetration, round(along_nm, 6) AS along_nm, round(cross_nm, 6) AS cross_nm FROM dom ORDER BY dom.penetration DESC, bucket, own_mmsi, target_mmsi LIMIT 500"


def _dom(found: DataFrame) -> DataFrame:
    return _rounded(interaction.deepest(found).select("bucket", "own_mmsi", "target_mmsi", "d0_nm", "radius_nm", "penetration", "along_nm", "cross_nm"))


@query(_domain_sql("fujii", 1.5) + _DOM)
def domain_violations_fujii(r, s):
    return _dom(interaction.domain_pairs(r, s, "fujii", 1.5))


@query(_domain_sql("goodwin", 1.0) + _DOM)
def domain_violations_goodwin(r, s):
    return _dom(interaction.domain_pairs(r, s, "goodwin"))


def _radius_sql(model: str) -> str:
    sql = _domain_sql(model, 1.0).split(", rad AS (SELECT cpa.*, ")[1].split(" AS radius_nm")[0]
    return f" SELECT mmsi, CAST(b.range * 15 AS DOUBLE) AS bearing, round(CAST({sql.replace('bearing', '(b.range * 15)')} AS DOUBLE), 6) AS radius_nm FROM ships, range(24) b"


def _radii(s: DataFrame, model: str) -> DataFrame:
    rows = s.select("mmsi", "length", F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))).alias("b"))
    return rows.select("mmsi", F.col("b").cast("double").alias("bearing"), F.round(geo.domain_radius_nm(model, F.col("b").cast("double"), F.col("length")).cast("double"), 6).alias("radius_nm"))


@query(_radius_sql("fujii"))
def domain_radius_fujii(r, s):
    return _radii(s, "fujii")


@query(_radius_sql("goodwin"))
def domain_radius_goodwin(r, s):
    return _radii(s, "goodwin")


@query(_domain_sql("goodwin", 1.0) + " SELECT own_mmsi, count(*) AS n FROM dom GROUP BY 1 ORDER BY n DESC, own_mmsi LIMIT 10")
def most_violated_ships(r, s):
    return interaction.most_violated(interaction.domain_pairs(r, s, "goodwin"))


@query(_domain_sql("goodwin", 1.0) + " SELECT count(*) AS violations, count(DISTINCT own_mmsi) AS ships, round(max(penetration), 6) AS worst, count(*) FILTER (d0_nm < 0.05) AS overlaps FROM dom")
def domain_summary(r, s):
    return _rounded(interaction.domain_summary(interaction.domain_pairs(r, s, "goodwin")))


@query(_domain_sql("goodwin", 1.0) + " SELECT CAST(b.range AS INTEGER) AS bin, count(own_mmsi) AS n FROM range(5) b LEFT JOIN dom ON CASE WHEN abs(along_nm) >= 0.5 THEN 4 WHEN abs(along_nm) >= 0.2 THEN 3 WHEN abs(along_nm) >= 0.1 THEN 2 WHEN abs(along_nm) >= 0.05 THEN 1 ELSE 0 END = b.range GROUP BY 1")
def headway_histogram(r, s):
    return interaction.headway(interaction.domain_pairs(r, s, "goodwin"))


# ---- cleaning and merging

_AREA = Box(121.7, 30.0, 122.9, 31.2)
_JUDGED = f""", dirty AS (SELECT event_id, mmsi, epoch, timestamp, CASE WHEN event_id % 97 <> 0 THEN longitude END AS longitude, latitude, speed FROM raw),
 j1 AS (SELECT *, CASE WHEN longitude IS NULL THEN 'missing' WHEN NOT (longitude BETWEEN {_d(_AREA.west - 0.3)} AND {_d(_AREA.east + 0.3)} AND latitude BETWEEN {_d(_AREA.south - 0.3)} AND {_d(_AREA.north + 0.3)}) THEN 'bounds' END AS r1 FROM dirty),
 j2 AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY mmsi, timestamp, r1 ORDER BY event_id) > 1 THEN 'duplicate' ELSE r1 END AS r2 FROM j1),
 j3 AS (SELECT *, CASE WHEN r2 IS NULL AND speed > 40 THEN 'overspeed' ELSE r2 END AS r3 FROM j2),
 j4 AS (SELECT *, lag(longitude) OVER w AS lon1, lag(latitude) OVER w AS lat1, epoch - lag(epoch) OVER w AS dt FROM j3 WINDOW w AS (PARTITION BY mmsi, r3 IS NULL ORDER BY timestamp, event_id)),
 judged AS (SELECT event_id, mmsi, CAST(epoch AS BIGINT) AS epoch, CASE WHEN r3 IS NULL AND dt > 0 AND {_d(2 * C.EARTH_KM)} * asin(sqrt(pow(sin(radians(latitude - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon1) / 2), 2))) / (dt / CAST(3600 AS DOUBLE)) > {_d(C.MAX_JUMP_KMH)} THEN 'jump' ELSE r3 END AS reason FROM j4)"""


def _raw(name: str, sql: str):
    """Register a query on the projection with its repeats, some positions missing."""

    def add(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = projected_reports(spark, sf_dir).withColumn("longitude", F.when(F.col("event_id") % 97 != 0, F.col("longitude")))
            return f(cleaning.judged(rows, "event_id", _AREA))

        QUERIES[name], ORACLES[name] = run, PROJECTION_SQL + _JUDGED + sql
        return f

    return add


@_raw("clean_missing_bounds", " SELECT event_id, reason FROM judged WHERE reason IN ('missing', 'bounds')")
def clean_missing_bounds(marked):
    return marked.where(F.col("reason").isin("missing", "bounds")).select("event_id", "reason")


@_raw("clean_dedup", " SELECT event_id, mmsi, epoch FROM judged WHERE reason = 'duplicate'")
def clean_dedup(marked):
    return marked.where(F.col("reason") == "duplicate").select("event_id", "mmsi", geo.epoch().alias("epoch"))


@_raw("clean_jump", " SELECT event_id, mmsi, epoch, reason FROM judged WHERE reason IN ('jump', 'overspeed')")
def clean_jump(marked):
    return marked.where(F.col("reason").isin("jump", "overspeed")).select("event_id", "mmsi", geo.epoch().alias("epoch"), "reason")


@_raw("clean_report", " SELECT item, n FROM (SELECT 'total' AS item, count(*) AS n FROM judged UNION ALL SELECT x.r, count(reason) FROM (VALUES ('missing'), ('bounds'), ('duplicate'), ('overspeed'), ('jump')) x(r) LEFT JOIN judged ON reason = x.r GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM judged WHERE reason IS NULL)")
def clean_report(marked):
    return cleaning.report(marked)


@query(""", o AS (SELECT mmsi, epoch, speed, 0 AS pri FROM ais WHERE event_id % 3 <> 0 UNION ALL SELECT mmsi, epoch, speed + 1, 1 FROM ais WHERE event_id % 2 = 0)
 SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, speed FROM o QUALIFY row_number() OVER (PARTITION BY mmsi, epoch ORDER BY pri DESC) = 1""")
def upsert_merge(r, s):
    rows = r.select("mmsi", "timestamp", "speed", "event_id")
    old, new = rows.where("event_id % 3 <> 0").drop("event_id"), rows.where("event_id % 2 = 0").drop("event_id").withColumn("speed", F.col("speed") + 1)
    return merged(old, new, REPORT_KEY).select("mmsi", geo.epoch().alias("epoch"), "speed")


@query(" SELECT mmsi, CAST(epoch AS BIGINT) AS epoch, longitude, latitude, speed, course FROM ais ORDER BY mmsi, timestamp LIMIT 1000")
def export_order_limit(r, s):
    return r.orderBy("mmsi", "timestamp").limit(1000).select("mmsi", geo.epoch().alias("epoch"), "longitude", "latitude", "speed", "course")


# ---- windows that also run on streams


@query(f""", h AS (SELECT *, CAST(epoch AS BIGINT) // 900 * 900 - k.range * 900 AS start_epoch FROM ais, range(4) k WHERE {_STUDY})
 SELECT start_epoch, start_epoch + 3600 AS end_epoch, CAST({_cell('longitude', C.WEST, C.EAST, 20)} AS BIGINT) AS gx, CAST({_cell('latitude', C.SOUTH, C.NORTH, 20)} AS BIGINT) AS gy, count(*) AS n, round(avg(speed), 9) AS mean_speed FROM h GROUP BY ALL""")
def playback_hopping_window(r, s):
    return _rounded(windows.hopping(r), 9)


@query(""", g AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY mmsi ORDER BY epoch) AS dt FROM ais), t AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY epoch) AS trip FROM g)
 SELECT mmsi, CAST(min(epoch) AS BIGINT) AS start_epoch, CAST(max(epoch) + 120 AS BIGINT) AS end_epoch, count(*) AS n, round(avg(speed), 9) AS mean_speed FROM t GROUP BY mmsi, trip""")
def trip_sessions(r, s):
    return _rounded(windows.trips(r, "2 minutes"), 9)


