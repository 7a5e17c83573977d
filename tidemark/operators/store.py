"""Ships, tracks, statistics and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import STUDY, Box, Query
from tidemark.functions.geo import cell, cell_centre, epoch


def latest(reports: DataFrame, order: str = "timestamp") -> DataFrame:
    """Each ship's last report (ties: the one of the largest longitude, then latitude)."""
    return reports.groupBy("mmsi").agg(F.max_by(F.struct("*"), F.struct(order, "longitude", "latitude")).alias("r")).select("r.*")


def list_ships(ships: DataFrame, reports: DataFrame, limit: int = 500, offset: int = 0, box: Box | None = None, ship_type: str | None = None) -> DataFrame:
    """Ships with their latest position, by mmsi. A box tests that position, so ships without one drop out."""
    last = latest(reports).select("mmsi", "timestamp", "longitude", "latitude", "speed", "course")
    if ship_type is not None:
        ships = ships.where(F.col("ship_type") == ship_type)
    rows = ships.join(last, "mmsi", "left")
    if box:
        rows = rows.where(box.contains())
    speed = F.coalesce("speed", F.lit(0.0))
    return rows.orderBy("mmsi").offset(offset).limit(limit).select(
        F.col("mmsi").cast("string").alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("ship_type", F.lit("")).alias("ship_type"),
        F.coalesce("length", F.lit(0.0)).alias("length"),
        F.coalesce("width", F.lit(0.0)).alias("width"),
        "longitude",
        "latitude",
        speed.alias("speed"),
        F.coalesce("course", F.lit(0.0)).alias("course"),
        F.when(speed < C.ANCHORED_KN, C.ANCHORED).otherwise(C.UNDERWAY).alias("status"),
        epoch().alias("last_epoch"),
    )


def ship(ships: DataFrame, mmsi: int) -> DataFrame:
    return ships.where(F.col("mmsi") == mmsi)


def points(reports: DataFrame) -> DataFrame:
    """Track points as they are shown: id, heading, status."""
    return reports.withColumns({"id": F.concat_ws("_", F.col("mmsi").cast("string"), epoch().cast("string")), "heading": F.col("course"), "status": F.when(F.coalesce("speed", F.lit(0.0)) < C.ANCHORED_KN, C.ANCHORED).otherwise(C.UNDERWAY)})


def thinned(reports: DataFrame, limit: int = 5000) -> DataFrame:
    """At most about ``limit`` points of every ship: every k-th by time, k = ceil(points / limit)."""
    by = Window.partitionBy("mmsi")
    rows = reports.withColumn("_n", F.row_number().over(by.orderBy("timestamp"))).withColumn("_all", F.count("*").over(by))
    return rows.where((F.col("_n") - 1) % F.ceil(F.col("_all") / limit) == 0).drop("_n", "_all")


def trajectory(reports: DataFrame, mmsi: int, limit: int = 5000, query: Query = Query()) -> DataFrame:
    return points(thinned(query.apply(reports).where(F.col("mmsi") == mmsi), limit))


def smoothed(reports: DataFrame, window: int = 5) -> DataFrame:
    """Centred moving average of positions over window // 2 points to either side, shorter at the ends; tracks under ``window`` points stay."""
    if window < 2:
        raise ValueError("a moving average takes two points or more")
    by = Window.partitionBy("mmsi")
    around = by.orderBy("timestamp").rowsBetween(-(window // 2), window // 2)
    enough = F.count("*").over(by) >= window
    return reports.withColumns({c: F.when(enough, F.avg(c).over(around)).otherwise(F.col(c)) for c in ("longitude", "latitude")})


def spline_smoothed(reports: DataFrame) -> DataFrame:
    """Positions on the uniform cubic B-spline whose control points are the track's reports.

    The curve is taken at its knots, so there are as many points as before; the
    first and the last of a track stay, and tracks of fewer than four points
    become centred means of three.  Only a point's neighbours are looked at.
    """
    by = Window.partitionBy("mmsi")
    track = by.orderBy("timestamp")
    rows = reports.withColumn("_all", F.count("*").over(by))

    def at(c: str) -> Column:
        before, after = F.lag(c).over(track), F.lead(c).over(track)
        knot = (before + F.lit(4.0) * F.col(c) + after) / F.lit(6.0)
        mean = F.avg(c).over(track.rowsBetween(-1, 1))
        return F.when(F.col("_all") < 4, mean).otherwise(F.coalesce(knot, F.col(c)))

    return rows.withColumns({c: at(c) for c in ("longitude", "latitude")}).drop("_all")


def with_ship(reports: DataFrame, ships: DataFrame) -> DataFrame:
    """Reports with the ``ship_id`` that ``ships`` (ship_id, mmsi) gives their mmsi; those of no known ship are left out.

    Where several ships have one mmsi the smallest ship_id stands for it.
    """
    ids = ships.where("mmsi IS NOT NULL AND ship_id IS NOT NULL").groupBy("mmsi").agg(F.min("ship_id").alias("ship_id"))
    return reports.join(ids, "mmsi")


def fixed_grid(reports: DataFrame, box: Box, grid: int = 50) -> DataFrame:
    """Occupied cells of ``grid`` by ``grid`` over a box, the far edges belonging to the last cells."""
    inside = reports.where(box.contains())
    at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / ((high - low) / grid)), F.lit(grid - 1)).cast("int")
    cells = inside.groupBy(at("longitude", box.west, box.east).alias("gx"), at("latitude", box.south, box.north).alias("gy")).agg(F.count("*").alias("n"))
    centre = {"longitude": cell_centre(F.col("gx"), box.west, (box.east - box.west) / grid), "latitude": cell_centre(F.col("gy"), box.south, (box.north - box.south) / grid)}
    return cells.withColumns(centre)


def statistics(reports: DataFrame) -> DataFrame:
    one = reports.agg(F.count("*").alias("points"), F.count_distinct("mmsi").alias("ships"), F.min(epoch()).alias("first_epoch"), F.max(epoch()).alias("last_epoch"))
    return one.withColumn("points_per_ship", F.when(F.col("ships") > 0, F.round(F.col("points") / F.col("ships"), 2)).otherwise(0.0))


def type_distribution(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.coalesce("ship_type", F.lit(C.OTHER_TYPE)).alias("ship_type")).agg(F.count_distinct("mmsi").alias("ships"))


def grid_cells(reports: DataFrame, box: Box = STUDY, grid: int = 50) -> DataFrame:
    """Reports inside the box by cell; the far edges make an extra row and column."""
    if grid < 1:
        raise ValueError("a grid has a cell or more")
    sx, sy = (box.east - box.west) / grid, (box.north - box.south) / grid
    inside = reports.where(box.contains())
    return inside.groupBy(cell(F.col("longitude"), box.west, sx).alias("gx"), cell(F.col("latitude"), box.south, sy).alias("gy")).agg(F.count("*").alias("n"))


def grid_density(reports: DataFrame, box: Box = STUDY, grid: int = 50, query: Query = Query()) -> DataFrame:
    sx, sy = (box.east - box.west) / grid, (box.north - box.south) / grid
    cells = grid_cells(query.apply(reports), box, grid)
    return cells.select("gx", "gy", cell_centre(F.col("gx"), box.west, sx).alias("longitude"), cell_centre(F.col("gy"), box.south, sy).alias("latitude"), "n")


def density_by_degree(reports: DataFrame, size: float = 0.01) -> DataFrame:
    """Cells of a size in degrees, numbered from the reports' own south-west corner."""
    corner = reports.agg(F.min("longitude").alias("west"), F.min("latitude").alias("south"))
    rows = reports.join(F.broadcast(corner))
    return rows.groupBy(F.floor((F.col("longitude") - F.col("west")) / size).alias("gx"), F.floor((F.col("latitude") - F.col("south")) / size).alias("gy")).agg(F.count("*").alias("n"))


def sample_tracks(reports: DataFrame, ships: DataFrame, n_ships: int = 5, n_points: int = 50) -> DataFrame:
    """A few ships' thinned tracks, for demonstrations."""
    few = ships.orderBy("mmsi").limit(n_ships).select("mmsi")
    return points(thinned(reports.join(few, "mmsi", "left_semi"), n_points))
