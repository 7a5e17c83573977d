"""Rates of turn: between reports, or over fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import STUDY, Box
from tidemark.functions.geo import epoch, wrap_deg
from tidemark.functions.quantile import with_percentile
from tidemark.sources.shared import cut


def base(reports: DataFrame, window_min: int = C.ROT_WINDOW_MIN, max_gap_s: int = C.ROT_MAX_GAP_S) -> DataFrame:
    """mmsi, ship_type, longitude, latitude, speed, course, hour, dt_s, d_course, rot (degrees a minute).

    Window 0: each report against the ship's one before, gaps up to
    ``max_gap_s``.  Otherwise the last against the first report of each window,
    if they are more than half of it apart.
    """
    rows = reports.withColumn("_at", epoch())
    if window_min <= 0:
        track = Window.partitionBy("mmsi").orderBy("timestamp")
        rows = rows.withColumns({"dt_s": F.col("_at") - F.lag("_at").over(track), "d_course": wrap_deg(F.col("course") - F.lag("course").over(track)), "hour": F.hour("timestamp")})
        low, high = 0, max_gap_s
    else:
        size = max(60, window_min * 60)
        last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
        known = F.when(F.col("course").isNotNull(), F.col("_at"))
        rows = rows.groupBy("mmsi", F.floor(F.col("_at") / size).alias("_w")).agg(
            *map(last, ("ship_type", "longitude", "latitude", "speed")),
            F.max_by("course", known).alias("course"),
            wrap_deg(F.max_by("course", known) - F.min_by("course", known)).alias("d_course"),
            F.hour(F.max("timestamp")).alias("hour"),
            (F.max("_at") - F.min("_at")).alias("dt_s"),
        )
        low, high = size // 2, max(max_gap_s, size)
    rows = rows.where((F.col("dt_s") > low) & (F.col("dt_s") <= high))
    return rows.select("mmsi", "ship_type", "longitude", "latitude", "speed", "course", "hour", "dt_s", "d_course", (F.col("d_course") / (F.col("dt_s") / 60.0)).alias("rot"))


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def statistics(rows: DataFrame, maneuver: float = C.ROT_MANEUVER, steady: float = C.ROT_STEADY) -> DataFrame:
    r, a = F.col("rot"), F.abs("rot")
    also = (
        F.count("*").alias("n"), F.avg(a).alias("mean_abs"), F.stddev_samp("rot").alias("stddev"), F.max(a).alias("max_abs"),
        _share(a >= maneuver).alias("maneuver_ratio"), _share(r <= -maneuver).alias("left_ratio"), _share(r >= maneuver).alias("right_ratio"), _share(a < steady).alias("steady_ratio"),
        F.avg("rot").alias("mean"), F.avg("dt_s").alias("mean_dt_s"),
    )
    return with_percentile(cut(rows.select("rot", "dt_s")), a, 0.95, name="p95_abs", also=also)


def noise_amplification(reports: DataFrame, window_min: int = C.ROT_WINDOW_MIN) -> DataFrame:
    """Mean size of the rate between reports, over windows, and their ratio."""
    p = base(reports, 0).agg(F.avg(F.abs("rot")).alias("pointwise"))
    w = base(reports, window_min).agg(F.avg(F.abs("rot")).alias("windowed"))
    return p.join(F.broadcast(w)).withColumn("amplification", F.try_divide("pointwise", "windowed"))


def by_type(rows: DataFrame, maneuver: float = C.ROT_MANEUVER) -> DataFrame:
    a = F.abs("rot")
    rows = cut(rows.select(F.coalesce("ship_type", F.lit(C.UNKNOWN_TYPE)).alias("ship_type"), "rot"))
    also = (F.count("*").alias("n"), F.avg(a).alias("mean_abs"), _share(a >= maneuver).alias("maneuver_ratio"))
    return with_percentile(rows, a, 0.95, ("ship_type",), "p95_abs", also)


def grid(rows: DataFrame, cells: int = 40, box: Box = STUDY, maneuver: float = C.ROT_MANEUVER) -> DataFrame:
    """By cell, border cells taking what lies beyond; positions are the reports' means."""
    cells = min(400, max(2, cells))
    sx, sy = (box.east - box.west) / cells, (box.north - box.south) / cells
    at = lambda c, low, s: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / s))).cast("int")
    a = F.abs("rot")
    return rows.groupBy(at("longitude", box.west, sx).alias("gx"), at("latitude", box.south, sy).alias("gy")).agg(F.count("*").alias("n"), F.avg(a).alias("mean_abs"), _share(a >= maneuver).alias("maneuver_ratio"), F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"))


def distribution(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Equal bins up to the 99th percentile, larger rates in the last one, empty bins included."""
    a = F.abs("rot")
    if bins < 1:
        raise ValueError("there has to be a bin")
    rows = cut(rows.select("rot"))
    top = with_percentile(rows, a, 0.99, name="top")
    x = rows.join(F.broadcast(top)).select(F.when(F.col("top") > 0, F.least(F.floor(a / (F.col("top") / bins)), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin"))
    counts = x.groupBy("bin").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").join(F.broadcast(top)).select("bin", (F.col("bin") * (F.col("top") / bins)).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def sample(rows: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """The same n rows each time: the first by hash of ship, hour and position; then rows with a null are left out."""
    n = min(20_000, max(1, n))
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long").cast("string")
    key = F.md5(F.concat_ws("|", F.col("mmsi").cast("string"), F.col("hour").cast("string"), micro("longitude"), micro("latitude"), F.lit(str(seed))).cast("binary"))
    chosen = rows.withColumn("_k", key).orderBy("_k", "dt_s").limit(n).drop("_k")
    return chosen.dropna(subset=["speed", "course", "rot", "longitude", "latitude", "ship_type"])


def axis_ranges(rows: DataFrame) -> DataFrame:
    """(axis, low, high) of the numeric axes of a multivariate sample."""
    axes = ["speed", "course", "rot", "longitude", "latitude", "hour"]
    one = rows.agg(*(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"low_{a}").alias("low"), F.col(f"high_{a}").alias("high")) for a in axes))).alias("x")).select("x.*")


def axis_categories(rows: DataFrame) -> DataFrame:
    """(axis, place, category): the distinct values of a sample's categorical axis, in order; a row to each."""
    kinds = rows.agg(F.sort_array(F.collect_set("ship_type")).alias("kinds"))  # of a sample, which has a bounded size
    return kinds.select(F.lit("ship_type").alias("axis"), F.posexplode("kinds").alias("place", "category"))
