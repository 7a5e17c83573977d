"""Twelve indicators of an area's traffic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.quantile import with_percentile
from tidemark.operators import kde
from tidemark.sources.shared import cut


def _sector() -> Column:
    return F.floor((F.coalesce("course", F.lit(0.0)) % 360.0) / (360.0 / C.SECTORS))


def scorecard_base(reports: DataFrame, *more: Column) -> DataFrame:
    """Counts and speeds of the reports, and other aggregates taken in the same pass."""
    s = F.col("speed")
    also = (
        F.count("*").alias("point_count"), F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_speed_kn"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("speed_std_kn"),
        F.coalesce(F.avg(F.when(s < C.CONGESTED_KN, 1.0).otherwise(0.0)), F.lit(0.0)).alias("congestion_ratio"), *more,
    )
    ships = reports.agg(F.count_distinct("mmsi").alias("ship_count"))  # beside the sketch, a distinct count would keep a sketch a ship
    return with_percentile(reports, s, 0.95, name="speed_p95_kn", also=also).join(F.broadcast(ships)).withColumn("speed_p95_kn", F.coalesce("speed_p95_kn", F.lit(0.0)))


def course_entropy(reports: DataFrame) -> DataFrame:
    """Shannon entropy of the course sectors in bits, and as a share of its most."""
    counts = reports.groupBy(_sector().alias("sector")).agg(F.count("*").alias("n")).where(F.col("sector").between(0, C.SECTORS - 1))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    h = counts.select((-p * F.log2(p)).alias("h")).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("course_entropy_bits"))
    return h.withColumn("flow_balance", F.col("course_entropy_bits") / math.log2(C.SECTORS))


def _entropy(counts: Column) -> Column:
    """Bits of a list of counts; 0 without any."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0))


def route_concentration(points: DataFrame, share: float = 0.05) -> DataFrame:
    """How much of the density the densest twentieth of a surface's points holds; a surface has grid**2 points at most."""
    whole = Window.partitionBy(F.lit(0))
    ranked = points.select("density", F.row_number().over(whole.orderBy(F.desc(F.round("density", 9)), "gx", "gy")).alias("k"), F.count("*").over(whole).alias("n"))
    top = F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("density")).otherwise(0.0)
    return ranked.agg(F.coalesce(F.try_divide(F.sum(top), F.sum("density")), F.lit(0.0)).alias("route_concentration"))


def scorecard(reports: DataFrame, raster: kde.Raster) -> DataFrame:
    """(indicator, value): twelve rows.

    Four passes over the reports: one for the density, whose bins serve three
    indicators, one to count ships, and two for all that is counted by report.
    """
    cells = cut(kde.density(reports, raster))
    sectors = F.array(*(F.count_if(_sector() == k) for k in range(C.SECTORS))).alias("sectors")
    one = scorecard_base(reports, sectors).join(F.broadcast(route_concentration(kde.surface_of(cells, raster)))).join(F.broadcast(kde.summary_of(cells, raster)))
    one = one.withColumn("course_entropy_bits", _entropy(F.col("sectors"))).withColumns({"flow_balance": F.col("course_entropy_bits") / math.log2(C.SECTORS), "speed_cv": F.when(F.col("avg_speed_kn") > 0, F.col("speed_std_kn") / F.col("avg_speed_kn")).otherwise(0.0), "avg_density_nm2": F.coalesce("mean_density", F.lit(0.0)), "max_density_nm2": F.coalesce("bin_peak", F.lit(0.0))})
    names = ["ship_count", "point_count", "avg_speed_kn", "speed_std_kn", "speed_cv", "speed_p95_kn", "avg_density_nm2", "max_density_nm2", "flow_balance", "course_entropy_bits", "route_concentration", "congestion_ratio"]
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")


def layer_maxima(density: DataFrame, conflicts: DataFrame, turns: DataFrame) -> DataFrame:
    """One row of the values that map layers are scaled by; those of conflicts and turns are 1 at least."""
    at_least_one = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(1)), F.lit(1))
    one = density.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_density"))
    crowds = conflicts.agg(at_least_one("n").alias("max_conflicts"), at_least_one("severe").alias("max_severe"))
    return one.join(F.broadcast(crowds)).join(F.broadcast(turns.agg(at_least_one("n").alias("max_samples"))))


def underway_share(behaviour: DataFrame) -> DataFrame:
    """Per cent of the reports with a speed that are under way, 0 without any, beside the counts."""
    known = F.col("anchored") + F.col("maneuvering") + F.col("underway")
    return behaviour.withColumn("underway_pct", F.coalesce(F.try_divide(F.col("underway") * 100.0, known), F.lit(0.0)))
