"""Kernel density of reports: counts in fine bins, smoothed along one axis and then the other."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import STUDY, Box
from tidemark.sources.shared import cut


def gaussian(sigma: float) -> list[float]:
    """Weights at -r..r, r = ceil(3 sigma), that sum to 1; [1.0] without a width."""
    if sigma <= 0:
        return [1.0]
    r = math.ceil(3 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / math.fsum(w) for x in w]


@dataclass(frozen=True)
class Raster:
    """The bins of a density surface. Degenerate parameters raise."""

    box: Box = STUDY
    bandwidth: float = 0.02
    grid: int = 80
    bin_size: float | None = None

    def __post_init__(self) -> None:
        if self.bandwidth <= 0:
            raise ValueError("bandwidth must be positive")
        if self.box.west >= self.box.east or self.box.south >= self.box.north:
            raise ValueError("the box is empty")
        if self.bin_size is not None and self.bin_size <= 0:
            raise ValueError("bin size must be positive")

    @property
    def step(self) -> float:
        return self.bandwidth / 3 if self.bin_size is None else self.bin_size

    @property
    def nx(self) -> int:
        return max(2, round((self.box.east - self.box.west) / self.step))

    @property
    def ny(self) -> int:
        return max(2, round((self.box.north - self.box.south) / self.step))

    @property
    def bin_nm2(self) -> float:
        lat0 = (self.box.south + self.box.north) / 2
        wide = (self.box.east - self.box.west) / self.nx * C.KDE_KM_PER_DEG * math.cos(math.radians(lat0)) * C.KDE_NM_PER_KM
        high = (self.box.north - self.box.south) / self.ny * C.KDE_KM_PER_DEG * C.KDE_NM_PER_KM
        return wide * high

    @property
    def kernel(self) -> list[float]:
        return gaussian(self.bandwidth / self.step)


def bins(reports: DataFrame, raster: Raster) -> DataFrame:
    """(ix, iy, n): non-empty bins; the last ones include the far edge."""
    b = raster.box
    at = lambda c, low, high, n: F.least(F.floor((F.col(c) - low) / (high - low) * n), F.lit(n - 1)).cast("int")
    inside = reports.where(b.contains())
    return inside.groupBy(at("longitude", b.west, b.east, raster.nx).alias("ix"), at("latitude", b.south, b.north, raster.ny).alias("iy")).agg(F.count("*").alias("n"))


def _spread(cells: DataFrame, axis: str, n: int, kernel: list[float]) -> DataFrame:
    """One axis of the convolution; what falls beyond the raster is cut off."""
    r = len(kernel) // 2
    other = "iy" if axis == "ix" else "ix"
    weights = F.explode(F.array(*(F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel))))
    moved = cells.select("ix", "iy", "v", weights.alias("k")).select((F.col(axis) + F.col("k.d")).alias(axis), other, (F.col("v") * F.col("k.w")).alias("v"))
    return moved.where(F.col(axis).between(0, n - 1)).groupBy("ix", "iy").agg(F.sum("v").alias("v"))


def density(reports: DataFrame, raster: Raster) -> DataFrame:
    """(ix, iy, density): reports a square nautical mile in every bin that the kernel reaches."""
    cells = bins(reports, raster).select("ix", "iy", F.col("n").cast("double").alias("v"))
    for axis, n in (("ix", raster.nx), ("iy", raster.ny)):
        cells = _spread(cells, axis, n, raster.kernel)
    return cells.select("ix", "iy", (F.col("v") / raster.bin_nm2).alias("density"))


def surface(reports: DataFrame, raster: Raster) -> DataFrame:
    """(gx, gy, longitude, latitude, density) on a grid, each point taking its bin; empty ones are left out."""
    return surface_of(density(reports, raster), raster)


def surface_of(cells: DataFrame, raster: Raster) -> DataFrame:
    """The surface of a ``density`` that is at hand."""
    b, g = raster.box, raster.grid
    spark = cells.sparkSession
    axis = lambda n, a: spark.range(g).select(F.col("id").cast("int").alias(f"g{a}"), F.expr(f"cast(cast(id * {n} AS double) / {g} AS int)").alias(f"i{a}"))
    rows = cells.join(F.broadcast(axis(raster.nx, "x")), "ix").join(F.broadcast(axis(raster.ny, "y")), "iy").where("density > 1e-9")
    return rows.select("gx", "gy", (b.west + (F.col("gx") + 0.5) * ((b.east - b.west) / g)).alias("longitude"), (b.south + (F.col("gy") + 0.5) * ((b.north - b.south) / g)).alias("latitude"), "density")


def peaks(points: DataFrame, top: int = 10) -> DataFrame:
    return points.orderBy(F.desc(F.round("density", 9)), "gx", "gy").limit(top)


def summary(reports: DataFrame, raster: Raster) -> DataFrame:
    """Largest and mean density over all bins, empty ones included, the largest on the grid, and the area."""
    return summary_of(cut(density(reports, raster)), raster)


def summary_of(cells: DataFrame, raster: Raster) -> DataFrame:
    """The summary of a ``density`` that is at hand."""
    d = cells.agg(F.max("density").alias("bin_peak"), (F.sum("density") / (raster.nx * raster.ny)).alias("mean_density"))
    s = surface_of(cells, raster).agg(F.max("density").alias("grid_peak"), F.count("*").alias("points"))
    return d.join(F.broadcast(s)).withColumn("area_nm2", F.lit(raster.bin_nm2 * raster.nx * raster.ny))
