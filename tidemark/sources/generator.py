"""Synthetic reports: ships on fairways and at anchor, one ship's track from its own seed."""

from __future__ import annotations

import argparse
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark import constants as C

FAIRWAYS = (((121.6, 31.4), (122.0, 31.0), (122.5, 30.7), (123.1, 30.5)), ((121.5, 30.0), (122.1, 30.3), (122.6, 30.9), (122.9, 31.4)), ((121.7, 30.6), (122.3, 30.55), (123.0, 30.1)))
ANCHORAGES = ((122.2, 30.9), (122.6, 30.3))
TYPES, WEIGHTS = ("bulk", "container", "tanker", "fishing", "passenger"), (0.30, 0.25, 0.20, 0.18, 0.07)
AT_ANCHOR, NOISE_DEG, STEP_DEG = 0.08, 0.0008, 0.0004
SCHEMA = "mmsi long, timestamp timestamp_ntz, longitude double, latitude double, speed double, course double, ship_type string, name string"


def resample(line: np.ndarray, step: float = STEP_DEG) -> np.ndarray:
    """Points at equal distances along a line."""
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    at = np.arange(0.0, along[-1], step)
    return np.stack([np.interp(at, along, line[:, k]) for k in (0, 1)], axis=1)


def track(ship: int, n: int, seed: int) -> pd.DataFrame:
    """One ship's reports."""
    rng = np.random.default_rng([seed, ship])
    kind = rng.choice(len(TYPES), p=WEIGHTS)
    gaps = rng.integers(30, 61, n)
    at = np.cumsum(gaps) + rng.integers(0, 3600)
    if rng.random() < AT_ANCHOR:
        pos = np.array(ANCHORAGES[rng.integers(len(ANCHORAGES))]) + rng.normal(0, 0.01, 2) + np.cumsum(rng.normal(0, 0.00005, (n, 2)), axis=0)
        speed = np.abs(rng.normal(0.1, 0.1, n))
    else:
        way = resample(np.array(FAIRWAYS[rng.integers(len(FAIRWAYS))]))
        way = np.concatenate([way, way[::-1]])  # out and back
        speed = np.clip(rng.normal(12, 3) + rng.normal(0, 0.5, n), 1, 30)
        metres = np.cumsum(speed * C.KN_TO_MS * gaps)
        pos = way[(rng.integers(len(way)) + metres / (STEP_DEG * C.M_PER_DEG)).astype(int) % len(way)]
    pos = pos + rng.normal(0, NOISE_DEG, (n, 2))
    d = np.diff(pos, axis=0, append=pos[-1:] * 2 - pos[-2:-1] if n > 1 else pos[-1:])
    course = (np.degrees(np.arctan2(d[:, 0], d[:, 1])) + 360) % 360
    return pd.DataFrame({"mmsi": 200_000_000 + ship, "timestamp": pd.Timestamp("2024-06-01") + pd.to_timedelta(at, unit="s"), "longitude": pos[:, 0], "latitude": pos[:, 1], "speed": speed, "course": course, "ship_type": TYPES[kind], "name": f"{TYPES[kind].upper()}{ship:04d}"})


def generate(spark: SparkSession, n_ships: int = 1200, n_points: int = 1_200_000, seed: int = 42) -> DataFrame:
    """``n_points`` reports of ``n_ships`` ships; the same seed gives the same rows however they are spread."""
    each, more = divmod(n_points, n_ships)
    def tracks(batches):
        for batch in batches:
            for ship in batch["id"]:
                if n := each + (ship < more):
                    yield track(int(ship), int(n), seed)

    return spark.range(n_ships).mapInPandas(tracks, SCHEMA)


class Ships(InputPartition):
    """Ships from ``first`` to before ``end``."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class TrackSource(DataSource):
    """``spark.read.format("tidemark")``: the rows of ``generate``; register it with ``spark.dataSource.register(TrackSource)``.

    Options: ``ships``, ``points``, ``seed`` and ``partitions``, which deals out ships and changes no row.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        given = {k: int(self.options.get(k, least)) for k, least in (("ships", 1200), ("points", 1_200_000), ("seed", 42), ("partitions", 8))}
        if given["ships"] < 1 or given["points"] < 0 or given["partitions"] < 1:
            raise ValueError(f"ships and partitions have to be 1 or more, points 0 or more: {given}")
        return TrackReader(schema, **given)


class TrackReader(DataSourceReader):
    def __init__(self, columns: StructType, ships: int, points: int, seed: int, partitions: int):
        self.columns, self.ships, self.points, self.seed, self.parts = columns, ships, points, seed, min(partitions, ships)

    def partitions(self) -> list[InputPartition]:
        edges = [k * self.ships // self.parts for k in range(self.parts + 1)]
        return [Ships(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Ships) -> Iterator[pa.RecordBatch]:
        each, more = divmod(self.points, self.ships)
        for ship in range(partition.first, partition.end):
            if n := each + (ship < more):
                yield pa.RecordBatch.from_pandas(track(ship, n, self.seed), schema=to_arrow_schema(self.columns), preserve_index=False)


def ships_of(reports: DataFrame) -> DataFrame:
    """The ships of generated reports, with sizes by their number."""
    return reports.groupBy("mmsi").agg(F.first("name").alias("name"), F.first("ship_type").alias("ship_type")).withColumns({"length": (50 + F.col("mmsi") % 300).cast("double"), "width": (8 + F.col("mmsi") % 40).cast("double")})


def main() -> None:
    p = argparse.ArgumentParser(description="Write synthetic reports as Parquet.")
    p.add_argument("out")
    p.add_argument("--ships", type=int, default=1200)
    p.add_argument("--points", type=int, default=1_200_000)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    generate(spark, a.ships, a.points, a.seed).write.parquet(a.out)
    found = spark.read.parquet(a.out).count()
    if found != a.points:
        raise SystemExit(f"{found} rows written, {a.points} asked for")


if __name__ == "__main__":
    main()
