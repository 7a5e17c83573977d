"""Reading reports and ships, and their projection from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import REPORTS, SHIPS
from tidemark.sources import versions


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, REPORTS)


def read_ships(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, SHIPS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark is no part of the first name."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, as text columns."""
    df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return df


def ship_rows(raw: DataFrame) -> DataFrame:
    """Ships from text columns: rows with an mmsi and a name; missing sizes are 0."""
    have = set(raw.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    size = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)") if c in have else F.lit(None).cast("double"), F.lit(0.0)).alias(c)
    return raw.where("coalesce(trim(mmsi), '') <> '' AND coalesce(trim(name), '') <> ''").select(F.expr("cast(try_cast(mmsi AS double) AS long)").alias("mmsi"), "name", F.coalesce(text("ship_type"), F.lit("")).alias("ship_type"), size("length"), size("width"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("((timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000000) - 1704067200) div 600")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", t.alias("t"))


_TYPE = "CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'bulk' WHEN user_id % 5 = 1 THEN 'container' WHEN user_id % 5 = 2 THEN 'tanker' WHEN user_id % 5 = 3 THEN 'fishing' ELSE 'passenger' END"


def projected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from the event table: users are ships, 600 seconds are one; repeats of (mmsi, timestamp) are left in."""
    return _events(spark, sf_dir).select(
        "event_id",
        F.expr("200000000 + user_id").alias("mmsi"),
        F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00' + make_dt_interval(0, 0, 0, t)").alias("timestamp"),
        F.expr("121.4D + cast((user_id * 79190 + t * (3 + user_id % 11)) % 180000 AS double) / 100000D").alias("longitude"),
        F.expr("29.7D + cast((user_id * 57130 + t * (2 + user_id % 7)) % 180000 AS double) / 100000D").alias("latitude"),
        F.expr("value / 6D").alias("speed"),
        F.expr("cast((user_id * 530 + t * (1 + user_id % 4)) % 3600 AS double) / 10D").alias("course"),
        F.expr(_TYPE).alias("ship_type"),
        F.expr("concat('SHIP', cast(user_id AS string))").alias("name"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection without repeats: the first event of each (mmsi, timestamp)."""
    first = Window.partitionBy("mmsi", "timestamp").orderBy("event_id")
    return projected_reports(spark, sf_dir).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id").distinct().select(
        F.expr("200000000 + user_id").alias("mmsi"),
        F.expr("concat('SHIP', cast(user_id AS string))").alias("name"),
        F.expr(_TYPE).alias("ship_type"),
        F.expr("cast(50 + user_id % 350 AS double)").alias("length"),
        F.expr("cast(8 + user_id % 45 AS double)").alias("width"),
    )


def sql_views(spark: SparkSession, reports_df: DataFrame, ships_df: DataFrame) -> None:
    """Temporary views ``trajectories`` and ``ships``."""
    reports_df.createOrReplaceTempView("trajectories")
    ships_df.createOrReplaceTempView("ships")


#: The same projection in SQL, to be put before a query on ``ais``, ``raw`` or ``ships``.
PROJECTION_SQL = f"""WITH RECURSIVE ev AS (SELECT *, (epoch_us(ts) // 1000000 - 1704067200) // 600 AS t FROM events),
raw AS (SELECT event_id, 200000000 + user_id AS mmsi, 1717200000 + t AS epoch, make_timestamp((1717200000 + t) * 1000000) AS timestamp,
 CAST(121.4 AS DOUBLE) + CAST((user_id * 79190 + t * (3 + user_id % 11)) % 180000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS longitude,
 CAST(29.7 AS DOUBLE) + CAST((user_id * 57130 + t * (2 + user_id % 7)) % 180000 AS DOUBLE) / CAST(100000 AS DOUBLE) AS latitude,
 value / CAST(6 AS DOUBLE) AS speed, CAST((user_id * 530 + t * (1 + user_id % 4)) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) AS course,
 {_TYPE} AS ship_type, concat('SHIP', CAST(user_id AS VARCHAR)) AS name FROM ev),
ais AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY mmsi, timestamp ORDER BY event_id) = 1),
ships AS (SELECT DISTINCT 200000000 + user_id AS mmsi, concat('SHIP', CAST(user_id AS VARCHAR)) AS name, {_TYPE} AS ship_type,
 CAST(50 + user_id % 350 AS DOUBLE) AS length, CAST(8 + user_id % 45 AS DOUBLE) AS width FROM ev)"""
