"""Cleaning imported reports: each row is charged to the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import STUDY, Box
from tidemark.functions.geo import epoch, haversine_km

REASONS = ("missing", "bounds", "duplicate", "overspeed", "jump")


def parse_timestamp(text: Column) -> Column:
    """Seconds or milliseconds since 1970 (beyond 1e12), or ISO text whose zone is dropped; null if neither."""
    text = F.trim(text)
    number = text.try_cast("double")
    seconds = F.floor(F.when(number > 1e12, number / 1000).otherwise(number)).cast("long")
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(?:Z|[+-]\d\d:?\d\d)$", "")
    day = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d+(?:\.\d+)?$"), day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).otherwise(F.date_trunc("second", plain.try_cast("timestamp_ntz")).cast("timestamp_ntz"))


def typed(raw: DataFrame) -> DataFrame:
    """Reports from text columns, with ``_order`` as they came; what can't be read is null."""
    have = set(raw.columns)
    number = lambda c: (F.col(c).try_cast("double") if c in have else F.lit(None).cast("double"))
    text = lambda c: F.coalesce(F.col(c).cast("string") if c in have else F.lit(None).cast("string"), F.lit(""))
    return raw.withColumn("_order", F.monotonically_increasing_id()).select(
        "_order", number("mmsi").cast("long").alias("mmsi"), parse_timestamp(F.col("timestamp").cast("string")).alias("timestamp"), number("longitude").alias("longitude"), number("latitude").alias("latitude"),
        F.coalesce(number("speed"), F.lit(0.0)).alias("speed"), F.coalesce(number("course"), F.lit(0.0)).alias("course"), text("ship_type").alias("ship_type"), text("name").alias("name"),
    )


def judged(rows: DataFrame, order: str = "_order", area: Box = STUDY) -> DataFrame:
    """The rows with ``reason``: null if kept.

    Rules in turn: a value missing, outside the area and its margin, a repeat of
    (mmsi, timestamp) in the order of arrival, too fast, too far from the ship's
    row before (the one before that passed the other rules, dropped as a jump or
    not).
    """
    m = C.CLEAN_MARGIN_DEG
    wide = Box(area.west - m, area.south - m, area.east + m, area.north + m)
    missing = F.col("mmsi").isNull() | F.col("timestamp").isNull() | F.col("longitude").isNull() | F.col("latitude").isNull()
    rows = rows.withColumn("reason", F.when(missing, "missing").when(~wide.contains(), "bounds"))
    # rows that passed so far stand apart from the others, so a repeat is one among them; the rest have keys of their own
    alone = F.when(F.col("reason").isNull(), F.lit(-1)).otherwise(F.col(order))
    same = Window.partitionBy("mmsi", "timestamp", alone).orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(same))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_n") > 1, "duplicate").when(F.col("speed") > C.MAX_SPEED_KN, "overspeed"))
    fine = F.col("reason").isNull()
    track = Window.partitionBy("mmsi", fine).orderBy("timestamp", order)
    lag = lambda c: F.lag(c).over(track)
    rows = rows.withColumns({"_lon": lag("longitude"), "_lat": lag("latitude"), "_s": epoch() - F.lag(epoch()).over(track)})
    kmh = haversine_km(F.col("_lon"), F.col("_lat"), F.col("longitude"), F.col("latitude")) / (F.col("_s") / 3600.0)
    jump = fine & (F.col("_s") > 0) & (kmh > C.MAX_JUMP_KMH)
    return rows.withColumn("reason", F.when(jump, "jump").otherwise(F.col("reason"))).drop("_n", "_lon", "_lat", "_s")


def kept(marked: DataFrame) -> DataFrame:
    return marked.where("reason IS NULL").drop("reason", "_order")


def report(marked: DataFrame) -> DataFrame:
    """(item, n): rows in, rows dropped by each rule, rows kept."""
    r = F.col("reason")
    one = marked.agg(F.count("*").alias("total"), *(F.count_if(r == x).alias(x) for x in REASONS), F.count_if(r.isNull()).alias("kept"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in ("total", *REASONS, "kept")))).alias("x")).select("x.*")
