"""The same analyses on streams of reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.context import STUDY, Box
from tidemark.functions.geo import cell, epoch
from tidemark.sources.versions import Table


def event_time(reports: DataFrame) -> DataFrame:
    """``ts``, the report's time as Spark's watermarks want it."""
    return reports.withColumn("ts", F.timestamp_seconds(epoch()))


def hopping(reports: DataFrame, size: str = "60 minutes", hop: str = "15 minutes", grid: int = 20, box: Box = STUDY, late: str = "10 minutes") -> DataFrame:
    """Reports and speeds by window and cell: playback as a table, for batches and streams alike."""
    sx, sy = (box.east - box.west) / grid, (box.north - box.south) / grid
    rows = event_time(reports.where(box.contains()))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size, hop).alias("w"), cell(F.col("longitude"), box.west, sx).alias("gx"), cell(F.col("latitude"), box.south, sy).alias("gy")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"))
    return out.select(F.unix_timestamp("w.start").alias("start_epoch"), F.unix_timestamp("w.end").alias("end_epoch"), "gx", "gy", "n", "mean_speed")


def deduplicated(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of (mmsi, time) within the watermark."""
    return event_time(reports).withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])


def trips(reports: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A ship's reports between silences."""
    rows = event_time(reports)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("mmsi", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"))
    return out.select("mmsi", F.unix_timestamp("w.start").alias("start_epoch"), F.unix_timestamp("w.end").alias("end_epoch"), "n", "mean_speed")


def latest_updates(reports: DataFrame, forget_after_s: int | None = None) -> DataFrame:
    """A stream of reports that are no older than any before of their ship, one a ship and micro-batch; write it in update mode.

    The state is one time a ship.  With ``forget_after_s`` that of ships silent
    so long goes, and a late report of theirs may then come up again, which
    ``latest_positions`` doesn't mind.  Reports without mmsi or time are left out.
    """

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.concat([f.sort_values(["timestamp", "longitude", "latitude"]).tail(1) for f in frames]).sort_values(["timestamp", "longitude", "latitude"]).tail(1)
        stamp = int(last["timestamp"].iloc[0].as_unit("us").value // 1000)
        if not state.exists or stamp >= state.get[0]:
            state.update((stamp,))
            yield last
        if forget_after_s is not None:
            state.setTimeoutDuration(1000 * forget_after_s)

    timeout = GroupStateTimeout.NoTimeout if forget_after_s is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = reports.where("mmsi IS NOT NULL AND timestamp IS NOT NULL")
    return rows.groupBy("mmsi").applyInPandasWithState(run, rows.schema, "stamp long", "update", timeout)


def latest_sink(path: str, stream: str = "latest", fold_after: int = 50):
    """A foreachBatch function that adds each batch's last report of every ship to a versioned table.

    A batch costs what its rows cost; once the table has ``fold_after`` folders
    they become one, with a row for each ship.  A batch that comes again after
    a restart isn't added twice.  Several streams into one table need names of
    their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, path)
        last = _last_of_each(batch.where("mmsi IS NOT NULL").withColumn("_batch", F.lit(number).cast("long")))
        version = table.add(last, (stream, number))
        if version and len(table.entry(version)["data"]) >= fold_after:
            table.change(_last_of_each)

    return write


def _last_of_each(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mmsi").agg(F.max_by(F.struct("*"), F.struct("timestamp", "_batch", F.struct("*"))).alias("r")).select("r.*")


def latest_positions(spark: SparkSession, path: str) -> DataFrame:
    """Each ship's last report, of all batches so far; a late batch moves no ship back."""
    return _last_of_each(Table(spark, path).read()).drop("_batch")
