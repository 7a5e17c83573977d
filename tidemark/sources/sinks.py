"""Writing reports and ships: merging into Parquet, CSV export, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import cleaning
from tidemark.sources.shared import cut
from tidemark.sources.tables import read_csv, read_json, ship_rows
from tidemark.sources.versions import Table

REPORT_KEY, SHIP_KEY = ("mmsi", "timestamp"), ("mmsi",)


def merged(old: DataFrame, new: DataFrame, key: tuple[str, ...], latest: str | None = None) -> DataFrame:
    """Old and new rows, one for each key; new ones win, or those with the greatest ``latest``. Nothing is left of how."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    rank = Window.partitionBy(*key).orderBy(*([F.desc_nulls_last(latest)] if latest else []), F.desc("_new"), *(F.desc(c) for c in old.columns if c not in key))
    return both.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_new", "_n")


def upsert(spark: SparkSession, path: str, new: DataFrame, key: tuple[str, ...], latest: str | None = None) -> int:
    """Merge rows into a versioned table as its next version, or create it (then repeats in ``new`` stay); returns the version.

    Readers see the version before until the new one is whole.  Of two writers
    the second merges again into what the first one wrote.  A plain Parquet
    folder is taken over; its files stay until ``Table.vacuum``.
    """
    return Table(spark, path).change(lambda old: new if old is None else merged(old, new, key, latest))


def import_ships(spark: SparkSession, source: str, path: str) -> None:
    raw = read_json(spark, source) if source.endswith(".json") else read_csv(spark, source)
    upsert(spark, path, ship_rows(raw), SHIP_KEY)


def import_reports(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Clean and merge a CSV or JSON file; returns the cleaning report. The file is read and cleaned once, into the shared folder."""
    raw = read_json(spark, source) if source.endswith(".json") else read_csv(spark, source)
    marked = cut(cleaning.judged(cleaning.typed(raw)))
    upsert(spark, path, cleaning.kept(marked), REPORT_KEY)
    return cleaning.report(marked)


def export_csv(df: DataFrame, path: str, limit: int | None = None, order: tuple[str, ...] = ("mmsi", "timestamp")) -> None:
    """CSV with a header; a limit takes the first rows in a fixed order."""
    if limit is not None:
        df = df.orderBy(*order).limit(max(1, min(limit, 2_000_000)))
    df.write.option("header", True).csv(path)
