"""Places and running sums in tracks of any length, without one task that holds a whole track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``_n``, the place from 0 in their ``group``, and ``_all``, the group's number of rows.

    One range shuffle by (group, order) puts rows in order inside partitions;
    what a group has in the partitions before is added from their counts, of
    which there are no more than partitions and groups together.  Rows that
    agree in group and order have arbitrary places among each other.
    """
    at = F.monotonically_increasing_id()
    laid = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid = cut(laid.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int")))
    held = laid.groupBy(F.col(group).alias("_of"), F.col("_part").alias("_of_part")).agg(F.min("_at").alias("_least"), F.count("*").alias("_held"))
    own = Window.partitionBy("_of")
    before = F.sum("_held").over(own.orderBy("_of_part")) - F.col("_held")
    starts = cut(held.select("_of", "_of_part", (F.col("_least") - before).alias("_shift"), F.sum("_held").over(own).alias("_all")))
    same = F.col(group).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_of_part"))
    return laid.join(starts, same).withColumn("_n", F.col("_at") - F.col("_shift")).drop("_at", "_part", "_of", "_of_part", "_shift")


def along(rows: DataFrame, group: str, step: Column, size: int, *needs: str) -> DataFrame:
    """``rows`` (as from ``placed``) with ``_piece``, and ``_t``, the sum of ``step`` from the group's start to each row.

    ``step`` tells a row's distance from the row before, whose ``needs`` are at
    hand as ``_before.<name>`` (null for a group's first row).  Windows cover
    pieces of ``size`` rows; a second sum goes over the pieces.
    """
    rows = rows.withColumn("_piece", F.floor(F.col("_n") / size).cast("long"))
    edge = rows.where((F.col("_n") + 1) % size == 0).select(F.col(group).alias("_of"), (F.col("_piece") + 1).alias("_next"), F.struct(*needs).alias("_edge"))
    rows = rows.join(edge, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_next")), "left").drop("_of", "_next")
    piece = Window.partitionBy(group, "_piece").orderBy("_n")
    rows = rows.withColumn("_before", F.coalesce(F.lag(F.struct(*needs)).over(piece), F.col("_edge"))).withColumn("_step", F.coalesce(step, F.lit(0.0)))
    rows = cut(rows.withColumn("_t", F.sum("_step").over(piece)).drop("_before", "_edge", "_step"))
    sums = rows.groupBy(F.col(group).alias("_of"), F.col("_piece").alias("_next")).agg(F.max("_t").alias("_sum"))
    whole = Window.partitionBy("_of")
    starts = cut(sums.select("_of", "_next", (F.sum("_sum").over(whole.orderBy("_next")) - F.col("_sum")).alias("_from"), F.sum("_sum").over(whole).alias("_length")))
    same = F.col(group).eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_next"))
    return rows.join(starts, same).withColumn("_t", F.col("_t") + F.col("_from")).drop("_of", "_next", "_from")
