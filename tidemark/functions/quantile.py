"""Exact percentiles without holding a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut

#: The sketch's accuracy: a bracket holds about four in this many of a group's values, and those equal to its ends.
ACCURACY = 20_000
#: Ranges of the histogram that narrows a bracket.
SLICES = 4096


def with_percentile(rows: DataFrame, value: Column, share: float, by: tuple[str, ...] = (), name: str = "value", also: tuple[Column, ...] = ()) -> DataFrame:
    """(``by``..., the aggregates ``also``, ``name``): the linearly interpolated percentile of the values that aren't null, null where there are none.

    A sketch of bounded size, made in the pass of the other aggregates, brackets
    the percentile from both sides by more than its own error.  A second pass
    counts the values on either side and the distinct values inside, which are
    written down.  A histogram of those narrows the bracket again, to the one or
    two of ``SLICES`` equal ranges that hold the percentile, and only the values
    in there are put in order.  Without ``by`` there is one row, always.
    """
    by, edge = list(by), 2 / ACCURACY
    rows = rows.withColumn("_v", value.cast("double"))
    sketch = F.percentile_approx("_v", [max(0.0, share - edge), min(1.0, share + edge)], ACCURACY)
    first = rows.groupBy(*by).agg(*also, F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_b"))
    out = [c for c in first.columns if c not in by and not c.startswith("_")]
    low = F.col("_min") if share <= edge else F.col("_b")[0]
    high = F.col("_max") if share >= 1 - edge else F.col("_b")[1]
    first = first.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.struct("_n", *out).alias("_s"), low.alias("_low"), high.alias("_high"))
    on = F.lit(True)
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    near = rows.select(*by, "_v").join(first if by else F.broadcast(first), on)
    if not by:
        near = near.unionByName(first.withColumn("_v", F.lit(None).cast("double")))  # so that there is a row without any value
    # what lies below and above the bracket is one row each, so it is summed before the shuffle
    side = F.when(F.col("_v").isNull(), 2).when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    inside = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * SLICES), F.lit(0)), F.lit(SLICES - 1))
    counts = near.groupBy(*by, side.alias("_side"), F.when(side == 0, inside).otherwise(0).cast("int").alias("_slice"), F.when(side == 0, F.col("_v")).alias("_key")).agg(F.any_value("_s").alias("_s"), F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    counts = cut(counts.drop("_key"))
    nearest = F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))
    upto = lambda *of: F.sum("_c").over(Window.partitionBy(*of).orderBy("_side", "_slice", "_least").rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("_s._n").cast("double") - 1) * share
    rank = F.floor(at)
    slices = counts.groupBy(*by, "_side", "_slice").agg(F.any_value("_s").alias("_s"), F.sum("_c").alias("_c"), F.min("_least").alias("_least"))
    slices = slices.withColumn("_before", upto(*(by or [F.lit(0)])) - F.col("_c")).where((F.col("_before") <= rank + 1) & (F.col("_before") + F.col("_c") > rank))
    same = (F.col("_side") == F.col("_of_side")) & (F.col("_slice") == F.col("_of_slice"))
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{k}"))
    slices = slices.select(*(F.col(c).alias(f"_of{k}") for k, c in enumerate(by)), F.col("_side").alias("_of_side"), F.col("_slice").alias("_of_slice"), "_before")
    held = counts.join(slices, same)
    nth = lambda k: F.min(F.when(F.col("_upto") > rank + k, F.col("_v")))
    found = held.withColumns({"_upto": F.col("_before") + upto(*by, "_side", "_slice"), "_v": nearest}).groupBy(*by).agg(F.any_value("_s").alias("_s"), nth(0).alias("_a"), nth(1).alias("_z"))
    part = at - rank
    return found.select(*by, *(F.col(f"_s.{c}").alias(c) for c in out), F.when(part > 0, F.col("_a") + part * (F.col("_z") - F.col("_a"))).otherwise(F.col("_a")).alias(name))
