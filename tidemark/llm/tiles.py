"""Pairs of tiles: whatever shares a key, compared in blocks of bounded size.

Members of a key are laid out by ``band``, a whole number so chosen that only
members of the same or of neighbouring bands can match; pairs of tiles further
apart are skipped without loss.  A band with more than ``tile`` members is
split by hash, so no task ever holds more than two tiles of a key at once,
however many members the key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut


def tile_pairs(members: DataFrame, tile: int, attach: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(x, y, same) from (key, band, m): lists of members to be compared, each pair of tiles once.

    ``m`` is a struct with an ``id``.  Where ``same`` holds, ``y`` is empty and
    ``x`` is to be compared with itself.  ``attach`` adds to ``m`` what isn't
    needed to deal members out.
    """
    sizes = cut(members.groupBy("key", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")))
    split = sizes.where("chunks > 1")
    dealt = members.join(split, ["key", "band"], "left").withColumn("chunk", F.pmod(F.xxhash64("m.id", F.lit(11)), F.coalesce("chunks", F.lit(1))).cast("int"))
    tiles = cut(attach(dealt).groupBy("key", "band", "chunk").agg(F.collect_list("m").alias("x")))
    none = F.array().cast(tiles.schema["x"].dataType)
    own = tiles.where(F.size("x") > 1).select("x", none.alias("y"), F.lit(True).alias("same"))
    # only keys with several tiles have pairs of them; most keys don't
    several = sizes.groupBy("key").agg(F.sum("chunks").alias("n")).where("n > 1").select("key")
    many = tiles.join(several, "key", "left_semi")
    left = many.select("key", F.col("band").alias("band1"), F.col("chunk").alias("chunk1"), F.col("x").alias("x1"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    across = left.join(many, ["key", "band"]).where("band > band1 OR chunk > chunk1").select(F.col("x1").alias("x"), F.col("x").alias("y"), F.lit(False).alias("same"))
    return own.union(across)
