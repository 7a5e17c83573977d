"""Connected components of a distributed edge list by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014):
large-star links the larger neighbours of each node to its smallest one,
small-star links the smaller ones; the rounds end when no edge changes.  No
step holds more than edges and counts, and nothing but two numbers a round
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, smallest node of its tree), of the edges (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _local_forest(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Each task replaces the edges it reads by spanning forests, at most ``most`` edges at a time."""

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (0, 1))
        u, v = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            held = [reduced(held)]
            if held[0].num_rows >= most // 2:
                yield held.pop()
    if held:
        yield reduced(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns ``u``, ``v``).

    ``component`` is the smallest node that can be reached, the node itself
    included.  Null ends and loops are ignored; repeated edges change nothing;
    an empty edge list gives an empty frame.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    e = cut(e.mapInArrow(_local_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: (u, v) with v > u  ->  (v, m(u))
        large = (
            e.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small-star: the smaller neighbours of u, and u itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if now == seen and now[0] == now[2]:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
