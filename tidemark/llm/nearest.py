"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get one more component that makes all lengths equal, so the largest
inner product is the smallest angle, and are coded by signs after learned
rotations (iterative quantisation, Gong and Lazebnik, CVPR 2011).  A code is
split into SUBSTRINGS, each indexed by value.  Codes within radius r of a query
differ by r // SUBSTRINGS bits or fewer in at least one substring, so probing
each index that far retrieves all of them (Norouzi et al., CVPR 2012); they are
then ranked by the exact inner product of the original vectors.

Rows are indexed in blocks, once: a block's codes and, by substring, its values
and which rows have them are written as a table.  Blocks of queries visit all
blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, map_arrow

ROTATIONS, SUBSTRINGS, BLOCK, QUERIES = 2, 8, 8192, 512
#: Rows that rotations and radius are fitted on, at most, by hash of the id.
SAMPLE = 12_000
#: Share of a sample's true neighbours that the radius must reach there.
REACH = 0.975


class Coder:
    """Rotations, radius and the length that all vectors are extended to."""

    def __init__(self, rotations: list[np.ndarray], length: float, radius: int):
        self.rotations, self.length, self.radius = rotations, length, radius

    def _extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.length**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        e = self._extended(x, query)
        bits = np.hstack([e @ r > 0 for r in self.rotations])
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % (16 * SUBSTRINGS))))
        return np.packbits(bits, axis=1).view(np.uint16)


def fit(x: np.ndarray, length: float, k: int, seed: int = 1, share: float = 1.0) -> Coder:
    """Learn rotations, and the radius that reaches REACH of the true neighbours.

    ``x`` is ``share`` of all rows, so k * share of a row's k nearest in the
    whole table are in ``x``, as its nearest there; the radius is measured on
    these (one at least).  It shrinks as the table grows denser.
    """
    rng = np.random.default_rng(seed)
    coder = Coder([], length, 0)
    e = coder._extended(x, False)
    width = min(e.shape[1], 16 * SUBSTRINGS // ROTATIONS)
    for _ in range(ROTATIONS):
        basis = np.linalg.qr(rng.normal(size=(e.shape[1], e.shape[1])))[0][:, :width]
        for _ in range(15):
            u, _, v = np.linalg.svd(e.T @ np.where(e @ basis > 0, 1.0, -1.0), full_matrices=False)
            basis = u @ v
        coder.rotations.append(basis)
    few = rng.permutation(len(x))[:300]
    scores = x[few] @ x.T
    scores[np.arange(len(few)), few] = -np.inf
    k = min(max(1, int(np.ceil(k * share))), max(1, len(x) - 1))
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    q, c = coder.codes(x[few], True), coder.codes(x)
    far = np.bitwise_count(q[:, None, :] ^ c[true]).sum(axis=2)
    coder.radius = int(np.quantile(far, REACH, method="higher")) if len(x) > 1 else 16 * SUBSTRINGS
    return coder


def _indexed(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The index of each substring of the codes ``c``: its values in order, and for each code the place of its own."""
    found = (np.unique(c[:, j], return_inverse=True) for j in range(c.shape[1]))
    return [(values, place.astype(np.uint16)) for values, place in found]


def _probe(q: np.ndarray, c: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], radius: int, k: int) -> np.ndarray:
    """For each query code (rows of ``q``) the flags of the codes ``c`` within the radius, and of the nearest ones where those are fewer than k."""
    near = np.zeros((len(q), len(c)), bool)
    for j, (values, place) in enumerate(index):
        hit = np.bitwise_count(q[:, j, None] ^ values[None, :]) <= radius // q.shape[1]
        near |= hit[:, place]
    wide_q, wide_c = q.view(np.uint64), c.view(np.uint64)
    far = np.zeros(near.shape, np.uint16)
    for j in range(wide_q.shape[1]):
        far += np.bitwise_count(wide_q[:, j, None] ^ wide_c[None, :, j])
    near &= far <= radius
    for row in np.flatnonzero(near.sum(axis=1) < min(k, len(c))):
        near[row] = far[row] <= np.partition(far[row], min(k, len(c)) - 1)[min(k, len(c)) - 1]
    return near


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows of ``vectors`` that probing finds.

    Both frames have vec_id and embedding.  Nearness is the largest inner
    product in double precision, ties go to the smaller vec_id, a query's own id
    is no candidate.  Rows without id, null or zero vectors, vectors with null or
    non-finite components, and those of another dimension than most take no
    part.  Where a block has fewer than k codes within the radius, its nearest
    codes join in, so a query has fewer than k results only if there are fewer
    candidates.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        e = F.col("embedding")
        df = df.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.where(F.coalesce(fine, F.lit(False))).where(F.exists(e, lambda v: v != 0))

    all_rows = sound(vectors)
    size = F.size("embedding")
    dims = all_rows.groupBy(size.alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (s, v) -> s + v * v)")).alias("sq")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = dims["d"], dims["n"]
    rows = all_rows.where(size == d)
    asked = sound(queries).where(size == d)
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    x = sample.column(0).combine_chunks().values.to_numpy().reshape(-1, d) if sample.num_rows else np.zeros((1, d))
    coder = fit(x, float(np.sqrt(dims["sq"])), k, share=min(1.0, len(x) / n))
    shared = spark.sparkContext.broadcast(coder)

    def blocks(df: DataFrame, count: int) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x")).select("block", F.col("x.vec_id").alias("ids"), F.flatten("x.embedding").alias("x"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = shared.value.codes(batch.column("x")[row].values.to_numpy().reshape(-1, d))
                values, places = ([a.tobytes() for a in side] for side in zip(*_indexed(codes), strict=True))
                arrays = [pa.array([codes.tobytes()], pa.binary()), *(pa.array([x], pa.list_(pa.binary())) for x in (values, places))]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns, *arrays], ["block", "ids", "x", "codes", "found", "places"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.codes(x.values.to_numpy().reshape(-1, d), True).tobytes() for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("x"), pa.array(found, pa.binary())], ["qids", "qx", "qcodes"])

    count = -(-n // BLOCK)
    asked_count = max(1, -(-asked.count() // QUERIES))
    block = "block long, ids array<long>, x array<double>"
    index = cut(map_arrow(blocks(rows, count), indexed, f"{block}, codes binary, found array<binary>, places array<binary>"))
    coded_queries = cut(map_arrow(blocks(asked, asked_count), coded, "qids array<long>, qx array<double>, qcodes binary"))
    visits = coded_queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = visits.join(index, "block").select("qids", "qx", "ids", "x", "qcodes", "codes", "found", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                qids, q, ids, x = (batch.column(c)[row].values.to_numpy() for c in range(4))
                q, x = q.reshape(-1, d), x.reshape(-1, d)
                qcodes, codes = (np.frombuffer(batch.column(c)[row].as_py(), np.uint16).reshape(-1, SUBSTRINGS) for c in (4, 5))
                found, places = (batch.column(c)[row].as_py() for c in (6, 7))
                substrings = [(np.frombuffer(v, np.uint16), np.frombuffer(p, np.uint16)) for v, p in zip(found, places, strict=True)]
                near = _probe(qcodes, codes, substrings, coder.radius, k + 1)
                out = []
                for qid, v, flags in zip(qids, q, near, strict=True):
                    at = np.flatnonzero(flags & (ids != qid))
                    score = (x[at] * v).sum(axis=1)
                    if len(at) > k:
                        least = np.partition(score, len(at) - k)[len(at) - k]
                        at, score = at[score >= least], score[score >= least]
                    best = np.lexsort((ids[at], -score))[:k]
                    out.append((np.full(len(best), qid), ids[at][best], score[best]))
                a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = map_arrow(pairs, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
