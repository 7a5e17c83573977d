"""SimHash near-duplicates by tiled exact comparison.

Words of a text (split at ASCII white space, A-Z lower-cased) give shingles; a
fingerprint bit is 1 where more than half of the shingles' XXH64 values have it
set.  Two fingerprints link at ``radius`` differing bits or fewer.

Distinct fingerprints are laid out in tiles by population count, counted for
each quarter of the 64 bits: two fingerprints differ in at least as many bits
as their quarters' population counts differ in sum, so a pair of tiles whose
counts differ by more than the radius is skipped without loss.  Every other
pair of tiles is compared whole, with numpy's exclusive-or and bit count.  A
pair of tiles returns a spanning forest of its links, never all its pairs, so
large groups of copies stay linear in what they emit.

At a wide radius counts of bits rule nothing out.  ``keep_one`` therefore lays
out as tiles only documents that can be similar: those that share a block (two
least shingles under two orders; ``BLOCKS`` pairs of orders) and whose sets of
shingles have compatible population counts.  Inside, the comparison is the same
exact one of whole fingerprints, and the similarity of what it links is then
taken exactly, shingle by shingle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, forest
from tidemark.llm.frames import cut, map_arrow, raw_texts, slices
from tidemark.llm.tiles import tile_pairs

QUARTERS = 4
#: Fingerprints in a tile, at most about; larger cells of equal counts are split by hash.
TILE = 4096
#: Rows of a tile compared at a time.
_ROWS = 256
_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: Blocks a document is in. Of two sets with similarity s none is shared with probability (1 - s**2)**BLOCKS: 5 in a million at 0.8.
BLOCKS = 12
#: Documents in a tile of a block.
BLOCK_TILE = 512
#: Texts of a part whose sets are compared with another part's.
SET_TILE = 64
_ODD = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(2 * BLOCKS)]


def _more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of longer hashes made from 64-bit ones (SplitMix64's finaliser); the 0-th is the hash itself."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shingles(text: bytes, width: int) -> Iterator[bytes]:
    tokens = text.lower().split()
    if len(tokens) < width:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False))


def _majority(parts: Iterator[np.ndarray], words: int) -> list[int]:
    """The bits that more than half of some hashes have."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in parts:
        bits = np.unpackbits(np.stack([_more_bits(h, k) for k in range(words)], axis=1).view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64 * words).sum(axis=0, dtype=np.uint32)
        n += len(h)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()


def fingerprint(text: bytes, width: int = 3, words: int = 1) -> list[int]:
    """The SimHash of a text, as 64-bit words; all zero if it has no words."""
    return _majority(_chunks(map(_hash, _shingles(text, width))), words)


def _chunks(hashes: Iterator[int], size: int = 8192) -> Iterator[np.ndarray]:
    while part := list(itertools.islice(hashes, size)):
        yield np.array(part, dtype="<u8")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different shingles of a text, by hash, in order."""
    return np.unique(np.fromiter(map(_hash, _shingles(text, width)), np.uint64))


def set_sketch(shingles: np.ndarray, words: int) -> tuple[list[int], list[int]]:
    """SimHash of a set of shingles, and the keys of its blocks (none if it is empty)."""
    fp = _majority((shingles[k : k + 8192] for k in range(0, len(shingles), 8192)), words)
    if not len(shingles):
        return fp, []
    mixed = shingles ^ (shingles >> np.uint64(32))
    least = np.array([(mixed * np.uint64(odd)).min() for odd in _ODD], np.uint64)
    return fp, _more_bits(least[::2] * np.uint64(3) ^ least[1::2] + np.arange(BLOCKS, dtype=np.uint64), 1).view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as signed longs. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width, words) for x in raw_texts(batch)], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words, pa.int32()), pa.array(fp.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp array<long>")


def _offsets(radius: int, step: int) -> list[tuple[int, ...]]:
    """Differences of cells that a link may span, one of each pair (d, -d), and no difference."""
    most = -(-radius // step)
    least = lambda d: sum(max(0, (abs(x) - 1) * step + 1) if x else 0 for x in d)
    every = (d for d in itertools.product(range(-most, most + 1), repeat=QUARTERS) if least(d) <= radius)
    return [d for d in every if d >= (0,) * QUARTERS]


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Flags of the pairs that differ in ``radius`` bits or fewer."""
    x, y = x.view(np.uint64), y.view(np.uint64)  # numpy counts the bits of a signed number's size
    near = np.empty((len(x), len(y)), bool)
    for k in range(0, len(x), _ROWS):
        far = np.zeros((min(_ROWS, len(x) - k), len(y)), np.uint16)
        for w in range(x.shape[1]):
            far += np.bitwise_count(x[k : k + _ROWS, w, None] ^ y[None, :, w])
        near[k : k + _ROWS] = far <= radius
    return near


def _least(near: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """For each row the least label among its flags."""
    return np.concatenate([np.where(near[k : k + _ROWS], labels[None, :], most).min(axis=1) for k in range(0, len(near), _ROWS)])


def _close(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning set of the links between two tiles; y's indexes follow x's unless ``same``."""
    near = _near(x, y, radius)
    if same:
        near &= ~np.tri(len(x), dtype=bool)
    i, j = np.nonzero(near)
    if len(i) <= 4 * (len(x) + len(y)):
        return i, j if same else j + len(x)
    # dense: labels spread until they rest; each node is then tied to the node its label names
    if same:
        near |= near.T
    across = np.ascontiguousarray(near.T)
    a, b, most = np.arange(len(x)), np.arange(len(y)) + len(x), len(x) + len(y)
    if same:
        b = a
    while True:
        a2 = np.minimum(a, _least(near, b, most))
        b2 = a2 if same else np.minimum(b, _least(across, a2, most))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    labels = a if same else np.concatenate([a, b])
    own = np.flatnonzero(labels != np.arange(len(labels)))
    return own, labels[own]


def links(fps: DataFrame, radius: int = 2, words: int = 1, tile: int = TILE) -> DataFrame:
    """(u, v): links that span every component of distinct fingerprints (columns ``fp``, ``node``, one row each).

    A cell holds the fingerprints whose quarters have counts in the same steps;
    small radii have a step of one bit and skip most pairs of cells, for large
    ones there are few cells, and every pair of tiles in them is compared.
    """
    step, bits = max(1, radius // 2), 16 * words
    counts = []
    for k in range(QUARTERS):
        parts = [F.bit_count(F.shiftrightunsigned(F.get("fp", F.lit(b // 64)), b % 64).bitwiseAND(F.lit(0xFFFF))) for b in range(bits * k, bits * (k + 1), 16)]
        counts.append(F.floor(reduce(add, parts) / step).cast("int").alias(f"q{k}"))
    keyed = fps.select("fp", "node", *counts)
    q = [f"q{i}" for i in range(QUARTERS)]
    cells = cut(keyed.groupBy(*q).agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")))  # (bits + 1)**4 rows at most
    tiles = (
        keyed.join(cells, q)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
        .groupBy(*q, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("x"))
        .select(*q, "chunk", F.flatten("x.fp").alias("fp"), F.col("x.node").alias("node"))
    )
    tiles = cut(tiles)
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in _offsets(radius, step)))
    # a tile goes to each tile it has to meet, so that the work is dealt out by pairs of tiles, not by cells
    left = (
        tiles.select(*q, F.col("chunk").alias("c1"), F.col("fp").alias("fp1"), F.col("node").alias("node1"), F.explode(steps).alias("d"))
        .withColumn("own", F.expr(" AND ".join(f"d.d{i} = 0" for i in range(QUARTERS))))
        .select("c1", "fp1", "node1", "own", *((F.col(f"q{i}") + F.col(f"d.d{i}")).alias(f"q{i}") for i in range(QUARTERS)))
        .where(" AND ".join(f"{x} BETWEEN 0 AND {bits // step}" for x in q))
        .join(cells, q)
        .withColumn("chunk", F.explode(F.sequence(F.when(F.col("own"), F.col("c1")).otherwise(0), F.col("chunks") - 1)))
    )
    pairs = left.join(tiles, [*q, "chunk"]).select("fp1", "node1", "fp", "node", (F.col("own") & (F.col("c1") == F.col("chunk"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            cols = [batch.column(k) for k in range(4)]
            flat = [c.values.to_numpy() for c in cols]
            at = [c.offsets.to_numpy() for c in cols]
            for k, same in enumerate(batch.column(4).to_pylist()):
                x, xn, y, yn = (f[o[k] : o[k + 1]] for f, o in zip(flat, at, strict=True))
                i, j = _close(x.reshape(-1, words), y.reshape(-1, words), radius, same)
                if len(i):
                    nodes = xn if same else np.concatenate([xn, yn])
                    found.append((nodes[i], nodes[j]))
            if found:
                u, v = forest(*(np.concatenate(z) for z in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return map_arrow(pairs, lambda it: run(slices(it, 64)), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the document's
    own included.  Texts that are null, empty or without words have fingerprint
    zero and link like any other.  Rows with the same doc_id count as one
    document.  A row without doc_id keeps its fingerprint and gets the component
    of that fingerprint, null if no document with an id has it.
    """
    marked = cut(fingerprints(docs, width, words))
    known = marked.where("doc_id IS NOT NULL")
    # Rows of one doc_id with several texts tie their fingerprints together through that id.
    classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("node")))
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = known.join(several, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    comp = connected_components(links(classes, radius, words).union(tied))
    of_fp = cut(
        classes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    )
    return marked.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def _sketches(rows: DataFrame, width: int, words: int) -> DataFrame:
    """(doc_id, h, fp, n, keys) of rows (doc_id, h, text): fingerprint, count and blocks of each text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, width) for x in raw_texts(batch)]
            fps, keys = zip(*(set_sketch(x, words) for x in sets), strict=True) if sets else ((), ())
            fps = [np.array(x, np.uint64).view(np.int64).tolist() for x in fps]
            arrays = [batch.column("doc_id"), batch.column("h"), pa.array(fps, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "fp", "n", "keys"])

    return map_arrow(rows, run, "doc_id long, h long, fp array<long>, n long, keys array<long>")


def _nearest_tree(far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of least distances (Prim), over the pairs at most ``radius`` apart."""
    n = len(far)
    best, via, out = far[0].astype(np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    out[0], u, v = True, [], []
    for _ in range(n - 1):
        best[out] = np.iinfo(np.int64).max
        k = int(best.argmin())
        if best[k] <= radius:
            u.append(k)
            v.append(int(via[k]))
        else:  # nothing near: a new tree begins
            k = int((~out).argmax())
        out[k] = True
        nearer = far[k] < best
        best[nearer], via[nearer] = far[k][nearer], k
    return np.array(u, np.int64), np.array(v, np.int64)


def _tree(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray, same: bool, radius: int, share: float, groups: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a nearest spanning forest of the links between two tiles; y's indexes follow x's unless ``same``.

    Pairs whose sets' counts rule out the similarity ``share`` don't link.  With
    ``groups`` of x and y, all links between different groups are returned.
    """
    bits = [np.bitwise_count(z).sum(axis=1) for z in (x, y)]
    if not same and (bits[0].min() > bits[1].max() + radius or bits[1].min() > bits[0].max() + radius):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    far = np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[1]):
        far += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    none = np.iinfo(np.int64).max - 1
    far[np.minimum.outer(xn, yn) < share * np.maximum.outer(xn, yn) - 1e-9] = none
    if not (far <= radius).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if groups is not None:
        near = (far <= radius) & np.not_equal.outer(*groups)
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        return i, j if same else j + len(x)
    if not same:
        across = np.full((len(x) + len(y),) * 2, none, np.int64)
        across[: len(x), len(x) :] = far
        across[len(x) :, : len(x)] = far.T
        far = across
    return _nearest_tree(far, radius)


def similar(docs: DataFrame, share: float = 0.8, radius: int = 108, width: int = 5, words: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All fingerprints, classes of equal ones, and the links (u, v) between different ones whose similarity is at least ``share``.

    ``docs`` has doc_id (long), h (hash of the text) and text.  A class has its
    ``node``, fingerprint, count of shingles and first document (``first``).
    Of 64 * ``words`` bits two sets that share 0.8 of their shingles differ in
    0.15 on average; ``radius`` lies 3.7 standard deviations above.  Of the
    links in a pair of tiles a spanning forest of the nearest ones is looked at
    first and returned as far as its exact similarity is enough.  What holds
    together then needs no more looking at; where a link of a forest failed, all
    pairs within the radius that still lie apart are looked at as well.  So the
    links returned connect what all links between candidates would.
    """
    marked = cut(_sketches(docs, width, words))
    node = F.xxhash64("fp", F.lit(5))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h"))
    classes = cut(marked.groupBy("fp").agg(first.alias("first"), F.min("n").alias("n")).withColumn("node", node))
    postings = cut(marked.groupBy(node.alias("id"), "keys").agg(F.lit(1)).select("id", F.explode("keys").alias("key")).distinct())
    shared = cut(postings.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("ids")).where("ids > 1"))
    # most blocks hold two documents; those two meet once, however many blocks they share
    two = shared.where("ids = 2").select("lo", "hi").distinct().select(F.xxhash64("lo", "hi").alias("key"), F.explode(F.array("lo", "hi")).alias("id"))
    more = postings.join(shared.where("ids > 2").select("key"), "key", "left_semi").select("key", "id")
    # sets whose counts are in neighbouring bands, or the same one, can be similar enough
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.log(F.lit(1 / share + 1e-9))).cast("int")
    members = two.union(more).join(classes.select(F.col("node").alias("id"), "fp", "n"), "id").select("key", band.alias("band"), F.struct("id", "fp", "n", F.lit(0).cast("long").alias("g")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            sides = []
            for name in ("x", "y"):
                lists = batch.column(name)
                m = lists.values
                fp = m.field("fp").values.to_numpy().view(np.uint64).reshape(-1, words)
                sides.append((lists.offsets.to_numpy(), m.field("id").to_numpy(), fp, m.field("n").to_numpy(), m.field("g").to_numpy()))
            for k, same in enumerate(batch.column("same").to_pylist()):
                (xi, x, xn, xg), (yi, y, yn, yg) = (tuple(z[o[k] : o[k + 1]] for z in (i, fp, n, g)) for o, i, fp, n, g in sides)
                if same:
                    yi, y, yn, yg = xi, x, xn, xg
                a, b = _tree(x, xn, y, yn, same, radius, share, (xg, yg) if rest else None)
                ids = xi if same else np.concatenate([xi, yi])
                u.append(ids[a])
                v.append(ids[b])
            u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (u, v))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    edges = cut(map_arrow(tile_pairs(members, BLOCK_TILE), partial(run, rest=False), "u long, v long").distinct())
    links = cut(_verified(docs, classes, edges, share, width))
    failed = cut(edges.join(links, ["u", "v"], "left_anti"))
    if failed.isEmpty():
        return marked, classes, links
    # only what a failed link held together can have pairs left that lie apart
    tree = connected_components(edges)
    torn = tree.join(tree.join(failed, tree["node"] == failed["u"]).select("component").distinct(), "component", "left_semi").select("node")
    apart = cut(torn.join(connected_components(links), "node", "left").select(F.col("node").alias("id"), F.coalesce("component", "node").alias("g")))
    again = members.withColumn("id", F.col("m.id")).join(apart, "id").select("key", "band", F.struct("id", "m.fp", "m.n", "g").alias("m"))
    rest = cut(map_arrow(tile_pairs(again, BLOCK_TILE), partial(run, rest=True), "u long, v long").distinct().join(failed, ["u", "v"], "left_anti"))
    return marked, classes, links.union(cut(_verified_in_blocks(docs, classes, rest, cut(tree.join(torn, "node", "left_semi")), share, width)))


def _sets(docs: DataFrame, classes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(node, s): the sets of shingles of the classes at either end of an edge."""
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    of = cut(classes.join(ends, "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.h").alias("of")))  # Spark knows its size
    wanted = docs.join(of, (docs["h"] == of["of"]) & docs["doc_id"].eqNullSafe(of["id"])).select("node", "text").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, width).view(np.int64) for x in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    return cut(map_arrow(wanted, sets, "node long, s array<long>"))


def _verified(docs: DataFrame, classes: DataFrame, edges: DataFrame, share: float, width: int) -> DataFrame:
    """The edges (u, v) between classes whose texts' sets of shingles are similar enough."""
    known = _sets(docs, classes, edges, width)
    a, b = known.select(F.col("node").alias("u"), F.col("s").alias("s")), known.select(F.col("node").alias("v"), F.col("s").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return edges.join(a, "u").join(b, "v").where(both >= share * (F.size("s") + F.size("t") - both) - 1e-9).select("u", "v")


def _verified_in_blocks(docs: DataFrame, classes: DataFrame, edges: DataFrame, tree: DataFrame, share: float, width: int) -> DataFrame:
    """The same for many edges among few texts, both ends of each in one component of ``tree``.

    Nodes of a component are dealt by hash into parts of about SET_TILE, and the
    edges between two parts are looked at together: a set travels once a block
    of up to SET_TILE squared edges, not once an edge.
    """
    at = ["component", "i", "j"]
    parts = tree.groupBy("component").agg(F.ceil(F.count("*") / SET_TILE).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(13)), "parts").cast("int")
    dealt = cut(edges.join(tree.withColumnRenamed("node", "u"), "u").join(parts, "component").select("component", part("u").alias("i"), part("v").alias("j"), "u", "v"))
    needed = dealt.select(*at, F.explode(F.array("u", "v")).alias("node")).distinct().join(_sets(docs, classes, edges, width), "node")
    blocks = dealt.groupBy(at).agg(F.collect_list("u").alias("u"), F.collect_list("v").alias("v")).join(needed.groupBy(at).agg(F.collect_list("node").alias("node"), F.collect_list("s").alias("s")), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                u, v, node, sets = (batch.column(c)[k].values for c in ("u", "v", "node", "s"))
                of = {x: sets[n].values.to_numpy() for n, x in enumerate(node.to_pylist())}
                for x, y in zip(u.to_pylist(), v.to_pylist(), strict=True):
                    both = len(np.intersect1d(of[x], of[y], assume_unique=True))
                    if both >= share * (len(of[x]) + len(of[y]) - both) - 1e-9:
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["u", "v"])

    return map_arrow(blocks.select("u", "v", "node", "s"), run, "u long, v long")


def keep_one(docs: DataFrame, share: float = 0.8, radius: int = 108, width: int = 5, words: int = 8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of similar texts the one with the smallest doc_id.

    Each row is a document of its own.  Rows without doc_id come after those
    with one, and ties go to the smaller hash of the text; of rows that agree in
    doc_id and text, one stays, by hash of the other columns.  Null and empty
    texts, and those without words, are alike.  Columns keep their names,
    whatever they are.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), row.alias("row"))
    marked, classes, links = similar(whole.drop("row"), share, radius, width, words)
    comp = connected_components(links)
    of = classes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "first")
    kept = of.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"))
    counts = cut(marked.groupBy("doc_id", "h").agg(F.count("*").alias("times")))
    is_kept = (counts["h"] == kept["h"]) & counts["doc_id"].eqNullSafe(kept["doc_id"])
    # few documents go, or come twice; lists of those are joined with the rows, so rows seldom move
    named = lambda df: cut(df.select(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h")))
    gone, again = named(counts.join(kept, is_kept, "left_anti")), named(counts.join(kept, is_kept, "left_semi").where("times > 1"))
    listed = (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    found = whole.join(gone, listed, "left_anti")
    if again.isEmpty():
        return found.select("row.*")
    of_row = F.xxhash64(*(F.col(f"row.`{c}`").cast("string") for c in names))
    one = found.join(again, listed, "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", of_row).alias("row"))
    return found.join(again, listed, "left_anti").select("row.*").unionByName(one.select("row.*"))
