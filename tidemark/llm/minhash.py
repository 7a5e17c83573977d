"""MinHash near-dedup by bands of minima under many hash functions.

A text's set is its different 2-word shingles (words between ASCII white space,
A-Z lower-cased; with one word, that word; without words, nothing).  Its sketch
comes from the minima of the set under ``FUNCTIONS`` hash functions.  Four
steps, each of which all but surely leaves out only pairs that can't be similar:

1. Lists.  Two sets of similarity s, of whatever size, have a minimum in common
   with probability s.  Minima are taken in bands (``band_rows`` of them), and
   sets with a band in common meet in its list.  Of pairs at similarity 0.8, 5
   in 10**9 have none of 48 bands of 5 in common; strangers that share 2 % of
   their shingles have one with probability 1.5 in 10**7, so lists grow with the
   near copies, not with what is frequent.
2. Signs.  Members of a list are compared in tiles by one bit of each minimum,
   and a pair of tiles returns a spanning forest: each set in its longest list
   first, then what is not yet connected.
3. Exact similarity, on full sets.  Each set travels once, to its candidate
   component.  There, links are verified node by node until only nodes of one
   verified component are left to look at: any link that is missing would have
   an end outside it, and that end has been looked at.  A component too large
   for one task is dealt into tiles; each meets the first one, and whatever is
   then outside the largest verified component meets every tile.
4. Connected components of the verified links.

Equal sets are one node throughout, so copies cost nothing after step 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.frames import cut, map_arrow, raw_texts, slices
from tidemark.llm.line_dedup import _without_crowds, live
from tidemark.llm.tiles import tile_pairs

#: Hash functions, in two halves of 64 bits each time.
FUNCTIONS = 240
#: Probability, at most, that similar sets have no band in common, and that their signs differ in more places than looked for.
MISS, UNLIKE = 1e-8, 1e-11
#: Bits of the filter of texts that are wanted for verification.
FILTER_BITS = 1 << 27
#: Longs that hold the signs of a sketch, before its bands.
SIGNS = -(-FUNCTIONS // 64)
#: Sketches in a tile of a list.
LIST_TILE = 1024
#: Shingles, and sets, in a tile of a candidate component.
TILE_SHINGLES, TILE_SETS = 500_000, 4096
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, to 63 bits so that order is the same signed and unsigned."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


def shingle_set(text: bytes, width: int = 2) -> np.ndarray:
    """The hashes of a text's different shingles, in order; a shingle's hash is made from its words' XXH64."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out).view(np.int64)


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


_SALTS = _mixed(np.arange(1, FUNCTIONS // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(s: np.ndarray, at_once: int = 256) -> np.ndarray:
    """The least values of a set of hashes under each of the functions."""
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), at_once):
        z = s[k : k + at_once, None].view(np.uint64) ^ _SALTS
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, z.view(np.uint32).min(axis=0), out=out)
    return out


def band_rows(share: float) -> int:
    """The most minima a band may have so that similar sets have a band in common but for MISS."""
    return max((r for r in range(1, 33) if (1 - share**r) ** (FUNCTIONS // r) <= MISS), default=1)


@lru_cache
def _most_signs(share: float) -> int:
    """The most signs in which similar sets differ, but for UNLIKE."""
    p, most, rest = (1 - share) / 2, 0, 1.0
    while (rest := rest - comb(FUNCTIONS, most) * p**most * (1 - p) ** (FUNCTIONS - most)) > UNLIKE:
        most += 1
    return most


def _sketched(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """A row of longs for each set: the signs of its minima, then its bands."""
    m = np.stack([minima(s) for s in sets])
    signs = np.zeros((len(sets), SIGNS * 8), np.uint8)
    packed = np.packbits((m & 1).astype(np.uint8), axis=1)
    signs[:, : packed.shape[1]] = packed
    bands = FUNCTIONS // rows
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
    for k in range(rows):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[:, k : bands * rows : rows].astype(np.uint64))
    return np.concatenate([signs.view(np.int64), h.view(np.int64)], axis=1)


def sketches(docs: DataFrame, width: int = 2, share: float = 0.8) -> DataFrame:
    """(doc_id, h, key, n, sketch): hash of each whole text; digest, size and sketch of its set (none of an empty one)."""
    rows = band_rows(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, width) for x in raw_texts(batch)]
            full = [s for s in sets if len(s)]
            longs = _sketched(full, rows) if full else np.zeros((0, 1), np.int64)
            offsets = np.cumsum([0] + [longs.shape[1] * (len(s) > 0) for s in sets]).astype(np.int32)
            arrays = [
                batch.column("doc_id"),
                batch.column("h"),
                pa.array([_key(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(longs.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "key", "n", "sketch"])

    return map_arrow(_rows(docs), run, "doc_id long, h long, key binary, n long, sketch array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def spanning(sets: list[np.ndarray], passes: Callable[[int, np.ndarray, np.ndarray], np.ndarray], look_at: int = 0, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links that span all components of the links among some sorted sets; sets of the same ``label`` count as connected.

    ``passes(i, js, shared)`` tells which of the sets ``js``, that share
    ``shared`` members with set ``i``, it links to.  With ``look_at``, only
    links with an end among the first so many sets are wanted.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    # inverted lists of the members that two sets or more have
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True) if n else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(n), sizes)
    more = often[at] > 1
    at, owner = at[more], owner[more]
    order = np.argsort(at, kind="stable")
    holders, firsts = owner[order], np.searchsorted(at[order], np.arange(len(often) + 1))
    mine = np.searchsorted(owner, np.arange(n + 1))
    label, done, u, v = np.arange(n) if label is None else label.copy(), np.zeros(n, bool), [], []
    if look_at:
        done[look_at:] = True
    while True:
        left = np.flatnonzero(~done)
        if not len(left):
            break
        names, counts = np.unique(label[left], return_counts=True)
        if not look_at:
            if len(names) == 1:  # a missing link would have an end outside, and that was looked at
                break
            most = names[counts.argmax()]
            outside = left[label[left] != most]
            i = int(outside[0] if len(outside) else left[0])
        else:
            if (label == label[0]).all():
                break
            i = int(left[0])
        done[i] = True
        # members of i that others have too, and who has them
        lists = at[mine[i] : mine[i + 1]]
        if not len(lists):
            continue
        shared = np.zeros(n, np.int64)
        for k in range(0, len(lists), 4096):
            part = lists[k : k + 4096]
            shared += np.bincount(np.concatenate([holders[firsts[x] : firsts[x + 1]] for x in part]), minlength=n)
        js = np.flatnonzero((shared > 0) & (label != label[i]))
        for j in js[passes(i, js, shared[js])] if len(js) else ():
            if label[j] != label[i]:
                u.append(i)
                v.append(int(j))
                label[label == label[j]] = label[i]
    return u, v


def _candidates(signs: np.ndarray, n: np.ndarray, label: np.ndarray, share: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs whose sizes and signs say that they may be similar; sets of one label count as connected."""
    most, label, done, u, v = _most_signs(share), label.copy(), np.zeros(len(n), bool), [], []
    while True:
        names, counts = np.unique(label[~done], return_counts=True)
        if len(names) < 2:  # a missing link would have an end outside, and that was looked at
            return u, v
        i = int(np.flatnonzero(~done & (label != names[counts.argmax()]))[0])
        done[i] = True
        js = np.flatnonzero((label != label[i]) & (np.minimum(n[i], n) >= share * np.maximum(n[i], n) - 1e-9))
        for j in js[np.bitwise_count(signs[i] ^ signs[js]).sum(axis=1) <= most]:
            if label[j] != label[i]:
                u.append(i)
                v.append(int(j))
                label[label == label[j]] = label[i]


def _lists(batch: pa.RecordBatch, name: str, *fields: str) -> Iterator[tuple]:
    """The rows of a column of lists of structs, as tuples of numpy arrays (a list of arrays for a field of lists)."""
    lists = batch.column(name)
    m, offsets = lists.values, lists.offsets.to_numpy()
    got = []
    for f in fields:
        x = m.field(f)
        if pa.types.is_list(x.type):
            flat, o = x.values.to_numpy(), x.offsets.to_numpy()
            got.append([flat[o[k] : o[k + 1]] for k in range(len(x))])
        else:
            got.append(x.to_numpy())
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield tuple(x[a:b] for x in got)


def _edges(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["u", "v"])


def _postings(classes: DataFrame) -> DataFrame:
    """(key, tag) of the bands: a tag is a node, with three bits for what ``live`` is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = batch.column("sketch").flatten().to_numpy().reshape(batch.num_rows, -1)[:, SIGNS:]
                tags = np.repeat(batch.column("node").to_numpy() << 3, bands.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _without_crowds(bands.ravel(), tags)], ["key", "tag"])

    return map_arrow(classes.where("n > 0").select("node", "sketch"), run, "key long, tag long")


def candidates(classes: DataFrame, share: float = 0.8, tile: int = LIST_TILE) -> DataFrame:
    """(u, v): a graph of ``classes`` (node, n, sketch) in which similar sets are connected, and few others."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / share + 1e-9))).cast("int")
    lists = cut(live(_postings(classes)).select("key", F.shiftright("id", 3).alias("node")).distinct())
    listed = lists.join(classes.select("node", "n"), "node")
    # members whose size has no like in the list can go
    more = listed.select("key", "node", "n", band.alias("band"))
    beside = more.groupBy("key", "band").agg(F.count("*").alias("c")).select("key", "c", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    more = more.join(beside.groupBy("key", "band").agg(F.sum("c").alias("c")).where("c > 1"), ["key", "band"], "left_semi")
    members = cut(more.select("key", "band", "node", "n"))
    named = classes.select(F.col("node").alias("of"), F.slice("sketch", 1, SIGNS).alias("signs"))

    def compared(members: DataFrame) -> DataFrame:
        def attach(dealt: DataFrame) -> DataFrame:
            return dealt.join(named, F.col("m.id") == F.col("of")).withColumn("m", F.struct("m.id", "m.n", "m.label", "signs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for big in batches for b in slices(iter([big]), 64)):
                u, v = [], []
                for (xi, xn, xl, xs), (yi, yn, yl, ys) in zip(*(_lists(batch, c, "id", "n", "label", "signs") for c in ("x", "y")), strict=True):
                    ids = np.concatenate([xi, yi])
                    a, b = _candidates(np.stack(xs + ys).view(np.uint64), np.concatenate([xn, yn]), np.concatenate([xl, yl]), share)
                    u.append(ids[a])
                    v.append(ids[b])
                yield _edges(u, v)

        m = F.struct(F.col("node").alias("id"), "n", "label").alias("m")
        return map_arrow(tile_pairs(members.select("key", "band", m), tile, attach), run, "u long, v long").distinct()

    longest = members.groupBy("key").agg(F.count("*").alias("c"))
    main = members.join(longest, "key").groupBy("node", "n", "band").agg(F.max_by("key", F.struct("c", "key")).alias("key"))
    early = cut(compared(main.withColumn("label", F.col("node"))))
    found = connected_components(early).select(F.col("node").alias("of"), "component")
    labelled = cut(members.join(found, F.col("node") == F.col("of"), "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("label")))
    unlike = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return early.union(compared(labelled.join(unlike, "key", "left_semi")))


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that may be among the wanted ones, by (doc_id, h): texts of others needn't travel.

    The filter has FILTER_BITS bits, however many are wanted; when most are set, it lets most rows pass.
    """
    slot = F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bitmap_bit_position(slot) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("slot", slot).join(F.broadcast(bits), F.bitmap_bucket_number("slot") == F.col("bucket"))  # FILTER_BITS / 8 bytes at most
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(slot) % 8 AS INT))")) != 0).drop("slot", "bucket", "bits")


def verified(docs: DataFrame, classes: DataFrame, coarse: DataFrame, share: float = 0.8, width: int = 2, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """(u, v): links of similarity ``share`` or more that span every component of such links.

    ``coarse`` has (node, component) of the candidate graph.  Full sets are made
    again from the texts of the classes in it.
    """
    of = cut(classes.join(coarse, "node").select("node", "component", "n", "first.doc_id", "first.h"))
    total = of.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / tile_shingles), F.ceil(F.count("*") / tile_sets)).cast("int").alias("tiles"))
    wanted = cut(of.join(total, "component").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), "tiles").cast("int")).drop("n"))  # Spark knows its size
    rows = _among(_rows(docs), wanted).join(wanted, ["doc_id", "h"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(x, width) for x in raw_texts(batch)], pa.list_(pa.int64()))
            names = ["component", "tiles", "tile", "node"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], [*names, "s"])

    full = map_arrow(rows.select("component", "tiles", "tile", "node", "text"), sets, "component long, tiles int, tile int, node long, s array<long>")
    laid = cut(full.groupBy("component", "tiles", "tile").agg(F.collect_list(F.struct("node", "s")).alias("x")))
    none = F.array().cast(laid.schema["x"].dataType)
    several = laid.where("tiles > 1")
    first = several.where("tile = 0").select("component", F.col("x").alias("y"))
    alone = laid.where("tiles = 1 OR tile = 0").select("x", none.alias("y"))
    meet_first = several.where("tile > 0").join(first, "component").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch], outside: bool) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in slices(iter([big]), 8)):
            u, v = [], []
            for (xi, xs), (yi, ys) in zip(_lists(batch, "x", "node", "s"), _lists(batch, "y", "node", "s"), strict=True):
                ids, s = np.concatenate([xi, yi]), xs + ys
                ids, one = np.unique(ids, return_index=True) if not outside else (ids, np.arange(len(ids)))  # a repeated row comes twice
                s = [s[k] for k in one]
                n = np.array([len(z) for z in s], np.int64)

                def passes(i: int, js: np.ndarray, shared: np.ndarray, n: np.ndarray = n) -> np.ndarray:
                    return shared >= share * (n[i] + n[js] - shared) - 1e-9

                a, b = spanning(s, passes, len(xi) if outside else 0)
                u.append(ids[a])
                v.append(ids[b])
            yield _edges(u, v)

    links = cut(map_arrow(alone.union(meet_first), partial(run, outside=False), "u long, v long"))
    if several.isEmpty():
        return links
    # what lies outside the largest verified component of a component in several tiles meets all of its tiles
    found = connected_components(links)
    big = of.join(total.where("tiles > 1"), "component").join(found.withColumnRenamed("component", "part"), "node", "left").select("component", "node", F.coalesce("part", "node").alias("part"))
    big = cut(big)
    counts = big.groupBy("component", "part").agg(F.count("*").alias("c"))
    largest = counts.groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("part"))
    out = cut(big.join(largest, ["component", "part"], "left_anti").select("component", "node"))
    if out.isEmpty():
        return links
    outer = several.join(out.select("component").distinct(), "component", "left_semi")
    members = outer.select("component", F.explode("x").alias("m")).select("component", "m.node", "m").join(out, ["component", "node"]).dropDuplicates(["component", "node"])
    dealt = out.groupBy("component").agg(F.count("*").alias("c")).join(total, "component").select("component", F.least("tiles", F.col("c").cast("int")).alias("parts"))
    outsiders = cut(members.join(dealt, "component").groupBy("component", F.pmod(F.xxhash64("node", F.lit(7)), "parts").alias("part")).agg(F.collect_list("m").alias("x")))
    late = outsiders.join(outer.select("component", F.col("x").alias("y")), "component").select("x", "y")
    return links.union(cut(map_arrow(late, partial(run, outside=True), "u long, v long")))


def near_duplicates(docs: DataFrame, share: float = 0.8, width: int = 2, **sizes: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the document's own
    included; ``kept`` tells whether it is the document's own.  Null and empty
    texts, and those without words, have no shingles and link with nothing.
    Rows with the same doc_id are one document with several texts.  A row
    without doc_id links nothing; it gets the component of the documents with
    its very set, else null, and isn't kept.  Other columns of ``docs`` play no
    part, whatever their names.
    """
    marked = cut(sketches(docs, width, share))
    known = marked.where("doc_id IS NOT NULL AND n > 0")
    grouped = known.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    coarse = cut(connected_components(candidates(classes.select("node", "n", "sketch"), share)))
    links = verified(docs, classes, coarse, share, width, **sizes)
    # rows of one doc_id with several texts tie their sets together
    several = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    held = known.join(several, "doc_id").join(classes.select("key", "node"), "key").select("doc_id", "node")
    tied = held.join(held.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v")
    comp = connected_components(links.union(tied))
    of = classes.select("key", "node", F.col("first.doc_id").alias("first")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of_key = cut(of.join(ids, "component").select("key", "component_id"))
    # an id with an empty text beside others belongs to their component
    of_id = held.join(classes.select("node", "key"), "node").join(of_key, "key").groupBy("doc_id").agg(F.min("component_id").alias("own"))
    component = F.coalesce("component_id", "own", "doc_id")
    # texts without words, however many, have no part in the join
    found = marked.where("n > 0").join(of_key, "key", "left").select("doc_id", "n", "component_id").union(marked.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    found = found.join(of_id, "doc_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
