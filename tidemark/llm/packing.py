"""Best-fit packing of tokenised documents into sequences, by merging up a tree.

Documents become pieces of at most ``limit`` tokens.  Each partition packs its
pieces best-fit (largest first, into the fullest sequence that still has room)
and emits the sequences that are nearly full.  The underfull ones go on as
items themselves: a few partitions' remainders meet in one and are packed
again, round after round, until one partition has seen all remainders or a
round no longer saves any.  An item carries its pieces' numbers, at most
``limit`` of them, never token ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, map_arrow, texts

#: Words remembered within a task; when so many are, those not seen since the last time are forgotten.
REMEMBERED = 500_000
#: Items that one task packs at a time.
ITEMS = 200_000
#: A sequence filled to this share counts as nearly full.
NEARLY = 0.995
#: Partitions whose remainders meet in one.
FAN_IN = 8
#: A word with ASCII punctuation behind it: two words of the split. Marks may combine with a letter, so they don't count.
_PUNCTUATED = re.compile(r"([^\W_]+)([!-/:-@\[-`{-~]+)")
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBERS = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
BIN = "fill int, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>, offset array<int>, done boolean"


class WordEncoder:
    """Token ids, as little-endian 32-bit bytes, by a vocabulary whose split drops white space.

    No token of such a vocabulary crosses white space, so words are encoded
    once each and remembered.  Texts that may hold a special token's string, or
    control characters on which Python and the library disagree about white
    space, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_padding()
        self._lib.no_truncation()
        self._whole = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self._lib.get_added_tokens_decoder().values())]
        probe = ["Of a,", "of", "a", ","]
        whole, *parts = (self._lib.encode(x, add_special_tokens=False).ids for x in probe)
        self._by_word = whole == sum(parts, [])
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        vocab = self._lib.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._lib.encode_batch_fast(items, add_special_tokens=False)]

    def _encode_letters(self, items: list[str]) -> list[bytes]:
        """Ids of words that are one word of the split each: encoded in one text and cut where a word's end token stands."""
        if not items:
            return []
        ids = np.array(self._lib.encode_batch_fast([" ".join(items)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(items):  # some word became several after all
            return self._encode(items)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        """Remember new words; those that differ by ASCII capitals or punctuation share the library's answer."""
        known, before = self._known, self._before
        old = words.intersection(before) if before else set()
        known.update((w, before[w]) for w in old)
        single: dict[str, str] = {}
        double: dict[str, tuple[str, str]] = {}
        for w in words - old:
            if w.isalnum():
                single[w] = w.lower() if w.isascii() else w
                continue
            m = _PUNCTUATED.fullmatch(w)
            if m and m[1].lower()[-1].isalnum():
                double[w] = m[1].lower() if m[1].isascii() else m[1], m[2]
            else:
                single[w] = w
        new = {*single.values(), *(x for p in double.values() for x in p)}.difference(known)
        letters = [x for x in new if x.isalpha()]
        other = [x for x in new if not x.isalpha()]
        known.update(zip(letters, self._encode_letters(letters), strict=True))
        known.update(zip(other, self._encode(other), strict=True))
        known.update((w, known[x]) for w, x in single.items())
        known.update((w, known[x] + known[y]) for w, (x, y) in double.items())

    def forget(self) -> None:
        self._known, self._before = {}, {}

    def encode(self, items: list[str], at_once: int = 64) -> Iterator[bytes]:
        for k in range(0, len(items), at_once):
            part = items[k : k + at_once]
            whole = [not self._by_word or any(x in text for x in self._whole) for text in part]
            split = [[] if w else text.split() for text, w in zip(part, whole, strict=True)]
            if len(self._known) > REMEMBERED:
                self._known, self._before = {}, self._known
            words = list(chain.from_iterable(split))
            ids = list(map(self._known.get, words))
            if missing := [k for k, x in enumerate(ids) if x is None]:
                self._learn({words[k] for k in missing})
                for k in missing:
                    ids[k] = self._known[words[k]]
            at = 0
            for text, own, w in zip(part, split, whole, strict=True):
                yield self._encode([text])[0] if w else b"".join(ids[at : at + len(own)])
                at += len(own)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder for a vocabulary file, one for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every row's ids and an end id, cut only where longer than ``limit``.

    Null and empty texts have the end id alone; repeated rows, and rows without
    doc_id, are pieces like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts(batch)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], MEMBERS[:5])
        enc.forget()  # a worker outlives its tasks

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECE)


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins as lists of item indexes: largest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by room
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
            bins[k].append(item)
        else:
            room, k = limit, len(bins)
            bins.append([item])
        room -= size
        if room:
            free[room].append(k)
            rooms |= 1 << room
    return bins


def _packed(items: pa.Table, limit: int, nearly: int) -> pa.RecordBatch:
    """One bin a row from one item a row."""
    items = items.combine_chunks()
    fill = items.column("fill").to_numpy()
    lists = {m: items.column(m).chunk(0) for m in MEMBERS}
    at = lists["doc_id"].offsets.to_numpy()
    bins = best_fit(fill, limit)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(fill))
    per_bin = np.array([len(b) for b in bins])
    first = np.concatenate([[0], np.cumsum(per_bin)])[:-1]
    sizes = fill[order].astype(np.int64)
    before = np.cumsum(sizes) - sizes
    base = before - np.repeat(before[first], per_bin)  # place of each item in its bin
    n = (at[1:] - at[:-1])[order]
    ends = np.cumsum(n)
    index = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(at[:-1][order], n)
    members = {m: x.values.take(pa.array(index)) for m, x in lists.items()}
    members["offset"] = pa.array(members["offset"].to_numpy() + np.repeat(base, n), pa.int32())
    offsets = pa.array(np.concatenate([[0], np.add.reduceat(n, first).cumsum()]), pa.int32())
    total = np.add.reduceat(sizes, first)
    return pa.RecordBatch.from_arrays(
        [pa.array(total, pa.int32()), *(pa.ListArray.from_arrays(offsets, members[m]) for m in MEMBERS), pa.array(total >= nearly)],
        ["fill", *MEMBERS, "done"],
    )


def _round(items: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ITEMS:
                yield _packed(pa.Table.from_batches(held), limit, nearly)
                held, rows = [], 0
        if held:
            yield _packed(pa.Table.from_batches(held), limit, nearly)

    nearly = int(NEARLY * limit)
    return items.mapInArrow(run, BIN)


def pack(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated rows as often as they come; null
    and empty texts are one piece of the end id alone.  A sequence holds at most
    ``limit`` tokens and has no gaps; an empty table gives no rows.
    """
    single = pieces(docs, path, limit, end_id)
    items = single.select(F.col("length").alias("fill"), *(F.array(c).alias(c) for c in MEMBERS[:5]), F.array(F.lit(0)).alias("offset"))
    bins = cut(_round(items, limit))
    done = bins.where("done")
    left = bins.where("NOT done")
    n = left.count()
    width = max(1, -(-bins.rdd.getNumPartitions() // FAN_IN))
    while n:
        width = max(width, -(-n // ITEMS))
        bins = cut(_round(left.drop("done").repartition(width), limit))
        done, left = done.union(bins.where("done")), bins.where("NOT done")
        before, n = n, left.count()
        if width == 1 or n > 0.98 * before and width == -(-n // ITEMS):
            break
        width = max(1, -(-width // FAN_IN))
    numbered = done.union(left).withColumn("sequence_id", F.monotonically_increasing_id())
    sequences = numbered.select("sequence_id", F.explode(F.arrays_zip(*MEMBERS)).alias("m"))
    return sequences.select(*(F.col(f"m.{c}").alias(c) for c in MEMBERS[:3]), F.col("m.length").cast("long").alias("length"), F.col("m.ids_crc32").alias("ids_crc32"), "sequence_id", F.col("m.offset").cast("long").alias("offset"))
