"""Document fingerprints as homomorphic multiset hashes of paragraphs.

A paragraph (line) is hashed to a wide vector: WIDE uniform 64-bit lanes of its
whole text, and LANES signs (+1 or -1) summed over its pieces.  A document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2**64
and 2**16.  So the order of paragraphs doesn't matter, equal multisets of
paragraphs have equal fingerprints, and inserting or deleting a paragraph adds
or subtracts its vector, whatever else the document holds.

The uniform lanes decide equality.  The sign lanes measure likeness: the inner
product of two documents' lanes estimates how many pieces they share.  Pieces
are runs of words that end where a word's checksum says so (after PIECE words
at the latest), so an edit moves only the piece it touches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_arrow, texts

WIDE, LANES, PIECE = 4, 128, 32


class Fingerprint:
    """A multiset hash; ``+`` and ``-`` insert and delete paragraphs."""

    __slots__ = ("lanes", "wide")

    def __init__(self, wide: np.ndarray, lanes: np.ndarray):
        self.wide, self.lanes = wide, lanes

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.lanes - other.lanes)

    def __str__(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.lanes.astype("<i2").tobytes().hex()

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        raw = bytes.fromhex(s)
        return cls(np.frombuffer(raw[: 8 * WIDE], "<u8").copy(), np.frombuffer(raw[8 * WIDE :], "<i2").copy())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, about the shared part of all pieces (Tanimoto) otherwise."""
        if (self.wide == other.wide).all():
            return 1.0
        a, b = self.lanes.astype(float), other.lanes.astype(float)
        dot = float(a @ b)
        below = float(a @ a + b @ b) - dot
        return min(1.0, max(0.0, dot / below)) if below > 0 else 0.0


def _pieces(paragraph: bytes) -> Iterator[bytes]:
    words, at = paragraph.split(), 0
    for k, word in enumerate(words, 1):
        if not zlib.crc32(word) & 7 or k - at == PIECE:
            yield b" ".join(words[at:k])
            at = k
    if at < len(words):
        yield b" ".join(words[at:])


def fingerprint(text: str) -> Fingerprint:
    """The sum over the text's paragraphs; paragraphs of white space alone count for equality only."""
    paragraphs = text.encode().split(b"\n") if text else []
    if not paragraphs:
        return Fingerprint(np.zeros(WIDE, np.uint64), np.zeros(LANES, np.int16))
    wide = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8 * WIDE).digest() for p in paragraphs), "<u8")
    lanes = np.zeros(LANES, np.int64)
    signs = [hashlib.blake2b(x, digest_size=LANES // 8).digest() for p in paragraphs for x in _pieces(p)]
    for k in range(0, len(signs), 16384):
        part = signs[k : k + 16384]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8)).reshape(-1, LANES)
        lanes += 2 * bits.sum(axis=0, dtype=np.int64) - len(part)
    return Fingerprint(wide.reshape(-1, WIDE).sum(axis=0, dtype=np.uint64), lanes.astype(np.int16))


def replaced(text: str, whole: Fingerprint, at: int, tail: str) -> tuple[str, Fingerprint]:
    """The text whose part from code point ``at`` on is ``tail`` instead, and its fingerprint, by deletion and insertion."""
    start = text.rfind("\n", 0, at) + 1
    new = text[start:at] + tail
    old = fingerprint(text[start:])
    if start == 0:
        return new, whole - old + fingerprint(new)
    if not text[start:]:  # an empty last paragraph is one too
        old = _empty_paragraph()
    return text[:at] + tail, whole - old + (fingerprint(new) if new else _empty_paragraph())


def _empty_paragraph() -> Fingerprint:
    return Fingerprint(np.frombuffer(hashlib.blake2b(b"", digest_size=8 * WIDE).digest(), "<u8"), np.zeros(LANES, np.int16))


def _step(key: Column, bounds: list[int], low: int = 0) -> Column:
    """How many bounds are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(low)
    k = len(bounds) // 2
    return F.when(key < bounds[k], _step(key, bounds[:k], low)).otherwise(_step(key, bounds[k + 1 :], low + k + 1))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, ghost, doc_id, text), so laid out that each row's successor by descending doc_id follows it.

    Ids are cut into ranges, one a partition, each sorted by descending id
    (equal ids by text, rows without id last).  A range's last document needs
    the next range's first one: those rows, one or a few a range, are also sent
    as ghosts to the end of the range before; the first range's to the last.
    The text moves in one shuffle.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", key)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(parts, 2000)
    found = docs.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    part = _step(F.col("key"), sorted({int(b) for b in found}))
    heads = docs.groupBy(part.alias("part")).agg(F.max("key").alias("head")).orderBy("part").collect()  # a row a part
    if not heads:
        return docs.select(F.lit(0).alias("part"), F.lit(0).alias("ghost"), "doc_id", "text").limit(0)
    above = [r["part"] for r in heads[1:]] + [heads[0]["part"]]  # the range that ends before this one begins
    goes = F.create_map(*(F.lit(x) for r, to in zip(heads, above, strict=True) for x in (r["head"], to)))
    own = F.struct(part.cast("int").alias("part"), F.lit(0).alias("ghost"))
    also = F.struct(goes[F.col("key")].cast("int").alias("part"), F.lit(1).alias("ghost"))
    is_head = F.col("key").isin([r["head"] for r in heads])
    sent = docs.withColumn("to", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))))
    return (
        sent.select("to.part", "to.ghost", "doc_id", "key", "text")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "ghost", F.desc("key"), "text")
        .select("part", "ghost", "doc_id", "text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text's last third (floor of n_chars / 3 code points) is the
    beginning of the next document instead, by descending doc_id; the last
    one's next is the first.  Null texts count as empty; a table of one row is
    its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out: list[tuple] = []
            for ghost, doc, text in zip(batch.column("ghost").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if ghost and last is None:
                    continue
                fp = fingerprint(text)
                if last is not None:
                    doc_, text_, fp_ = last
                    third = len(text_) // 3
                    edited, edited_fp = replaced(text_, fp_, len(text_) - third, text[:third])
                    out.append((doc_, len(text_), hashlib.sha256(edited.encode()).hexdigest(), str(fp_), str(edited_fp), fp_.likeness(edited_fp), fp_.likeness(fp)))
                last = None if ghost else (doc, text, fp)
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_arrow(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
