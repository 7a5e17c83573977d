"""Line deduplication by a segment-partition edit join.

Near-equal lines, and whatever such links connect, are one class; a corpus
keeps a class's first line and drops the others.  Near-equal are lines that
differ in a tenth of their characters at most, and in a number of words that
grows with the line (``WORD_CLASSES``; of characters, ``CHAR_CLASSES``, where
there are few words).  With ``errors``, they are lines within that many edits.

A class of lengths has one threshold t, and t + 1 segments of q units: the first
half of them at fixed places from the line's begin, the others from its end.
Of two lines within t edits, let k be the first segment up to whose end no more
than k edits fall: then none falls in it, k before it and t - k at most behind
it, so the other line holds it at most k places away, counted from the begin, or
t - k, counted from the end.  A line is indexed by its segments and probes so
many places to both sides: about (t + 1)**2 / 2 keys.

For a fixed ``errors`` the segments depend on the line's own length.  If a line is cut into errors + 1 segments, a line within that many edits holds
at least one of them unchanged, at nearly the same place.  So every distinct
line is indexed by (length, segment number, segment), and probes, for each
length it could match, the few substrings that can be that segment (the
multi-match-aware selection of Li et al., "Pass-Join", VLDB 2011).  Lines that
meet under a key are verified by banded bit-parallel edit distance (Hyyro 2003).

Texts don't travel: lines are known by hash until some key has brought two
together.  The lines under one key are laid out in tiles by length; tiles whose
lengths are too far apart don't meet, and a pair of tiles returns a spanning
forest of its links, so a much shared segment costs no list of all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.frames import cut, give_back, map_arrow, texts
from tidemark.llm.tiles import tile_pairs

#: Shorter lines (code points) are never compared with different ones: they are alike by chance.
MIN_CHARS = 32
ERRORS = 1
#: Near-equal lines differ in a SHARE-th of the longer one's characters at most (and one edit always links),
SHARE = 10
#: and in so many words: (least number of words of the longer line, words).
WORD_CLASSES = ((8, 1), (12, 2), (20, 3), (32, 4), (48, 4), (64, 4), (128, 6), (256, 8), (512, 12), (2048, 24))
#: Lines of fewer than FEW_WORDS words also link by characters: (least length of the longer line, edits).
CHAR_CLASSES = ((32, 2), (48, 3), (64, 4), (96, 6), (128, 8), (256, 12))
FEW_WORDS = 12
TILE = 256
#: Bits of the filter that tells which lines' texts are wanted; its size is fixed, more lines only make it pass more.
FILTER_BITS = 1 << 26


def segments(length: int, errors: int) -> list[tuple[int, int]]:
    """(start, length) of errors + 1 segments of a line; the last ones take what doesn't divide."""
    n, rest = divmod(length, errors + 1)
    out, at = [], 0
    for k in range(errors + 1):
        size = n + (k > errors - rest)
        out.append((at, size))
        at += size
    return out


def _key(part: str, length: int, k: int) -> int:
    return xxhash.xxh3_64_intdigest(part.encode(), seed=length * 64 + k)


def index_keys(line: str, errors: int) -> list[int]:
    return [_key(line[at : at + size], len(line), k) for k, (at, size) in enumerate(segments(len(line), errors))]


def probe_keys(line: str, errors: int) -> list[int]:
    """Keys of the substrings that can be a segment of a line no longer than this one."""
    out, n = [], len(line)
    for shorter in range(errors + 1):
        for k, (at, size) in enumerate(segments(n - shorter, errors)):
            low = max(at - k, at + shorter - (errors - k), 0)
            high = min(at + k, at + shorter + (errors - k), n - size)
            out += [_key(line[p : p + size], n - shorter, k) for p in range(low, high + 1)]
    return out


def _threshold(classes: tuple[tuple[int, int], ...], n: int) -> int:
    """The edits allowed where the longer line has n units; negative below the classes."""
    return next((most for least, most in reversed(classes) if n >= least), -1)


def _places(classes: tuple[tuple[int, int], ...], c: int) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """The units of a segment of class c, and its keys' (segment, place, 1 if counted from the end, probe)."""
    least, most = classes[c]
    q, out = (least - most) // (most + 1), []
    for k in range(most + 1):
        from_end = int(2 * k > most)
        reach, at = (most - k, -(most + 1 - k) * q) if from_end else (k, k * q)
        out += [(k, at + shift, from_end, shift != 0) for shift in range(-reach, reach + 1)]
    return q, out


_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _class_keys(classes: tuple[tuple[int, int], ...], units: np.ndarray, count: np.ndarray, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line numbers, keys, probe) of lines that lie end to end in ``units`` (hashes), ``count`` of them each.

    A segment's key comes from sums of units times powers of an odd number:
    what stands between two places is a difference of sums, wherever it stands.
    """
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * _powers(_B, len(units))[: len(units)])])
    undo, start = _powers(_B_INVERSE, len(units)), np.cumsum(count) - count
    for c, (least, most) in enumerate(classes):
        # a line of the class is the longer of a pair, or the shorter of one whose longer is in it
        lines = np.flatnonzero((count >= least - most) & (count < (classes[c + 1][0] if c + 1 < len(classes) else np.inf)))
        if not len(lines):
            continue
        q, places = _places(classes, c)
        for k, at, from_end, probe in places:
            place = at + (count[lines] if from_end else 0)
            inside = (place >= 0) & (place + q <= count[lines])
            of, first = lines[inside], (start[lines] + place)[inside]
            yield of, _mixed((total[first + q] - total[first]) * undo[first] + np.uint64((salt + c * 64 + k) * 0xD1342543DE82EF95 & (1 << 64) - 1)), probe


def near_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, keys, probe) by which near-equal ones of many lines meet."""
    words = [line.encode().split(b" ") for line in lines]
    count = np.array([len(w) for w in words], np.int64)
    found = list(_class_keys(WORD_CLASSES, np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum())), count, 0))
    few = np.flatnonzero(count < FEW_WORDS)
    chars = [lines[k].encode("utf-32-le", "surrogatepass") for k in few]
    units = _mixed(np.frombuffer(b"".join(chars), "<u4").astype(np.uint64) + np.uint64(1 << 40))
    found += [(few[of], keys, probe) for of, keys, probe in _class_keys(CHAR_CLASSES, units, np.array([len(x) // 4 for x in chars], np.int64), 4096)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    of, keys, probes = ([x[k] for x in found] for k in range(3))
    return np.concatenate(of), np.concatenate(keys), np.repeat(probes, [len(x) for x in of])


def near_equal(a: str, b: str) -> bool:
    """Whether two lines differ in few words or characters for their length."""
    length = max(len(a), len(b))
    most = max(1, length // SHARE)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    words = max(len(x), len(y))
    if words < FEW_WORDS and within(a, b, min(most, _threshold(CHAR_CLASSES, length))):
        return True
    t = _threshold(WORD_CLASSES, words)
    if t < 0 or abs(len(x) - len(y)) > t:
        return False
    n, k = min(len(x), len(y)), 0
    if len(x) == len(y):
        other = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
        if len(other) <= t and sum(max(len(p), len(q)) for p, q in other) <= most:
            return True  # words replaced one by one are few enough edits
    while k < n and x[k] == y[k]:
        k += 1
    if len(x) != len(y) and x[len(x) - n + k :] == y[len(y) - n + k :] and length - min(len(a), len(b)) <= most:
        return True  # words left out in one place
    end = 0
    while end < n - k and x[-1 - end] == y[-1 - end]:
        end += 1
    ids: dict[str, int] = {}  # of what common words at both ends leave
    x, y = ("".join(chr(ids.setdefault(w, len(ids))) for w in z[k : len(z) - end]) for z in (x, y))
    return within(x, y, t) and within(a, b, most)


def within(a: str, b: str, errors: int) -> bool:
    """Whether the edit distance (insert, delete, replace a code point) is at most ``errors``."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > errors:
        return False
    low, high = 0, len(b)
    while low < high:  # longest common prefix by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) <= errors:
        return True  # at most as many replacements and deletions
    if not b:
        return False
    # a band of the matrix around its diagonal, one word a column of b
    wide = max(64, 2 * errors + 2)
    word = (1 << wide) - 1
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    vp, vn = word << (wide - 1 - errors) & word, 0
    distance, most = errors, 2 * errors + len(b) - len(a)
    start, side = errors - wide + 1, 1 << (wide - 2)
    for k, c in enumerate(b):
        hits = at.get(c, 0)
        x = (hits >> start if start >= 0 else hits << -start) & word
        d0 = ((((x & vp) + vp) & word) ^ vp) | x | vn
        hp = vn | ~(d0 | vp) & word
        hn = d0 & vp
        if k < len(a) - errors:  # the band moves down its diagonal
            distance += not d0 >> (wide - 1)
        else:  # and along the last row
            distance += bool(hp & side) - bool(hn & side)
            side >>= 1
        if distance > most:
            return False
        vp = hn | ~((d0 >> 1) | hp) & word
        vn = (d0 >> 1) & hp
        start += 1
    return distance <= errors


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _line_id(line: str) -> int:
    """61 bits; the three lowest are zero."""
    return xxhash.xxh3_64_intdigest(line.encode()) & ~7


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def occurrences(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """(line, doc_id, line_no): every line that isn't blank, or every one of ``min_chars`` or more, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs_, numbers = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                for k, line in enumerate(_lines(text)):
                    if len(line) >= min_chars if min_chars is not None else line.strip():
                        ids.append(_line_id(line))
                        docs_.append(doc)
                        numbers.append(k)
            yield pa.RecordBatch.from_arrays([_signed(ids), pa.array(docs_, pa.int64()), pa.array(numbers, pa.int32())], ["line", "doc_id", "line_no"])

    return map_arrow(docs, run, "line long, doc_id long, line_no int")


def _distinct_lines(batch: pa.RecordBatch, seen: set[int], min_chars: int) -> Iterator[tuple[int, str]]:
    for text in texts(batch):
        for line in _lines(text):
            if len(line) >= min_chars and (h := _line_id(line)) not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(h)
                yield h, line


_PROBE, _SURE, _STANDS_IN = 1, 2, 4
#: A key of so many lines within a batch is live for sure, and its lines need not meet to find that out.
COMMON = 8


def _without_crowds(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings where those of a batch's common keys are marked as sure, with one or two unmarked ones left to stand for them."""
    order = np.lexsort((tags & 1, keys))
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    size = np.diff(np.append(first, len(order)))
    more_k, more_t = [], []
    for at, n in zip(first[size >= COMMON].tolist(), size[size >= COMMON].tolist(), strict=True):
        rows = order[at : at + n]
        other = rows[tags[rows] >> 3 != tags[rows[0]] >> 3]
        if len(other) and not tags[rows[0]] & _PROBE:
            for row in (rows[0], other[0]):
                more_k.append(keys[row])
                more_t.append(tags[row] | _STANDS_IN)
            tags[rows] |= _SURE
    return np.append(keys, np.array(more_k, np.int64)), np.append(tags, np.array(more_t, np.int64))


def _portions(found: Iterator[tuple[int, str]], chars: int = 1_500_000) -> Iterator[tuple[list[int], list[str]]]:
    """Lines with their ids, some ``chars`` code points at a time."""
    ids, lines, n = [], [], 0
    for h, line in found:
        ids.append(h)
        lines.append(line)
        n += len(line)
        if n >= chars:
            yield ids, lines
            ids, lines, n = [], [], 0
    if ids:
        yield ids, lines


def _postings(docs: DataFrame, errors: int | None, min_chars: int) -> DataFrame:
    """(key, tag) of the lines: a tag is a line's id whose lowest bits tell whether it probes, whether the key is live for sure, and whether it stands for such postings. A task repeats few lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for ids, lines in _portions(_distinct_lines(batch, seen, min_chars)):
                if errors is None:
                    of, keys, probes = near_keys(lines)
                else:
                    own, other = ([f(x, errors) for x in lines] for f in (index_keys, probe_keys))
                    of = np.repeat(np.arange(len(lines)), [len(x) + len(y) for x, y in zip(own, other, strict=True)])
                    keys = np.array([k for x, y in zip(own, other, strict=True) for k in (*x, *y)], np.uint64)
                    probes = np.array([p for x, y in zip(own, other, strict=True) for p in [False] * len(x) + [True] * len(y)], bool)
                if not len(keys):
                    continue
                arrays = [pa.array(x) for x in _without_crowds(keys.view(np.int64), np.array(ids, np.uint64)[of].view(np.int64) | probes)]
                for at in range(0, len(arrays[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 100_000) for x in arrays], ["key", "tag"])

    return map_arrow(docs.select("text"), run, "key long, tag long")


def _live(batches: Iterator[pa.RecordBatch], at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by key and tag those whose key two lines have, one of which is indexed by it; the sure ones as they come.

    Near-equal lines meet under many keys: keys with the same lines become one.
    """

    def out(keys: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tags & ~7), pa.array((tags & _PROBE) != 0)], ["key", "id", "probe"])

    held_k, held_t = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            keys, tags = (batch.column(k).to_numpy() for k in range(2))
            sure = (tags & _SURE) != 0
            if sure.any():
                yield out(keys[sure], tags[sure])
                keys, tags = keys[~sure], tags[~sure]
            held_k, held_t = np.append(held_k, keys), np.append(held_t, tags)
        if not len(held_k):
            continue
        first = np.flatnonzero(np.concatenate([[True], np.diff(held_k) != 0]))
        ends = np.append(first[1:], len(held_k))
        lines = held_t >> 3
        live = (lines[first] != lines[ends - 1]) & (np.minimum.reduceat(held_t & _PROBE, first) == 0)
        if batch is not None and len(held_k) - first[-1] < at_once:  # the last key may go on in the next batch
            live[-1] = False
        keep = np.repeat(live, ends - first)
        if keep.any():
            alone = np.bitwise_or.reduceat(held_t & _STANDS_IN, first) == 0
            alone[[0, -1]] = False  # a part of a key may have gone already, or be still to come
            fresh = np.concatenate([[True], (np.diff(held_k) != 0) | (np.diff(lines) != 0)])
            of_set = np.add.reduceat(np.where(fresh, _mixed(lines.view(np.uint64)), np.uint64(0)), first).view(np.int64)
            keys = np.repeat(np.where(alone, of_set, held_k[first]), ends - first)
            yield out(keys[keep], held_t[keep])
        # of a key that is live already two postings stand for the others
        index = np.arange(first[-1], len(held_k))
        if live[-1]:
            shown = index[(held_t[index] & _PROBE) == 0][0]
            index = np.array([shown, index[lines[index] != lines[shown]][0]])
        held_k, held_t = held_k[index], held_t[index]


def _live_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _live(batches)
    give_back()


def live(postings: DataFrame) -> DataFrame:
    """(key, id, probe) of the postings (key, tag) whose key brings two together; keys of the same ids may have become one."""
    # postings that are sure of their key are dealt out by line as well, so a key that many lines have isn't one task's
    apart = F.when(F.col("tag").bitwiseAND(_SURE) == 0, F.lit(0).cast("long")).otherwise(F.col("tag"))
    return postings.repartition("key", apart).sortWithinPartitions("key", "tag").mapInArrow(_live_of_task, "key long, id long, probe boolean")


def _wanted_texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """(line, text) of the lines in ``wanted``, and of a few others that the fixed-size filter lets through."""
    place = F.pmod(F.col("line"), F.lit(FILTER_BITS))
    words = wanted.select((place / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(line, 64) AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            found = list(_distinct_lines(batch, seen, min_chars))
            h = np.array([x for x, _ in found], dtype=np.uint64)
            at = h % np.uint64(FILTER_BITS)
            keep = np.flatnonzero(bits[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64)) & np.uint64(1)) if len(h) else []
            yield pa.RecordBatch.from_arrays([_signed([found[k][0] for k in keep]), pa.array([found[k][1] for k in keep], pa.string())], ["line", "text"])

    return map_arrow(docs.select("text"), run, "line long, text string").dropDuplicates(["line"])


@lru_cache(1 << 14)
def _signature(line: str) -> tuple[int, ...]:
    """Length, threshold in words, threshold in characters, and parities of the counts of hashed words (4 x 64) and of characters.

    An edit changes two parities at most, so two lines whose parities differ in
    more than twice their threshold aren't near.
    """
    of_words, of_chars = 0, 0
    for w in (words := line.split(" ")):
        of_words ^= 1 << (xxhash.xxh3_64_intdigest(w.encode()) & 255)
    if len(words) < FEW_WORDS:
        for c in line:
            of_chars ^= 1 << (ord(c) & 63)
    chars = max(0, _threshold(CHAR_CLASSES, len(line))) if len(words) < FEW_WORDS else -1
    return len(line), _threshold(WORD_CLASSES, len(words)), chars, *(of_words >> 64 * k & (1 << 64) - 1 for k in range(4)), of_chars


#: Up to so many pairs of lines are looked at one by one, more at once.
FEW_PAIRS = 64


def _may_link(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether two lines' lengths and signatures leave it open that they are near."""
    if abs(a[0] - b[0]) > max(1, max(a[0], b[0]) // SHARE):
        return False
    if (a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count() + (a[5] ^ b[5]).bit_count() + (a[6] ^ b[6]).bit_count() <= 2 * max(a[1], b[1]):
        return True
    return a[2] >= 0 and b[2] >= 0 and (a[7] ^ b[7]).bit_count() <= 2 * max(a[2], b[2])


def _may_be_near(x: list[str], y: list[str]) -> np.ndarray:
    """Flags of the pairs that lengths and signatures don't rule out."""
    p, q = ([_signature(line) for line in z] for z in (x, y))
    if len(x) * len(y) <= FEW_PAIRS:
        return np.array([[_may_link(i, j) for j in q] for i in p])
    a, b = (np.array(z, dtype=np.uint64) for z in ([(m[0], m[1] + 1, m[2] + 1, *m[3:]) for m in z] for z in (p, q)))
    n, tw, tc = (np.maximum.outer(a[:, k].astype(np.int64), b[:, k].astype(np.int64)) for k in range(3))
    tw, tc = tw - 1, tc - 1  # negative below the classes
    bits = lambda k: np.bitwise_count(np.bitwise_xor.outer(a[:, k], b[:, k])).astype(np.int64)
    few = np.logical_and.outer(a[:, 2] > 0, b[:, 2] > 0)
    close = np.abs(np.subtract.outer(a[:, 0].astype(np.int64), b[:, 0].astype(np.int64))) <= np.maximum(1, n // SHARE)
    return close & ((bits(3) + bits(4) + bits(5) + bits(6) <= 2 * tw) | few & (bits(7) <= 2 * tc))


class _Known:
    """What a task has found out about pairs of lines: which are linked by some path, and which have been compared in vain."""

    def __init__(self, most: int = 100_000):
        self._parent: dict[int, int] = {}
        self._vain: set[tuple[int, int]] = set()
        self._most = most

    def root(self, x: int) -> int:
        parent = self._parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def link(self, i: int, j: int, near: Callable[[], bool]) -> bool:
        """Whether the two are near and not linked yet; then they are from now on."""
        x, y = self.root(i), self.root(j)
        pair = (i, j) if i < j else (j, i)
        if x == y or pair in self._vain:
            return False
        if len(self._vain) > self._most or len(self._parent) > self._most:  # forgetting costs comparisons, no links
            self._vain.clear()
            self._parent.clear()
            x, y = i, j
        if not near():
            self._vain.add(pair)
            return False
        self._parent[max(x, y)] = min(x, y)
        return True


def _forest(batches: Iterator[pa.RecordBatch], errors: int | None) -> Iterator[pa.RecordBatch]:
    """Spanning links of each pair of tiles; lines that are linked already aren't compared again, nor are their texts read."""
    near = near_equal if errors is None else lambda a, b: within(a, b, errors)
    known = _Known()
    for batch in batches:
        u, v = [], []
        same = batch.column("same").to_pylist()
        sides = []
        for name in ("x", "y"):
            lists = batch.column(name)
            m, offsets = lists.flatten(), lists.offsets.to_numpy()
            ids, probes, lines = m.flatten()
            sides.append(((offsets - offsets[0]).tolist(), ids.to_pylist(), probes.to_numpy(zero_copy_only=False), lines))
        for row, own in enumerate(same):
            (at, ids, px, tx), (bt, jds, py, ty) = sides[0], sides[0] if own else sides[1]
            xs, ys = range(at[row], at[row + 1]), range(bt[row], bt[row + 1])
            root = known.root(ids[xs[0]]) if xs else 0
            if all(known.root(ids[k]) == root for k in xs) and (own or all(known.root(jds[k]) == root for k in ys)):
                continue  # most keys bring lines together that others have linked
            pairs = ~np.logical_and.outer(px[xs.start : xs.stop], py[ys.start : ys.stop])
            if own:
                pairs &= ~np.tri(len(xs), dtype=bool)
            a = [tx[k].as_py() for k in xs]
            b = a if own else [ty[k].as_py() for k in ys]
            if errors is None and not (own and len(xs) == 2):
                pairs &= _may_be_near(a, b)
            for i, k in np.argwhere(pairs).tolist():
                if known.link(ids[xs[i]], jds[ys[k]], lambda p=a[i], q=b[k]: near(p, q)):
                    u.append(ids[xs[i]])
                    v.append(jds[ys[k]])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def links(docs: DataFrame, errors: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(u, v): links that span the classes of different lines, by hash."""
    met = cut(live(_postings(docs, errors, min_chars)).groupBy("key", "id").agg(F.min("probe").alias("probe")))
    known = _wanted_texts(docs, met.select(F.col("id").alias("line")), min_chars)
    # near-equal lines differ in a SHARE-th of the longer one at most (or one edit), or in ``errors`` characters: lengths in neighbouring bands
    chars = F.length("text")
    band = F.floor(chars / errors) if errors else F.lit(0) if errors == 0 else F.floor(F.log(F.greatest(chars, F.lit(1)).cast("double")) / F.log(F.lit(SHARE / (SHARE - 1) + 1e-9)))
    members = met.join(known, met["id"] == known["line"]).select("key", band.cast("int").alias("band"), F.struct("id", "probe", "text").alias("m"))
    # lines with a neighbour in common are likely to be one task's, which compares no pair twice
    pairs = tile_pairs(members, TILE)
    pairs = pairs.repartition(F.array_min(F.transform("x", lambda m: m["id"])), F.size("y"))
    return map_arrow(pairs, lambda it: _forest(it, errors), "u long, v long")


#: A line that makes up a share of 1 / HEAVY of all occurrences goes round by broadcast, so there are HEAVY of them at most.
HEAVY = 4096


def drops(docs: DataFrame, errors: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, drop): for documents that lose lines, the numbers of those lines.

    The line of the smallest (doc_id, number) in each class stays.  Classes are
    those of near-equal lines, and of equal ones of any length that aren't
    blank; or, if ``errors`` is given, of lines of ``min_chars`` or more within
    that many edits.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    seen = cut(occurrences(docs, None if errors is None else min_chars))
    comp = connected_components(links(docs, errors, min_chars)).select(F.col("node").alias("line"), "component")
    # sums by line first, so that what meets by class is one row a distinct line
    lines = seen.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    lines = cut(lines.join(comp, "line", "left").select("line", "first", "n", F.coalesce("component", "line").alias("class")))
    classes = lines.groupBy("class").agg(F.min("first").alias("first"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    stays = lines.join(classes.withColumnRenamed("first", "stays"), "class", "left").withColumn("stays", F.coalesce("stays", "first"))
    repeats = cut(stays.where("n > 1 OR stays <> first").select("line", "stays", "n"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * HEAVY >= total
    often = F.broadcast(repeats.where(heavy).select("line", "stays"))
    found = seen.join(often, "line").union(seen.join(often, "line", "left_anti").join(repeats.where(~heavy).select("line", "stays"), "line"))
    rest = found.where(F.struct("doc_id", "line_no") != F.col("stays"))
    return rest.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def _left(text: Column, drop: Column) -> Column:
    """The text without some of its lines."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, k: ~F.array_contains(drop, k)), "\n")


def without_repeats(docs: DataFrame, errors: int | None = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the ``text`` left, and ``n_lines`` and ``n_dropped``: one row for each row.

    Lines end at newlines; blank ones always stay, and with ``errors`` those under ``min_chars`` code points.
    Null and empty texts, and rows without doc_id, are left as they are.  Rows
    of one doc_id count as one document: equal lines at the same place in them
    don't make each other drop.  Other columns stay whatever their names; only
    ``n_lines`` and ``n_dropped`` are replaced.
    """
    names = docs.columns
    found = drops(docs, errors, min_chars).select(F.col("doc_id").alias("of"), "drop")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).join(found, F.col("row.doc_id").cast("long") == F.col("of"), "left")
    text = F.col("row.text").cast("string")
    left = F.when(F.col("drop").isNull(), text).otherwise(_left(text, F.col("drop")))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    counts = [n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*(left.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names if c not in ("n_lines", "n_dropped")), *counts)
