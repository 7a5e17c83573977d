"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding has this property: a token sequence is *the* encoding of
its bytes exactly if each pair of neighbours is, i.e. if encoding the two
tokens' bytes together gives these two tokens back.  So the last token of every
prefix follows from shorter prefixes: it is the one vocabulary entry ending
there that is compatible with the last token of what precedes it.  One pass
over a word therefore gives the token count of each of its prefixes; summed
over words it answers how many tokens any prefix has, whether a text is over a
limit, and where to cut it, without encoding anything again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_arrow, texts

#: Chunks remembered by a worker; the memory starts anew when it is full.
REMEMBERED = 1_000_000
#: A blank and what follows up to white space, or white space: no word of the vocabulary's split crosses these.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python's ``re`` but not for the vocabulary's split.
_ODD = re.compile("[\x1c-\x1f]")
_CHUNK_ODD = regex.compile(r" ?[^\p{White_Space}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The last chunk of a text with the white space before it.
_TAIL = regex.compile(r"(?r)\p{White_Space}*\P{White_Space}*\Z")
#: The split of byte-level BPE vocabularies of this kind.
_WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _blank(s: str) -> bool:
    return s.isspace() and not _ODD.search(s)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes under a byte-level BPE in a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letter = _byte_letters()
        word = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
        self._id = {word[t]: i for t, i in model["vocab"].items() if t in word}
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (word[x] for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self._id[a], self._id[b]
            self._rank[pair] = rank
            self._parts[self._id[a + b]] = (rank, *pair)
        self._longest = max(map(len, self._id))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, int] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, encoded together, give a and b.

        Undoes their merges from the last to the first; each state must not
        have had an earlier merge across the border.
        """
        found = self._fits.get((a, b))
        if found is not None:
            return found
        x, y, before, inclusive, ok = a, b, len(self._rank), False, True
        while True:
            cross = self._rank.get((x, y))
            if cross is not None and (cross < before or inclusive and cross == before):
                ok = False
                break
            left, right = self._parts.get(x), self._parts.get(y)
            if left is None and right is None:
                break
            if right is not None and (left is None or right[0] >= left[0]):
                before, inclusive, y = right[0], True, right[1]  # at equal ranks the left merge came first
            else:
                before, inclusive, x = left[0], False, left[2]
        if len(self._fits) > 4 * REMEMBERED:
            self._fits.clear()
        self._fits[(a, b)] = ok
        return ok

    def word_prefixes(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... bytes of one word of the split."""
        ids, counts, last = self._id, [0] * (len(word) + 1), [-1] * (len(word) + 1)
        fits, longest = self._fits, self._longest
        for p in range(1, len(word) + 1):
            for start in range(p - 1, max(-1, p - longest - 1), -1):
                t = ids.get(word[start:p])
                if t is None:
                    continue
                if start == 0:
                    counts[p], last[p] = 1, t
                    break
                prev = last[start]
                ok = fits.get((prev, t))
                if ok if ok is not None else self._compatible(prev, t):
                    counts[p], last[p] = counts[start] + 1, t
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def _chunk(self, chunk: str) -> int:
        """Tokens of a chunk, remembered."""
        n = self._known.get(chunk)
        if n is None:
            words = _WORD.findall(chunk)
            n = self.word_prefixes(chunk.encode())[-1] if len(words) == 1 else sum(map(self._chunk, words))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[chunk] = n
        return n

    def _chunks(self, text: str) -> list[str]:
        return (_CHUNK_ODD if _ODD.search(text) else _CHUNK).findall(text)

    def _plain_counts(self, text: str) -> tuple[list[str], list[int]]:
        chunks = self._chunks(text)
        try:
            return chunks, list(map(self._known.__getitem__, chunks))
        except KeyError:
            return chunks, list(map(self._chunk, chunks))

    def _segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at strings of special tokens; True marks those."""
        if self._special is None:
            return [(text, False)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it counts as that one token."""
        return sum(1 if special else sum(self._plain_counts(part)[1]) for part, special in self._segments(text))

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... code points, each as if the text ended there."""
        out, base, before = [0], 0, ""
        for part, special in self._segments(text):
            if special:
                # inside its string the special token isn't one yet: it is text that follows the last chunk
                out += self._inside(before, part, base)
                base, before = base + 1, ""
                out.append(base)
                continue
            for kind, piece in self._pieces(part):
                out += [base + n for n in kind]
                base += self._chunk(piece) if piece else 0
            if part:
                before = part
        return out

    def _inside(self, before: str, special: str, base: int) -> list[int]:
        """Counts at the prefixes that end within a special token's string, where ``before`` of ``base`` tokens precedes it."""
        tail = _TAIL.search(before)[0]
        known = base - sum(self._plain_counts(tail)[1])
        return [known + sum(self._plain_counts(tail + special[:k])[1]) for k in range(1, len(special))]

    def _pieces(self, part: str) -> Iterator[tuple[list[int], str]]:
        """For each word of a segment the counts at its code points, and the word.

        A run of white space counts whole while a text ends in it, though its
        last blank belongs to the next word once one follows.
        """
        at, words = 0, _WORD.findall(part)
        k = 0
        while k < len(words):
            word = words[k]
            if _blank(word) and k + 1 < len(words):
                end = at + len(word)
                lead = int(_blank(part[end : end + 1]))
                run = self.char_counts(part[at : end + lead])
                yield run[: len(word)], word
                if lead:  # the blank after the run, still counted with the run
                    nxt, own = words[k + 1], self._chunk(word)
                    rest = self.char_counts(nxt)
                    yield [run[-1] - own, *rest[1:]], nxt
                    at, k = end + len(nxt), k + 2
                    continue
            else:
                yield self.char_counts(word), word
            at, k = at + len(word), k + 1

    def char_counts(self, word: str) -> list[int]:
        """Counts at the ends of the code points of one word."""
        if word in ("'re", "'ve", "'ll"):
            return [1, 2, self._chunk(word)]  # before its last letter it isn't this word yet
        counts = self.word_prefixes(word.encode())
        return [counts[n] for n in accumulate(len(c.encode()) for c in word)]

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        best = at = base = 0
        before = ""
        for part, special in self._segments(text):
            if special:
                if base + 1 > budget:
                    return max([best, *(at + k + 1 for k, n in enumerate(self._inside(before, part, base)) if n <= budget)])
                base, at, before = base + 1, at + len(part), ""
                best = at
                continue
            before = part or before
            chunks, counts = self._plain_counts(part)
            sums = list(accumulate(counts, initial=base))
            k = bisect_right(sums, budget) - 1
            if k == len(chunks):
                base, at = sums[-1], at + len(part)
                best = at
                continue
            k = max(0, k - 2)  # from a few chunks before the one that goes over
            start = sum(map(len, chunks[:k]))
            stop = start + sum(map(len, chunks[k : k + 4]))
            inner = self.prefixes(part[start:stop])
            return max(best, at + start + max(i for i, n in enumerate(inner) if sums[k] + n <= budget))
        return best


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter for a vocabulary file, one for each worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars), one row for each row of ``docs``.

    ``fits_chars`` is the length in code points of the longest prefix within
    ``limit`` tokens.  Null texts count as empty: no bytes, no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            t = texts(batch)
            n = [c.count(x) for x in t]
            fits = [len(x) if k <= limit else c.longest_prefix(x, limit) for x, k in zip(t, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fits, pa.int64()), pa.array([len(x.encode()) for x in t], pa.int64())], ["doc_id", "n_tokens", "fits_chars", "n_bytes"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, fits_chars long, n_bytes long")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, prefix_tokens): for each row the token counts of its prefixes of 0, 1, ... code points.

    Null and empty texts have the one prefix of no tokens; repeated rows and rows without id are rows like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.prefixes(x) for x in texts(part)], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, prefix_tokens array<int>")
