"""MinHash near-duplicates against all pairs of whole sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash


def brute(rows):
    """doc_id -> (n_shingles, component_id) over whole sets of word pairs, by all pairs."""
    sets = {}
    for i, text in rows:
        words = bytes(text or "", "utf-8").lower().split()
        sets[i] = {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for a in range(len(ids)):
        x = sets[ids[a]]
        for b in range(a + 1, len(ids)):
            y = sets[ids[b]]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    links += x != y
                    p, q = root(ids[a]), root(ids[b])
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}, links


def check(docs, want, **sizes):
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(docs, **sizes).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def families(seed, count, members, words):
    """Texts of families whose members differ from one another by about a fifth of their word pairs."""
    rng = random.Random(seed)
    rows = []
    for f in range(count):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, words // 8))):
                text[rng.randrange(words) if words > 20 else rng.choice((0, words // 2, words - 1))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_given_texts_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    want, links = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert links > 5
    check(docs, want)


@pytest.mark.parametrize(("words", "sizes"), [(12, {}), (80, {}), (300, {"tile_shingles": 3000, "tile_sets": 8})])
def test_families_round_the_threshold(spark, words, sizes):
    rows = families(words, 12, 30, words)
    want, links = brute(rows)
    assert links > 50 and len({c for _, c in want.values()}) > 12 + (words > 20)
    check(spark.createDataFrame(rows, "doc_id long, text string"), want, **sizes)


def test_tiles_of_long_lists_lose_nothing(spark, monkeypatch):
    rows = families(5, 3, 120, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash.sketches(docs, 2).select(F.col("doc_id").alias("node"), "n", "sketch")
    found = {frozenset(r) for r in minhash.candidates(classes, tile=16).collect()}
    want, _ = brute(rows)
    parent = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a, b in map(sorted, found):
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(parent[i] == parent[c] for i, (_, c) in want.items())


def test_spanning_forest_is_the_links():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 60, (40, 12))
        sets = [np.unique(x) for x in base]
        near = lambda i, js, shared, s=sets: shared >= 5  # noqa: E731, ARG005
        u, v = minhash.spanning(sets, near)
        label, full = list(range(40)), list(range(40))
        for lab, pairs in ((label, zip(u, v, strict=True)), (full, ((i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 5))):
            for i, j in pairs:
                a, b = lab[i], lab[j]
                lab[:] = [min(a, b) if x in (a, b) else x for x in lab]
        assert label == full
        u, v = minhash.spanning(sets, near, look_at=7)
        label, part = list(range(40)), list(range(40))
        for lab, pairs in ((label, zip(u, v, strict=True)), (part, ((i, j) for i in range(7) for j in range(40) if i != j and len(np.intersect1d(sets[i], sets[j])) >= 5))):
            for i, j in pairs:
                a, b = lab[i], lab[j]
                lab[:] = [min(a, b) if x in (a, b) else x for x in lab]
        assert label == part


def test_awkward_rows(spark):
    long = "the quick brown fox jumps over a lazy dog " * 5000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo"), (8, "one\x1ctwo"), (9, long), (10, long + "once"), (9, long),
        (11, "a b c"), (11, "d e f"), (12, "d e F"), (13, "a b C"), (None, "a b c"), (None, "no id"), (None, None), (14, ""), (14, "one two"), (15, "é É x y"), (16, "É É x y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "key", "node", "component_id", "kept", "sketch", "h", "first")})
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    want = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 9, 9, True), (9, 9, 9, True), (10, 10, 9, False),
        (11, 2, 11, True), (11, 2, 11, True), (12, 2, 11, False), (13, 2, 11, False), (None, 2, 11, False), (None, 1, None, False), (None, 0, None, False), (14, 0, 6, False), (14, 1, 6, False), (15, 3, 15, True), (16, 3, 16, True),
    ]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_strangers_that_share_frequent_shingles_meet_in_no_list(spark):
    """Lists grow with near copies only: 800 strangers have 1 % of their word pairs in common, any two of them."""
    rng = random.Random(11)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(60))) for k in range(800)]
    copies = [(1000 + k, text + " again") for k, text in rows[:10]]
    classes = minhash.sketches(spark.createDataFrame(rows + copies, "doc_id long, text string")).select(F.col("doc_id").alias("node"), "n", "sketch").localCheckpoint()
    met = minhash.live(minhash._postings(classes)).select("key", F.shiftright("id", 3).alias("node")).distinct().collect()
    assert {k for k, _ in rows[:10]} | {k for k, _ in copies} <= {r.node for r in met}
    assert len({r.node for r in met}) < 30


@pytest.mark.parametrize("n", [5, 12, 200])
def test_bands_and_signs_of_just_similar_sets(n):
    rng, rows = np.random.default_rng(n), minhash.band_rows(0.8)
    assert rows == 5
    for _ in range(200):
        whole = np.unique(rng.integers(0, 2**63, n, dtype=np.int64))
        a, b = minhash._sketched([whole, whole[: -(-4 * n // 5)]], rows)
        assert (a == b)[minhash.SIGNS :].any()
        assert np.bitwise_count((a ^ b)[: minhash.SIGNS].view(np.uint64)).sum() <= minhash._most_signs(0.8)
