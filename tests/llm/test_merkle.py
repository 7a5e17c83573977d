"""The Merkle manifest against trees built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    doc_id, source, lang, n_chars, text = r
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels, k):
    for below in levels[:-1]:
        other = k ^ 1
        yield k & 1, below[other] if other < len(below) else ""
        k >>= 1


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    above = tree([trees[g][-1][0] for g in order])
    root = above[-1][0]
    for place, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            proof = [*siblings(trees[g], k), *siblings(above, place)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, int(tampered))
            for left, s in proof:
                folded = h(s, folded) if left else h(folded, s)
            yield r[0], leaf(r), trees[g][-1][0], root, h(*(s for _, s in proof)), folded, folded == root


def check(docs, rows, stride=merkle.STRIDE):
    got = [tuple(r) for r in merkle.manifest(docs, stride).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("stride", [2, 8])
def test_given_documents(spark, data, stride):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = check(docs, [tuple(r) for r in docs.select(*COLUMNS).collect()], stride)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_awkward_rows(spark):
    rows = [(k, "a", "x", 2**63 - 1 if k == 12 else k, "t") for k in range(1, 14)]
    rows += [(k, None, None, None, None) for k in (1, 1, 2)] + [(None, "", "", 0, "")] + [(5, "é", "=", 1, "naïve 😀 " * 30000), (5, "e", "=", 1, "b")] + [(7, "s", "-", 3, "v")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("tree", "hop", "pos", "at", "part", "size", "hash", "payload", "leaf", "root", "salt", "all")})
    check(docs.repartition(6), rows, 2)


def test_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = [(7, "s", "en", 3, "abc")]
    got = check(spark.createDataFrame(one, schema), one)
    assert got[0][4] == hashlib.sha256(b"").hexdigest()


def test_the_limit_on_rows_comes_back(spark, data):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(spark.read.parquet(f"{data}/documents.parquet").limit(3))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
