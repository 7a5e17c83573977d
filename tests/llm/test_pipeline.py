"""The pipeline's stages, and run() itself, against plain versions of what they must do."""

import duckdb
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import line_dedup, mixing
from tidemark.llm.frames import cut


@pytest.fixture(scope="module")
def results(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, data))
        out[name] = before, docs
    return out


def _classes(n, linked):
    """The least number that each one reaches."""
    comp = list(range(n))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return [root(k) for k in range(n)]


def test_columns_and_ids(results):
    for name, (before, after) in results.items():
        if name != "best_fit_packing":
            assert after.columns == before.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}


def test_quality_keeps_the_good_and_drops_the_bad(results, spark, data):
    _, after = results["quality_classifier"]
    kept = {r[0] for r in after.select("doc_id").collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_lines_against_all_pairs(results):
    before, after = results["line_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    lines = [(t, d, k) for d, text in rows for k, t in enumerate(text.split("\n")) if t.strip()]
    texts = list(dict.fromkeys(t for t, _, _ in lines))
    long = [k for k, t in enumerate(texts) if len(t) >= line_dedup.MIN_CHARS]
    of = dict(zip(texts, _classes(len(texts), ((a, b) for a in long for b in long if a < b and line_dedup.near_equal(texts[a], texts[b]))), strict=True))
    had, dropped = set(), set()
    for t, d, k in lines:
        (dropped.add((d, k)) if of[t] in had else had.add(of[t]))
    want = {}
    for d, text in rows:
        left = [t for k, t in enumerate(text.split("\n")) if (d, k) not in dropped]
        if len(left) == len(text.split("\n")) or "\n".join(left).strip(" \t\n\x0b\x0c\r"):
            want[d] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates_against_all_pairs(results):
    before, after = results["simhash_near_dedup"]
    ids = sorted(r["doc_id"] for r in before.collect())
    texts = {r["doc_id"]: r["text"].lower().split() for r in before.collect()}
    sets = [{tuple(texts[d][k : k + 5]) for k in range(max(1, len(texts[d]) - 4))} for d in ids]
    comp = _classes(len(ids), ((a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    assert [r["doc_id"] for r in after.orderBy("doc_id").collect()] == [d for k, d in enumerate(ids) if comp[k] == k]


def test_mixing_against_its_sql(results):
    before, after = results["source_mixing"]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    sql = mixing.ORACLE.replace("CAST(coalesce(sum(tokens), 0) AS BIGINT) * 8 // 10", "CAST(coalesce(sum(tokens), 0) AS BIGINT)")
    assert sql != mixing.ORACLE
    want = {r[0]: r[-1] for r in con.execute(sql).fetchall() if r[-1]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_packing_holds_every_token(results):
    before, after = results["best_fit_packing"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.toPandas()
    assert rows.length.sum() == want
    full = rows.sort_values(["sequence_id", "offset"])
    assert (full.groupby("sequence_id").length.sum() <= 4096).all()
    assert (full.offset == full.groupby("sequence_id").length.cumsum() - full.length).all()
    assert rows.sequence_id.nunique() <= 1.02 * want / 4096 + 1


def test_line_stage_keeps_other_columns_and_drops_blank_leftovers(spark, data):
    line = "one line that is long enough to be found again, word by word, in each of these texts"
    rows = [(1, line + "\nfirst", 1, "mine", "a"), (2, line + "\n \t", 2, "mine", None), (3, line + "\n\n", 3, None, "c"), (4, "\t\n", 4, "mine", "d"), (5, None, 5, "mine", "e"), (6, "other\n" + line, 6, "x", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, n_dropped string, n_lines string")
    got = corpus_pipeline.first_lines(spark, docs, data)
    assert got.dtypes == docs.dtypes
    want = {(1, line + "\nfirst", 1, "mine", "a"), (4, "\t\n", 4, "mine", "d"), (5, None, 5, "mine", "e"), (6, "other", 5, "x", "f")}
    assert {tuple(r) for r in got.collect()} == want


def test_near_duplicate_stage_loses_no_link_near_the_threshold(spark, data):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(15):
        base = [f"w{c}x{k}" for k in range(300)]
        for _ in range(40):
            words = [f"n{rng.integers(10**9)}" if rng.random() < 0.0117 else w for w in base]
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    linked = [(a, b) for a in range(len(rows)) for b in range(a // 40 * 40, a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = _classes(len(rows), linked)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, data).select("doc_id").collect()}
    assert got == {k for k, c in enumerate(comp) if k == c} and 15 < len(got) < 450


def test_run_is_all_stages(results, spark, data):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (corpus_pipeline.run(spark, data), results["best_fit_packing"][1]))
    assert got == want


def test_stages_take_awkward_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.orderBy("doc_id").limit(20)
    odd = first.unionByName(first.limit(3)).unionByName(first.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(first.limit(3).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6}))
    odd = odd.unionByName(first.limit(3).withColumns({"text": F.lit(""), "doc_id": F.col("doc_id") + 2 * 10**6, "source": F.lit(None).cast("string")}))
    for rows in (odd, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, data)
            assert name == "best_fit_packing" or after.columns == docs.columns
            after.count()
