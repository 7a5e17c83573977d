"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree (domain, language, source) by the weights of
siblings.  What a node can't use, because all its documents times the allowed
epochs hold fewer tokens, goes to its siblings first; only when a whole subtree
is exhausted does its parent hand the shortage to the parent's own siblings.
Each leaf then takes whole epochs and, of one more, the documents at the front
of a seeded order whose tokens fit.

Everything is integer arithmetic in DataFrame operations.  The front of a
leaf's order is found without sorting the leaf: tokens are summed by a prefix
of the order's hash (BUCKETS of them a leaf), and only the one bucket that the
budget ends in is looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut

#: Hex digits of the hash by which a leaf's tokens are summed: 4096 buckets.
BUCKET_DIGITS = 3
TREE = ("domain", "lang", "source")


def word_tokens(text: Column) -> Column:
    """Tokens of a text, counted as runs between white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A source's domain where a table has none: a quarter of the sources by hash of the name."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(digit < "4", "domain_a").when(digit < "8", "domain_b").when(digit < "c", "domain_c").otherwise("domain_d")


def weight_of(level: str) -> Column:
    """Default weights of siblings: English twice as heavy as each other language, all else alike."""
    return F.when(F.col("lang") == "en", F.lit(2)).otherwise(F.lit(1)) if level == "lang" else F.lit(1)


def share_out(children: DataFrame, parents: DataFrame | int, on: list[str], name: str) -> DataFrame:
    """Children (``on``, ``name``, weight, cap) with their part of the parents' ``budget``; at the root, of a number.

    Children are filled in order of cap / weight: those whose fair share is at
    least their cap take just that, and what is left is shared by weight.
    """
    by = Window.partitionBy(*on, F.lit(0)) if on else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("weight"), name)
    x = children.where("weight > 0")
    x = x.join(parents.select(*on, "budget"), on) if on else x.withColumn("budget", F.lit(parents).cast("long"))
    x = x.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    x = x.withColumn("rest", F.sum("weight").over(by) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("weight"))
    x = x.withColumn("full", F.expr("cap * rest <= weight * (budget - before)"))
    x = x.withColumn("taken", F.sum(F.expr("if(full, cap, 0)")).over(by)).withColumn("open", F.sum(F.expr("if(full, 0, weight)")).over(by))
    return x.withColumn("part", F.expr("if(full, cap, (weight * (budget - taken)) div open)")).drop("budget", "before", "rest", "full", "taken", "open").withColumnRenamed("part", "budget")


def leaves_budgets(sizes: DataFrame, budget: Column, max_epochs: int, weights=weight_of) -> DataFrame:
    """(domain, lang, source, tokens, budget) from each leaf's tokens; ``budget`` is of the column ``total``."""
    leaves = sizes.withColumn("cap", F.col("tokens") * max_epochs)
    have = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total"))
    parents: DataFrame | int = have.select(F.least(budget, F.col("total") * max_epochs).cast("long")).first()[0]
    on: list[str] = []
    for name in TREE:
        keys = [*on, name]
        children = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weights(name).cast("long"))
        parents = cut(share_out(children, parents, on, name))
        on = keys
    return parents.select(*TREE, "tokens", "budget")


def _places(domain: Column | None) -> list[Column]:
    """The tree's columns of a row; nulls count as empty names."""
    of = {"domain": domain_of(F.col("source")) if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}
    return [F.coalesce(of[x].cast("string"), F.lit("")).alias(x) for x in TREE]


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cuts(docs: DataFrame, budget: Column, max_epochs: int = 2, seed: int = 17, weights=weight_of, domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each row's place and tokens, and each leaf's (domain, lang, source, epochs, last): whole epochs and the last key taken of the next."""
    meta = cut(docs.select("doc_id", *_places(domain), word_tokens(F.col("text").cast("string")).alias("tokens")))
    sizes = cut(meta.groupBy(*TREE).agg(F.sum("tokens").alias("tokens")))
    leaves = leaves_budgets(sizes, budget, max_epochs, weights)
    leaves = cut(leaves.withColumn("epochs", F.expr("if(tokens > 0, budget div tokens, 0)")).withColumn("rest", F.expr("budget - epochs * tokens")).select(*TREE, "epochs", "rest"))
    keyed = meta.join(leaves, list(TREE)).withColumn("key", _key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*TREE, "bucket", "rest").agg(F.sum("tokens").alias("n"))
    up = Window.partitionBy(*TREE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(up))
    # the first bucket that doesn't fit, and the tokens before it; whole buckets before it are taken
    ends = cut(sums.where("upto > rest").groupBy(*TREE).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("e")).select(*TREE, "e.bucket", "e.before"))
    inside = keyed.join(ends, [*TREE, "bucket"])
    peers = Window.partitionBy(*TREE).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(peers)).where("upto <= rest").groupBy(*TREE).agg(F.max("key").alias("last"))
    # leaves whose bucket holds nothing that fits end right before that bucket
    found = leaves.join(ends, list(TREE), "left").join(last, list(TREE), "left")
    return meta, cut(found.select(*TREE, "epochs", F.coalesce("last", F.col("bucket"), F.lit("g")).alias("last")))


def copies(docs: DataFrame, budget: Column, max_epochs: int = 2, seed: int = 17, weights=weight_of, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies): how often each row of ``docs`` is taken.

    Repeated rows of a document are taken or left together.  Null languages and
    sources count as empty names, null texts as no tokens; a leaf without
    tokens takes each of its rows in the last, open epoch.  An empty table gives
    no rows.  The domain is ``domain`` if that is given, else it follows from
    the source; a column that happens to be named so is not looked at.
    """
    meta, ends = cuts(docs, budget, max_epochs, seed, weights, domain)
    taken = _key(seed, F.col("epochs"), F.col("doc_id")) <= F.col("last")
    return meta.join(ends, list(TREE)).select("doc_id", *TREE, "tokens", (F.col("epochs") + taken.cast("long")).alias("copies"))


def mixed(docs: DataFrame, budget: Column, max_epochs: int = 2, seed: int = 17, weights=weight_of, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`copies` takes it (by the same rules), with their own columns, whatever their names."""
    names = docs.columns
    _, ends = cuts(docs, budget, max_epochs, seed, weights, domain)
    rows = docs.select("doc_id", *_places(domain), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).join(ends, list(TREE))
    times = (F.col("epochs") + (_key(seed, F.col("epochs"), F.col("doc_id")) <= F.col("last")).cast("long")).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("again")).select("row.*")


#: The query's own tree, budget and seed, in SQL.
ORACLE = """
WITH meta AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '4' THEN 'domain_a' WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'domain_b'
         WHEN substr(md5(coalesce(source, '')), 1, 1) < 'c' THEN 'domain_c' ELSE 'domain_d' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM meta GROUP BY ALL),
top AS (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * 8 // 10 AS budget FROM leaf),
d0 AS (SELECT domain, CAST(sum(tokens) AS BIGINT) * 2 AS cap, 1 AS weight FROM leaf GROUP BY ALL),
d1 AS (SELECT d0.*, budget, sum(cap) OVER (ORDER BY cap / weight, domain ROWS UNBOUNDED PRECEDING) - cap AS before,
         sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM d0, top),
d2 AS (SELECT *, cap * rest <= weight * (budget - before) AS full_ FROM d1),
d3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS taken, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS open_ FROM d2),
d4 AS (SELECT domain, CASE WHEN full_ THEN cap ELSE (weight * (budget - taken)) // open_ END AS budget FROM d3),
l0 AS (SELECT domain, lang, CAST(sum(tokens) AS BIGINT) * 2 AS cap, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY ALL),
l1 AS (SELECT l0.*, budget, sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS UNBOUNDED PRECEDING) - cap AS before,
         sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM l0 JOIN d4 USING (domain)),
l2 AS (SELECT *, cap * rest <= weight * (budget - before) AS full_ FROM l1),
l3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY domain) AS taken, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain) AS open_ FROM l2),
l4 AS (SELECT domain, lang, CASE WHEN full_ THEN cap ELSE (weight * (budget - taken)) // open_ END AS budget FROM l3),
s0 AS (SELECT domain, lang, source, tokens, tokens * 2 AS cap, 1 AS weight FROM leaf),
s1 AS (SELECT s0.*, budget, sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING) - cap AS before,
         sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s0 JOIN l4 USING (domain, lang)),
s2 AS (SELECT *, cap * rest <= weight * (budget - before) AS full_ FROM s1),
s3 AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang) AS taken, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY domain, lang) AS open_ FROM s2),
s4 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN full_ THEN cap ELSE (weight * (budget - taken)) // open_ END AS BIGINT) AS budget FROM s3),
ends AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM s4),
keyed AS (SELECT m.doc_id, domain, lang, source, m.tokens, epochs, budget - epochs * e.tokens AS rest, md5(concat('17:', epochs, ':', m.doc_id)) AS key
  FROM meta m JOIN ends e USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run
"""
