"""Merkle manifest of a dataset: built levels as parent-linked node rows, climbed by a recursive query.

A row's leaf is a hash of its fields.  Leaves of a group, in order, form a
binary tree (a last node without a sibling is hashed alone), the groups'
subroots, in order, another one above.  A proof lists a leaf's siblings up to
the root.

Building.  Positions come from one range shuffle by (group, id): the order
inside a partition and counts of what precedes, so no group, however large, is
sorted or numbered in one task.  ``STRIDE`` levels are hashed at a time, over
runs of 2**STRIDE consecutive nodes; what is stored of a run is a row for each
of its nodes, with the siblings that are met up to the run's top, and a link to
that top: the parent row, which is one of the next stretch.

Climbing.  A recursive query starts with all leaves, changed or not, and in each
round joins the parent link, appends that row's siblings to the proof and folds
them into the hash.  The sides are the bits of the position.  Rounds are few (5
for 10**11 leaves of a group) and only the rows above the leaves are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut

#: Levels of a tree that a stored row spans.
STRIDE = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column | str) -> Column:
    """A field as a leaf takes it: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def ranked(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """``nodes`` with ``pos``, the place from 0 in their ``group``, and ``size``, the group's number of nodes.

    Rows that agree in ``group`` and ``order`` are dealt out too: their places among each other are arbitrary.
    """
    keys = [group, *order, "salt"]
    laid = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    laid = cut(laid.drop("salt").withColumn("at", at).withColumn("part", F.shiftright("at", 33).cast("int")))
    # one row for each group of a partition: no more than partitions and groups together
    held = laid.groupBy(F.col(group).alias("of"), F.col("part").alias("of_part")).agg(F.min("at").alias("least"), F.count("*").alias("held"))
    own = Window.partitionBy("of")
    upto = F.sum("held").over(own.orderBy("of_part")) - F.col("held")
    starts = cut(held.select("of", "of_part", (F.col("least") - upto).alias("shift"), F.sum("held").over(own).alias("size")))
    return laid.join(starts, (F.col(group) == F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("pos", F.col("at") - F.col("shift")).drop("at", "part", "of", "of_part", "shift")


def _stretch(nodes: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """(rows, tops) of one stretch of levels over ``nodes`` (tree, hop, pos, size, hash, payload).

    A row has its address, the ``siblings`` from its own level up (an empty text
    where a run ends before one) and the place of its run's top; ``tops`` are
    the next stretch's nodes.
    """
    width = 1 << stride
    levels = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    runs = nodes.groupBy("tree", "hop", "size", F.shiftright("pos", stride).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "payload"))).alias("m"))
    runs = runs.withColumn("up", F.least(levels, F.lit(stride))).withColumn("l0", F.col("m.hash"))
    for k in range(stride):
        above = f"transform(sequence(0, shiftright(size(l{k}) - 1, 1)), i -> sha2(concat(get(l{k}, 2 * i), coalesce(get(l{k}, 2 * i + 1), '')), 256))"
        runs = runs.withColumn(f"l{k + 1}", F.expr(f"CASE WHEN up > {k} THEN {above} END"))
    met = ", ".join(f"CASE WHEN up > {k} THEN coalesce(get(l{k}, shiftright(i, {k}) ^ 1), '') END" for k in range(stride))
    row = f"struct(n.pos AS pos, n.hash AS hash, n.payload AS payload, array_compact(array({met})) AS siblings)"
    top = F.get(F.coalesce(*(f"l{k}" for k in range(stride, -1, -1))), F.lit(0))
    runs = cut(runs.select("tree", "hop", "run", "size", top.alias("top"), F.expr(f"transform(m, (n, i) -> {row})").alias("m")))
    rows = runs.select("tree", "hop", "run", (F.col("size") > width).alias("goes_on"), F.inline("m"))
    tops = runs.select("tree", (F.col("hop") + 1).alias("hop"), F.col("run").alias("pos"), (F.shiftright(F.col("size") - 1, stride) + 1).alias("size"), F.col("top").alias("hash"))
    return rows, tops


def _levels(nodes: DataFrame, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """The rows of all stretches of some trees, lowest first, and (tree, hash) of their tops."""
    found, tops = [], []
    while True:
        rows, above = _stretch(nodes, stride)
        found.append(rows)
        above = cut(above)
        tops.append(above.where("size = 1").select("tree", "hash"))
        nodes = above.where("size > 1").withColumn("payload", F.lit(None).cast(rows.schema["payload"].dataType))
        if nodes.isEmpty():
            break
    return found, reduce(DataFrame.union, tops)


@contextmanager
def _unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """No limit on the rows of a recursive query while it runs; the session's own setting comes back."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: One round a stretch. Sides are the bits of a node's place; a proof is kept as bytes while it grows.
CLIMB = """
WITH RECURSIVE climb(payload, leaf, proof, folded, subroot, tree, hop, pos) AS (
  SELECT payload, hash, unhex(array_join(siblings, '')),
         aggregate(transform(siblings, (s, k) -> struct(s AS s, shiftright(place, k) & 1 AS right)), payload.changed,
                   (a, x) -> sha2(CASE WHEN x.right = 1 THEN concat(x.s, a) ELSE concat(a, x.s) END, 256)),
         CAST(NULL AS STRING), up_tree, up_hop, up_pos
  FROM {leaves}
  UNION ALL
  SELECT c.payload, c.leaf, concat(c.proof, unhex(array_join(n.siblings, ''))),
         aggregate(transform(n.siblings, (s, k) -> struct(s AS s, shiftright(n.place, k) & 1 AS right)), c.folded,
                   (a, x) -> sha2(CASE WHEN x.right = 1 THEN concat(x.s, a) ELSE concat(a, x.s) END, 256)),
         CASE WHEN n.hop = -1 THEN n.hash ELSE c.subroot END, n.up_tree, n.up_hop, n.up_pos
  FROM climb c JOIN {above} n ON c.tree = n.tree AND c.hop = n.hop AND c.pos = n.pos
)
SELECT payload, leaf, subroot, proof, folded FROM climb WHERE tree IS NULL
"""


def build(leaves: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, str | None]:
    """(leaf rows, rows above, root) of ``leaves`` (tree, hash, payload and what ``ranked`` gives).

    Every row is parent-linked: ``up_tree``, ``up_hop`` and ``up_pos`` are the
    address of a row above, null for rows whose run's top is the root.
    """
    stretches, subroots = _levels(leaves.withColumn("hop", F.lit(0)), stride)
    none = F.lit(None)
    ups = [F.when(F.col("goes_on"), F.col("hop") + 1).otherwise(-1).alias("up_hop"), F.when(F.col("goes_on"), F.col("run")).otherwise(0).alias("up_pos")]
    linked = [s.select("tree", "hop", "pos", F.col("pos").alias("place"), "hash", "payload", "siblings", F.col("tree").alias("up_tree"), *ups) for s in stretches]
    # the tree above: its leaves keep the address of the tree they stand for
    heads = ranked(subroots.select(F.lit("").alias("all"), F.col("tree").alias("of_tree"), "hash"), "all", "of_tree")
    heads = heads.select(F.col("all").alias("tree"), F.lit(0).alias("hop"), "pos", "size", "hash", F.struct("of_tree").alias("payload"))
    upper, roots = _levels(heads, stride)
    goes_on = F.col("goes_on")
    ups = [F.when(goes_on, F.col("tree")).alias("up_tree"), F.when(goes_on, F.col("hop") + 1).alias("up_hop"), F.when(goes_on, F.col("run")).alias("up_pos")]
    for k, s in enumerate(upper):
        address = [F.col("payload.of_tree").alias("tree"), F.lit(-1).alias("hop"), F.lit(0).cast("long").alias("pos")] if k == 0 else ["tree", "hop", "pos"]
        linked.append(s.select(*address, F.col("pos").alias("place"), "hash", none.cast(stretches[0].schema["payload"].dataType).alias("payload"), "siblings", *ups))
    root = roots.select("hash").first()
    return linked[0], cut(reduce(DataFrame.unionByName, linked[1:]).drop("payload")), root and root[0]


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of ``docs``.

    A leaf hashes doc_id, source, lang, n_chars and text; each lang's leaves
    ascend by doc_id (null first).  Rows with the same doc_id come in the order
    of their leaves; rows that are alike in all five columns are leaves of their
    own.  Where 7 divides the crc32 of the doc_id, the check is of a row whose
    n_chars is one more; rows without doc_id or n_chars stay as they are.  A
    single leaf's proof is empty.  An empty table gives no rows.  Other columns
    play no part, whatever their names.
    """
    spark = docs.sparkSession
    id_, chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    tampered = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 0, F.lit(False))
    before, after = [field(id_), field("source"), field("lang")], field("text")
    leaf = digest(*before, field(chars), after)
    changed = F.when(tampered & chars.isNotNull(), digest(*before, field(chars + 1), after)).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    found = ranked(cut(docs.select(tree.alias("tree"), id_.alias("id"), leaf.alias("hash"), changed.alias("changed"))), "tree", "id", "hash")
    leaves, above, root = build(found.select("tree", "pos", "size", "hash", F.struct("id", "changed").alias("payload")), stride)
    with _unlimited_rows(spark):
        climbed = cut(spark.sql(CLIMB, leaves=leaves, above=above).select("payload.id", "leaf", "subroot", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded"))
    root = F.lit(root).cast("string")
    return climbed.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
