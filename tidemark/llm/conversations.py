"""Repair of conversation structure: the cheapest edits, by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows taken, state of the grammar ``(s?(ua)+)?``).  Edits lead
from node to node: Keep (0), Rerole to user or assistant (3), Delete (4), Insert
an empty turn (3); a truncated row that stays costs 3 more; blank and repeated
rows can only go.  A forward and a reverse heap meet; all crossings of equal
cost are finished, and the least concatenated audit (initials of the edits in
order) wins.  An audit tells its cost, so of equal-cost audits over the same
rows none begins another; that is why the least one of a part stays the least
one whatever comes before and after.

Rows travel without their texts until the edits are known: equal rows are
counted first, repeats are found by digest, and one range shuffle by
(conversation, turn) lays conversations out in blocks of at most ``BLOCK`` rows,
so no conversation, however long, has to be solved in one task.  A conversation
in one block is solved there; of a longer one each block is solved from each
state to each state and the blocks are then chained.  The texts are shuffled
once, to be hashed in order: SHA-256 of one text is sequential, so that step
streams a conversation through one task, holding its audit and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import bounded_batches, cut, give_back, slices

#: Rows of a block.
BLOCK = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_BEFORE = {0: (), 1: (), 2: (0, 1, 3), 3: (2,)}
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)


def _out(pattern: str, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows taken, state) of the edits that leave a node."""
    yield INSERT, "I", i, _NEXT[q]
    if i < len(pattern):
        c = pattern[i]
        yield DELETE, "D", i + 1, q
        if c != "x":
            more = TRUNCATED if c.isupper() else 0
            yield REROLE + more, "R", i + 1, _NEXT[q]
            kept = _KEPT.get((c.lower(), q))
            if kept is not None:
                yield KEEP + more, "K", i + 1, kept


def _in(pattern: str, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows taken, state) of the edits that lead to a node, with the node they leave."""
    for p in _BEFORE[q]:
        yield INSERT, "I", i, p
    if i:
        c = pattern[i - 1]
        yield DELETE, "D", i - 1, q
        if c != "x":
            more = TRUNCATED if c.isupper() else 0
            for p in _BEFORE[q]:
                yield REROLE + more, "R", i - 1, p
            for (kind, p), kept in _KEPT.items():
                if kind == c.lower() and kept == q:
                    yield KEEP + more, "K", i - 1, p


def solve(pattern: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost, and the least audit of that cost, from a state over some rows to one of some states; None if there is no way.

    A row is ``s``, ``u``, ``a`` or ``o`` (another role), in upper case if
    truncated; ``x`` has to go.
    """
    n = len(pattern)
    # equal costs are settled in order of place: Keep alone costs nothing, and it changes the place
    ahead, back = [(0, 0, "", start)], [(0, 0, "", q) for q in ends]
    there: dict[tuple[int, int], tuple[int, str]] = {}
    here: dict[tuple[int, int], tuple[int, str]] = {}
    best = float("inf")
    while ahead and back and ahead[0][0] + back[0][0] <= best:
        if ahead[0][0] <= back[0][0]:
            cost, i, audit, q = heappop(ahead)
            if (i, q) in there:
                continue
            there[i, q] = cost, audit
            if (i, q) in here:
                best = min(best, cost + here[i, q][0])
            for more, initial, j, p in _out(pattern, i, q):
                if (j, p) not in there:
                    heappush(ahead, (cost + more, j, audit + initial, p))
                if (j, p) in here:
                    best = min(best, cost + more + here[j, p][0])
        else:
            cost, left, audit, q = heappop(back)
            i = n - left
            if (i, q) in here:
                continue
            here[i, q] = cost, audit
            if (i, q) in there:
                best = min(best, cost + there[i, q][0])
            for more, initial, j, p in _in(pattern, i, q):
                if (j, p) not in here:
                    heappush(back, (cost + more, n - j, initial + audit, p))
                if (j, p) in there:
                    best = min(best, cost + more + there[j, p][0])
    found = None
    for (i, q), (cost, audit) in there.items():
        at = here.get((i, q))
        if at and cost + at[0] == best:
            found = min(filter(None, (found, (best, audit + at[1]))))
        for more, initial, j, p in _out(pattern, i, q):
            at = here.get((j, p))
            if at and cost + more + at[0] == best:
                found = min(filter(None, (found, (best, audit + initial + at[1]))))
    return found


_solved = lru_cache(maxsize=4096)(solve)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of conversations after the damage that a row's crc32 deals out; dropped rows have no copies."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(of("text"), "[.!?]", "")).otherwise(of("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(of("role")).alias("role"),
        text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_BLOCK = "conv long, seq long, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, routes array<struct<q:int,p:int,cost:long,audit:string>>, whole boolean"


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, as blocks with what they count and the ways over them."""
    names = [x.split(" ")[0] for x in _BLOCK.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names[:7]] + [(x, pa.string()) for x in names[7:9]] + [(x, pa.int64()) for x in names[9:12]]
                       + [("routes", pa.list_(pa.struct([("q", pa.int32()), ("p", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("whole", pa.bool_())])
    base, seq, conv, first_conv, out = TaskContext.get().partitionId() << 33, 0, (), True, []
    pattern: list[str] = []
    held = {}

    def fresh() -> None:
        pattern.clear()
        held.update(blank=0, duplicate=0, truncated=0, illegal=0, head=None, tail=None, low=None, high=None, turns=0, parts=held.get("parts", 0))

    def close(whole: bool) -> None:
        nonlocal seq
        p = "".join(pattern)
        if whole:
            cost, audit = _solved(p)
            routes = [{"q": 0, "p": 0, "cost": cost, "audit": audit}]
        else:
            ways = ((q, e, _solved(p, q, (e,))) for q in range(4) for e in range(4))
            routes = [{"q": q, "p": e, "cost": w[0], "audit": w[1]} for q, e, w in ways if w]
        out.append((conv[0], base + seq, len(p), held["blank"], held["duplicate"], held["truncated"], held["illegal"], held["head"], held["tail"], held["low"], held["high"], held["turns"], routes, whole))
        seq += 1
        held["parts"] += 1
        fresh()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
        out.clear()
        return made

    fresh()
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "kind", "again", "times"))
        for c, turn, initial, kind, again, times in zip(*cols, strict=True):
            if not conv or conv[0] != c:
                if conv:
                    # the first conversation of a partition may have begun in the one before
                    close(not first_conv and not held["parts"])
                    first_conv = False
                held["parts"], conv = 0, (c,)
            for k in range(times):
                if len(pattern) == block:
                    close(False)
                if held["tail"] is None:
                    held["head"] = initial
                elif held["tail"] + initial not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["tail"] = initial
                if turn is not None and turn != held["high"]:
                    held["low"], held["high"], held["turns"] = turn if held["low"] is None else held["low"], turn, held["turns"] + 1
                if kind == "blank":
                    held["blank"] += 1
                    pattern.append("x")
                elif again or k:
                    held["duplicate"] += 1
                    pattern.append("x")
                else:
                    known = initial if initial in ("s", "u", "a") else "o"
                    held["truncated"] += kind == "truncated"
                    pattern.append(known.upper() if kind == "truncated" else known)
        if out:
            yield flush()
    if conv:
        close(False)
        yield flush()


_FOUND = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations, in order, as one row for each conversation."""
    conv, sums, ways, tail, low, high, turns = (), [0] * 4, {}, None, None, None, 0
    out: list[dict] = []

    def close() -> None:
        cost, audit = min(w for q, w in ways.items() if q in ENDS)
        gaps = 0 if low is None else high - low + 1 - turns
        out.append(dict(zip(("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), (conv[0], min(gaps, (1 << 63) - 1), *sums, cost, audit), strict=True)))

    schema = pa.schema([(x.split(" ")[0], pa.string() if x.endswith("string") else pa.int64()) for x in _FOUND.split(", ")])
    for batch in batches:
        for r in batch.to_pylist():
            if not conv or conv[0] != r["conv"]:
                if conv:
                    close()
                conv, sums, ways, tail, low, high, turns = (r["conv"],), [0] * 4, {0: (0, "")}, None, None, None, 0
            sums = [a + r[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if tail is not None and r["head"] is not None:
                sums[3] += tail + r["head"] not in ("su", "ua", "au")
            tail = tail if r["tail"] is None else r["tail"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
            onward: dict[int, tuple[int, str]] = {}
            for w in r["routes"]:
                if w["q"] in ways:
                    cost, audit = ways[w["q"]]
                    way = (cost + w["cost"], audit + w["audit"])
                    onward[w["p"]] = min(onward.get(w["p"], way), way)
            ways = onward
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if conv:
        close()
        yield pa.RecordBatch.from_pylist(out, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its rows in order, as the hash of the repaired conversation."""
    conv, sha, lines, audit, at, q = (), None, 0, "", 0, 0
    convs, hashes = [], []

    def line(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":").encode() + text.encode())
        lines += 1

    def inserts() -> None:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            q = _NEXT[q]
            line("user" if q == 2 else "assistant", "")
            at += 1

    def close() -> None:
        inserts()
        convs.append(conv[0])
        hashes.append(sha.hexdigest())

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(hashes, pa.string())], ["conv", "repaired_sha256"])
        convs.clear()
        hashes.clear()
        return made

    for batch in batches:
        for c, is_row, copies, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "is_row", "copies", "role", "text")), strict=True):
            if not is_row:
                if conv:
                    close()
                conv, sha, lines, audit, at, q = (c,), hashlib.sha256(), 0, text, 0, 0
                continue
            for _ in range(copies):
                inserts()
                edit = audit[at]
                at += 1
                if edit == "R":
                    q = _NEXT[q]
                    line("user" if q == 2 else "assistant", text)
                elif edit == "K":
                    q = _KEPT[role[0], q]
                    line(role, text)
        if convs:
            yield flush()
    if conv:
        close()
        yield flush()


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(slices(batches))
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conv_id of ``rows``.

    ``rows`` has conv_id, turn, role and text; null roles and texts count as one
    space, null conv_ids are one conversation, null turns come first.  Rows of
    one turn come in the order of a digest of role and text.  Equal rows are
    repeats.  Conversations of which no row is left have zeros, an empty audit
    and the hash of an empty text.  Other columns play no part, whatever their
    names.  An empty table gives no rows.
    """
    rows = damaged(rows)
    spaces = " \t\n\x0b\x0c\r"
    bare = F.rtrim("text", F.lit(spaces))
    kind = F.when(F.length(bare) == 0, "blank").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "whole").otherwise("truncated")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    there = F.col("copies") > 0
    slim = rows.select("conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, digest).alias("digest"), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "copies")
    slim = cut(slim.groupBy("conv", "turn", "digest").agg(F.first("initial").alias("initial"), F.first("kind").alias("kind"), F.sum("copies").alias("times")))
    said = slim.where("times > 0 AND kind <> 'blank'").groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("often"))
    again = said.where("often > 1").select(F.col("conv").alias("of"), F.col("digest").alias("said"), "first")
    same = slim["conv"].eqNullSafe(again["of"]) & (slim["digest"] == again["said"])
    later = F.col("said").isNotNull() & (F.struct(F.col("turn").isNotNull(), "turn") > F.col("first"))
    marked = slim.join(again, same, "left").select("conv", "turn", "digest", "initial", "kind", "times", F.coalesce(later, F.lit(False)).alias("again"))
    laid = marked.repartitionByRange("conv", "turn", "digest").sortWithinPartitions("conv", "turn", "digest")
    blocks = cut(_map(laid, lambda it: _blocks(it, block), _BLOCK))
    whole = blocks.where("whole").select("conv", F.when(F.col("low").isNull(), 0).otherwise(F.least(F.expr("CAST(high AS DECIMAL(20,0)) - low + 1 - turns"), F.lit((1 << 63) - 1))).cast("long").alias("gaps"),
                                         "blank", "duplicate", "truncated", "illegal", F.col("routes")[0]["cost"].alias("cost"), F.col("routes")[0]["audit"].alias("audit"))
    parts = blocks.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "seq")
    found = cut(whole.union(_map(parts, _chained, _FOUND)))
    # a conversation's audit, then its rows
    head = found.select("conv", F.lit(0).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.where(there).select("conv", F.lit(1).alias("is_row"), "turn", digest.alias("digest"), "copies", "role", "text")
    stream = head.union(body).repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "digest").select("conv", "is_row", "copies", "role", "text")
    hashes = cut(_map(stream, _hashed, "conv long, repaired_sha256 string")).withColumnRenamed("conv", "of")
    return found.join(hashes, F.col("conv").eqNullSafe(F.col("of"))).select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
