"""Encounters counted by cell where ships are met, so that no pair leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import Box
from tidemark.sources.shared import cut

#: Ships on each side of a block of pairs.
BLOCK = 8192
#: Pairs that a group has to have to be looked through in single precision first.
DENSE = 1 << 14
#: Pairs looked at in one step.
STEP = 1 << 15
#: Pairs that are measured together, and cells that are counted in an array.
MANY, ARRAY = 1 << 12, 1 << 20
#: Rows that are taken from a task's stream together, if no group has more.
ROWS = 1 << 16
_KEY = ["bucket", "cx", "cy", "a", "b"]
_AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


class Limits(NamedTuple):
    """What an encounter is, and the grid its middle is counted in."""

    kx: float
    dcpa_nm: float
    lookahead_min: float
    coarse_nm: float
    min_nm: float
    grid: int
    box: Box


def dealt(ships: DataFrame, radius_m: float, block: int = BLOCK) -> DataFrame:
    """Ships (``bucket, mmsi, lon, lat, vx, vy, x, y``) under keys (``bucket, cx, cy, a, b``), in which those with ``looks`` meet each other if ``b`` is 0, and all without it.

    So each two ships of a bucket in the same cell or in touching ones meet once.
    A cell looks at itself and at four of its neighbours.  Where there are more
    than ``block`` ships on a side, that side is dealt by hash into parts, and
    each two parts meet under a key of their own.
    """
    at = ["bucket", "cx", "cy"]
    laid = ships.withColumns({c: F.floor(F.col(v) / radius_m) for c, v in (("cx", "x"), ("cy", "y"))}).select(*at, "mmsi", "lon", "lat", "vx", "vy")
    steps = lambda also: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in (*_AHEAD, *also)))).alias("d")
    moved = [(F.col("cx") - F.col("d.i")).alias("cx"), (F.col("cy") - F.col("d.j")).alias("cy")]
    held = laid.groupBy(at).agg(F.count("*").alias("n"))
    seen = held.select("bucket", "cx", "cy", "n", steps(((0, 0),))).select("bucket", *moved, F.when((F.col("d.i") == 0) & (F.col("d.j") == 0), F.col("n")).otherwise(0).alias("n"), F.col("n").alias("o"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    crowded = seen.groupBy(at).agg(F.sum("n").alias("n"), F.sum("o").alias("o")).where(F.greatest("n", "o") > block).select(*at, parts("n").alias("_own"), parts("o").alias("_other"))
    # crowded cells are one in many; written down, their size is known to the joins
    crowded = cut(crowded)
    part = lambda n, seed: F.pmod(F.xxhash64("mmsi", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = lambda c: F.coalesce(c, F.lit(1))
    values = ["lon", "lat", "vx", "vy"]
    own = laid.join(crowded, at, "left").select(*at, part(one("_own"), 0).alias("a"), every(one("_other")).alias("b"), F.lit(True).alias("looks"), *values)
    near = laid.select("*", steps(())).select("bucket", *moved, "mmsi", *values).join(crowded, at, "left")
    near = near.select(*at, every(one("_own")).alias("a"), part(one("_other"), 1).alias("b"), F.lit(False).alias("looks"), *values)
    # the parts of one cell: each is looked at by those before it
    other = laid.join(crowded.where("_own > 1"), at).withColumn("_part", part(F.col("_own"), 0)).where("_part > 0")
    other = other.select(*at, every(F.col("_part")).alias("a"), part(F.col("_other"), 1).alias("b"), F.lit(False).alias("looks"), *values)
    # the number is given, since the work of a task grows with its pairs and not with its bytes
    spark = ships.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return own.unionAll(near).unionAll(other).repartition(n, *_KEY).sortWithinPartitions(*_KEY, F.desc("looks"))


def half_up(x, digits: int):
    """Units of the last digit next to ``x``, halves away from zero, as SQL's ``round`` of a double counts them (columns or arrays)."""
    unit = 10.0**digits
    if isinstance(x, Column):
        whole = F.floor(F.abs(x * unit))
        return F.signum(x) * (whole + F.when(F.abs(x * unit) - whole >= 0.5, 1).otherwise(0))
    y = np.abs(x * unit)
    whole = np.floor(y)
    return np.sign(x) * (whole + (y - whole >= 0.5))


def place(lon, lat, grid: int, box: Box):
    """Cell numbers before ``floor``, of positions rounded to five digits (columns or arrays)."""
    return ((half_up(v, 5) / 1e5 - low) / ((high - low) / grid) for v, low, high in ((lon, box.west, box.east), (lat, box.south, box.north)))


class _Counts:
    """Encounters, severe ones and units of distance by cell."""

    def __init__(self, limits: Limits):
        self.limits, self.cells = limits, limits.grid**2
        self.sums = np.zeros((3, self.cells if self.cells <= ARRAY else 0), np.int64)
        self.rest: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        severe = units / 1e4 < C.SEVERE_NM
        if self.sums.size:
            for to, weights in zip(self.sums, (None, severe, units), strict=True):
                to += np.bincount(ids, weights, self.cells).astype(np.int64)
            return
        found, at = np.unique(ids, return_inverse=True)
        self.rest.append((found, *(np.bincount(at, w, len(found)).astype(np.int64) for w in (None, severe, units))))

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call in more cells than an array holds."""
        for rows in self.rest:
            yield self._batch(*rows)
        self.rest = []

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.taken()
        ids = np.flatnonzero(self.sums[0])
        if len(ids):
            yield self._batch(ids, *(s[ids] for s in self.sums))

    def _batch(self, ids: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids // self.limits.grid, ids % self.limits.grid, *sums)], ["gx", "gy", "n", "severe", "units"])


class _Pairs:
    """Pairs of rows of ``ships`` (lon, lat, vx, vy), measured by the many."""

    def __init__(self, ships: np.ndarray, limits: Limits, counts: _Counts):
        self.ships, self.limits, self.counts = ships, limits, counts
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.n += len(i)
        if self.n >= MANY:
            self.measure()

    def measure(self) -> None:
        """In double precision, step by step as in ``interaction.pairs``."""
        if not self.n:
            return
        i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        m, a, b = self.limits, np.take(self.ships, i, 1), np.take(self.ships, j, 1)
        rx, ry, wx, wy = b - a
        rx *= m.kx
        ry *= C.M_PER_DEG
        ww = wx * wx + wy * wy
        t = np.where(ww > 1e-9, -(rx * wx + ry * wy) / ww, np.nan)
        px, py = rx + wx * t, ry + wy * t
        d0, dcpa, tcpa = np.sqrt(rx * rx + ry * ry) / C.M_PER_NM, np.sqrt(px * px + py * py) / C.M_PER_NM, t / 60.0
        hit = (tcpa > 0) & (tcpa <= m.lookahead_min) & (dcpa <= m.dcpa_nm) & (d0 <= m.coarse_nm) & ~(d0 < m.min_nm)
        gx, gy = (np.floor(p) for p in place(*(a[:2] + b[:2]) / 2, m.grid, m.box))
        inside = np.flatnonzero(hit & (gx >= 0) & (gx < m.grid) & (gy >= 0) & (gy < m.grid))
        if len(inside):
            self.counts.add((gx[inside] * m.grid + gy[inside]).astype(np.int64), half_up(dcpa[inside], 4).astype(np.int64))

    def each(self, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Rows ``first`` with all rows from ``begin`` up to ``end``."""
        counts = end - begin
        total = np.cumsum(counts)
        low = 0
        while low < len(first):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + MANY, "right")))
            n = counts[low:high]
            i, k = np.repeat(first[low:high], n), np.arange(n.sum())
            self.add(i, k + np.repeat(begin[low:high] - (np.cumsum(n) - n), n))
            low = high

    def near(self, start: int, own: int, end: int, among: bool) -> None:
        """Rows from ``start`` up to ``own`` with those from ``own`` up to ``end``, and with each other if ``among``.

        Single precision first, by matrix products, with limits so wide that its
        errors lose no pair: those that pass, few of which are no encounters,
        are measured.
        """
        m = self.limits
        lon, lat, vx, vy = self.ships[:, start:end]
        n = own - start
        order = np.concatenate([np.argsort(lat[:n]), n + np.argsort(lat[n:])])
        x, y = ((lon - (lon.min() + lon.max()) / 2) * m.kx)[order], ((lat - (lat.min() + lat.max()) / 2) * C.M_PER_DEG)[order]
        vx, vy = vx[order], vy[order]
        span, fast = np.max(np.abs(x) + np.abs(y)), np.max(np.abs(vx) + np.abs(vy))
        if not span * fast < 1e15:  # squares would leave the range of single precision
            rows = np.arange(start, own)
            return self.each(rows, rows + 1 if among else np.full(n, own), np.full(n, end))
        # the sum of the nine terms' roundings stays below this share of the largest product
        eps, far, late = 2.0**-17, m.coarse_nm * C.M_PER_NM * 1.000001, m.lookahead_min * 60.0 * 1.00001
        close2 = 1.01 * (m.dcpa_nm * C.M_PER_NM) ** 2
        e_dot, e_ww = span * fast * eps, fast * fast * eps
        approaching, near, soon, close = map(np.float32, (e_dot, far * far * 1.00001 + span * span * eps, e_dot + late * e_ww, close2 * e_ww + 101.0 * e_dot * e_dot))
        reach = far * 1.0001 + 1.0
        # r.w, r.r, -(r.w + late w.w), r x w and close2 w.w of two ships are sums of products of what each has
        one, no, dot, cross, rr, ww = np.ones_like(x), np.zeros_like(x), x * vx + y * vy, x * vy - y * vx, x * x + y * y, vx * vx + vy * vy
        theirs = np.stack([one, x, y, vx, vy, dot, cross, rr, ww]).astype(np.float32)
        r_w = np.stack([dot, -vx, -vy, -x, -y, one, no, no, no])
        r_r = np.stack([rr, -2 * x, -2 * y, no, no, no, no, one, no])
        w_w = np.stack([ww, no, no, -2 * vx, -2 * vy, no, no, no, one])
        r_x_w = np.stack([cross, -vy, vx, y, -x, no, one, no, no])
        ours = np.stack([f[:, :n].T for f in (r_w, r_r, -(r_w + late * w_w), r_x_w, close2 * w_w)], axis=1).astype(np.float32)
        height, width = 32, STEP // 32
        room, flags = np.empty(5 * STEP, np.float32), np.empty((2, STEP), bool)
        for inner in (True, False) if among else (False,):
            low, high = (0, n) if inner else (n, end - start)
            for s in range(0, n, height):
                e = min(n, s + height)
                left = s if inner else low + int(np.searchsorted(y[low:high], y[s] - reach))
                right = low + int(np.searchsorted(y[low:high], y[e - 1] + reach, "right"))
                for c in range(left, right, width):
                    d = min(right, c + width)
                    out = room[: 5 * (e - s) * (d - c)].reshape(5 * (e - s), d - c)
                    np.matmul(ours[s:e].reshape(-1, 9), theirs[:, c:d], out=out)
                    rw, r2, in_time, rxw, w2 = out.reshape(e - s, 5, d - c).transpose(1, 0, 2)
                    ok, also = (f[: (e - s) * (d - c)].reshape(e - s, d - c) for f in flags)
                    np.less_equal(rw, approaching, out=ok)
                    ok &= np.less_equal(r2, near, out=also)
                    ok &= np.less_equal(in_time, soon, out=also)
                    rxw *= rxw
                    rxw -= w2
                    ok &= np.less_equal(rxw, close, out=also)
                    found = np.flatnonzero(ok)
                    if len(found):
                        i, j = s + found // (d - c), c + found % (d - c)
                        if inner and c < e:
                            i, j = i[j > i], j[j > i]
                        self.add(start + order[i], start + order[j])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a key ends."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(rows, bool)
        for k in _KEY:
            values = table[k].to_numpy()
            last &= values == values[-1]
        begin = rows - int(last.sum())  # rows are in order, so the last key's are the last ones
        if begin:
            yield table.slice(0, begin)
        held, rows = table.slice(begin).to_batches(), rows - begin
        enough = max(ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _counter(limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(limits)
        with np.errstate(all="ignore"):
            for table in _whole_groups(batches):
                keys = [table[k].to_numpy() for k in _KEY]
                new = np.ones(table.num_rows, bool)
                new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
                start = np.flatnonzero(new)
                end = np.append(start[1:], table.num_rows)
                own = start + np.add.reduceat(table["looks"].to_numpy().astype(np.int64), start)
                among = keys[-1][start] == 0
                n, o = own - start, end - own
                todo = n * o + among * (n * (n - 1) // 2)
                pairs = _Pairs(np.stack([table[c].to_numpy() for c in ("lon", "lat", "vx", "vy")]), limits, counts)
                few = np.flatnonzero((todo > 0) & (todo < DENSE))
                size = n[few]
                first = np.arange(size.sum()) + np.repeat(start[few] - (np.cumsum(size) - size), size)
                pairs.each(first, np.where(np.repeat(among[few], size), first + 1, np.repeat(own[few], size)), np.repeat(end[few], size))
                for g in np.flatnonzero(todo >= DENSE):
                    pairs.near(int(start[g]), int(own[g]), int(end[g]), bool(among[g]))
                pairs.measure()
                yield from counts.taken()
            yield from counts.end()

    return run


def counted(reps: DataFrame, limits: Limits, block: int = BLOCK) -> DataFrame:
    """(gx, gy, n, severe, units): encounters of representatives by cell of their middle; ``units`` sums the closest distances in 1e-4 nm."""
    v = lambda f: F.col("speed") * C.KN_TO_MS * f(F.radians(F.col("course")))
    ships = reps.select("bucket", "mmsi", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), v(F.sin).alias("vx"), v(F.cos).alias("vy"), (F.col("longitude") * limits.kx).alias("x"), (F.col("latitude") * C.M_PER_DEG).alias("y"))
    # a value that is missing or not finite makes no encounter
    finite = [F.abs(c) < float("inf") for c in ("lon", "lat", "vx", "vy")]
    ships = ships.where(F.col("bucket").isNotNull() & F.col("mmsi").isNotNull() & reduce(and_, finite))
    found = dealt(ships, limits.coarse_nm * C.M_PER_NM * 1.000001, block).mapInArrow(_counter(limits), "gx long, gy long, n long, severe long, units long")
    return found.groupBy("gx", "gy").agg(*(F.sum(c).alias(c) for c in ("n", "severe", "units")))
