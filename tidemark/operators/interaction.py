"""Encounters between ships: closest approach, rules of the road, ship domains, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.context import STUDY, Box
from tidemark.functions.geo import cell_centre, colregs, domain_radius_nm, epoch, heading_difference, relative_bearing
from tidemark.operators import meeting
from tidemark.sources.shared import cut


#: Ships on each side of a block of pairs.
BLOCK = 1024
#: Powers of two, in nautical miles, that cells may have where ships have a reach of their own: from about two metres to more than the globe.
LEVELS = (-10, 16)
_KNOWN = ("bucket", "mmsi", "longitude", "latitude", "speed", "course")


def representatives(reports: DataFrame, bucket_s: int = C.BUCKET_S) -> DataFrame:
    """Each ship's last report in each time bucket."""
    rows = reports.withColumn("bucket", F.floor(epoch() / bucket_s).cast("long"))
    last = Window.partitionBy("mmsi", "bucket").orderBy(F.desc("timestamp"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("bucket", "mmsi", "longitude", "latitude", "speed", "course")


def mean_latitude(reps: DataFrame) -> DataFrame:
    """(lat0): the plane's latitude, summed in whole micro-degrees so that the order of rows doesn't matter; 0 without rows."""
    return reps.agg(F.coalesce(F.sum(F.round(F.col("latitude") * 1_000_000).cast("long")) / F.count("*") / 1_000_000, F.lit(0.0)).alias("lat0"))


def _cells(rows: DataFrame, p: str, size: Column) -> DataFrame:
    return rows.withColumns({f"c{c}": F.floor(F.col(f"{p}_{c}") / size) for c in "xy"})


def meetings(own: DataFrame, other: DataFrame, block: int = BLOCK) -> DataFrame:
    """Own ships beside the others of the nine cells around theirs (same ``bucket`` and ``level``), in blocks of pairs numbered ``a``, ``b`` within a cell.

    Cells are counted first.  Where those who look into a cell and those who lie
    in it make more than ``block`` squared pairs, both are dealt by hash into
    parts of about ``block`` ships, and each two parts meet under a key of their
    own: a crowded anchorage is spread over tasks, however close its ships lie.
    """
    at = ["bucket", "level", "cx", "cy"]
    nine = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
    moved = lambda sign: [(F.col("cx") + sign * F.col("d.i")).alias("cx"), (F.col("cy") + sign * F.col("d.j")).alias("cy")]
    looking = own.groupBy(at).agg(F.count("*").alias("o")).select("bucket", "level", "cx", "cy", "o", nine).select("bucket", "level", *moved(1), "o").groupBy(at).agg(F.sum("o").alias("o"))
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    crowded = other.groupBy(at).agg(F.count("*").alias("n")).join(looking, at).where(F.col("n") * F.col("o") > block * block).select(*at, parts("o").alias("parts_own"), parts("n").alias("parts_other"))
    # crowded cells are one in many; written down, their size is known to the joins; those around learn of them before a ship is sent to its nine
    crowded = cut(crowded)
    told = crowded.select(*at, "parts_own", "parts_other", nine).select("bucket", "level", *moved(-1), F.struct("d", "parts_own", "parts_other").alias("p")).groupBy(at).agg(F.collect_list("p").alias("p"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    own = own.join(told, at, "left").select("*", nine).withColumn("p", F.get(F.filter("p", lambda p: p["d"] == F.col("d")), F.lit(0)))
    own = own.withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j"), "a": part("own_mmsi", F.col("p.parts_own"))}).select("*", every(F.col("p.parts_other")).alias("b")).drop("p", "d")
    other = other.join(crowded, at, "left").withColumn("b", part("target_mmsi", F.col("parts_other"))).select("*", every(F.col("parts_own")).alias("a")).drop("parts_own", "parts_other")
    return own.join(other, [*at, "a", "b"])


def pairs(reps: DataFrame, radius_nm: float | None, lat0: float | None = None, block: int = BLOCK, both: bool = False) -> DataFrame:
    """Pairs (own mmsi the smaller; either, if ``both``) in a bucket with distance, closest approach and bearings.

    The plane's latitude is the positions' mean, if none is given.

    With a radius, ships are laid in cells of that size and meet only those in
    the nine around them, so work follows the number of near pairs, and pairs
    farther apart are left out; without, all pairs of a bucket are returned.

    A column ``reach_nm`` of ``reps`` is each own ship's radius beside that;
    ships without a positive one are own in no pair.  Each looks into cells of
    the power of two next to its reach, so that one ship's long reach costs the
    others nothing; a ship lies in one cell of each size in use.  Other columns
    come along as the own ship's (``own_``).
    """
    reach = "reach_nm" in reps.columns
    power = F.least(F.greatest(F.ceil(F.log2("reach_nm")), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")
    mean = mean_latitude(reps) if lat0 is None else reps.sparkSession.range(1).select(F.lit(lat0).alias("lat0"))
    if reach:
        reps = reps.withColumn("level", F.when(F.col("reach_nm") > 0, power))
        mean = mean.join(F.broadcast(reps.agg(F.collect_set("level").alias("levels"))))  # a row of LEVELS' numbers at most
    kx, ky = C.M_PER_DEG * F.cos(F.radians("lat0")), F.lit(C.M_PER_DEG)
    v = lambda f: F.col("speed") * C.KN_TO_MS * f(F.radians(F.col("course")))
    more = ["level", "levels", "reach_nm"] if reach else []
    also = [c for c in reps.columns if c not in (*_KNOWN, *more)]
    x = reps.join(F.broadcast(mean)).select("bucket", "mmsi", "longitude", "latitude", "speed", "course", *more, *also, kx.alias("kx"), v(F.sin).alias("vx"), v(F.cos).alias("vy"), (F.col("longitude") * kx).alias("x"), (F.col("latitude") * ky).alias("y"))
    own, other = (x.select(*(F.col(c).alias(f"{p}_{c}") if c not in ("bucket", *more[:2]) else F.col(c) for c in x.columns)) for p in ("own", "target"))
    other = other.drop("target_reach_nm", "target_kx", *(f"target_{c}" for c in also))
    rx, ry = (F.col("target_longitude") - F.col("own_longitude")) * F.col("own_kx"), (F.col("target_latitude") - F.col("own_latitude")) * ky
    far = None if radius_nm is None else F.lit(radius_nm * C.M_PER_NM * 1.000001)
    if reach:
        size = F.pow(F.lit(2.0), F.col("level")) * C.M_PER_NM * 1.000001
        own = _cells(own.where("level IS NOT NULL"), "own", size).drop("levels")
        other = _cells(other.withColumn("level", F.explode("levels")), "target", size).drop("levels")
        p = meetings(own, other, block)
        own_far = F.col("own_reach_nm") * C.M_PER_NM * 1.000001
        far = own_far if far is None else F.least(own_far, far)
    elif far is not None:
        own, other = (_cells(r, p, far).withColumn("level", F.lit(0)) for r, p in ((own, "own"), (other, "target")))
        p = meetings(own, other, block)
    else:
        p = own.join(other, "bucket")
    p = p.where("own_mmsi <> target_mmsi" if both else "own_mmsi < target_mmsi")
    if far is not None:
        p = p.where(rx * rx + ry * ry <= far * far)
    # filters on what a generator makes stay above the join: pushed into it they would repeat all of this in its condition, more code than the JVM compiles
    p = p.select("*", F.inline(F.array(F.struct(rx.alias("rx"), ry.alias("ry"), (F.col("target_vx") - F.col("own_vx")).alias("wx"), (F.col("target_vy") - F.col("own_vy")).alias("wy")))))
    ww = F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy")
    p = p.withColumn("t", F.when(ww > 1e-9, -(F.col("rx") * F.col("wx") + F.col("ry") * F.col("wy")) / ww))
    size = lambda a, b: F.sqrt(a * a + b * b) / C.M_PER_NM
    return p.select(
        "bucket", "own_mmsi", "target_mmsi", "own_longitude", "own_latitude", "target_longitude", "target_latitude", "own_speed", "target_speed",
        size(F.col("rx"), F.col("ry")).alias("d0_nm"),
        size(F.col("rx") + F.col("wx") * F.col("t"), F.col("ry") + F.col("wy") * F.col("t")).alias("dcpa_nm"),
        (F.col("t") / 60.0).alias("tcpa_min"),
        relative_bearing(F.col("rx"), F.col("ry"), F.col("own_course")).alias("bearing"),
        relative_bearing(-F.col("rx"), -F.col("ry"), F.col("target_course")).alias("bearing_back"),
        heading_difference(F.col("own_course"), F.col("target_course")).alias("heading_diff"), *(f"own_{c}" for c in also),
    )


def encounters(reports: DataFrame, dcpa_nm: float = C.DCPA_NM, lookahead_min: float = C.LOOKAHEAD_MIN, coarse_nm: float = C.COARSE_NM, min_nm: float = C.MIN_NM) -> DataFrame:
    """Pairs that come too close soon, with their situation; ``degenerate`` ones overlap already."""
    hits = pairs(cut(representatives(reports)), coarse_nm).where((F.col("tcpa_min") > 0) & (F.col("tcpa_min") <= lookahead_min) & (F.col("dcpa_nm") <= dcpa_nm) & (F.col("d0_nm") <= coarse_nm))
    situation, duty = colregs(F.col("bearing"), F.col("heading_diff"), F.col("own_speed"), F.col("target_speed"))
    return hits.select(
        "bucket", "own_mmsi", "target_mmsi", "d0_nm", "dcpa_nm", "tcpa_min", "bearing", "heading_diff",
        ((F.col("own_longitude") + F.col("target_longitude")) / 2).alias("longitude"), ((F.col("own_latitude") + F.col("target_latitude")) / 2).alias("latitude"),
        situation.alias("situation"), duty.alias("responsibility"), (F.col("dcpa_nm") + F.col("tcpa_min") / 60).alias("risk"), (F.col("d0_nm") < min_nm).alias("degenerate"),
    )


def most_urgent(found: DataFrame, limit: int = 500) -> DataFrame:
    return found.where("NOT degenerate").orderBy("risk", "bucket", "own_mmsi", "target_mmsi").limit(limit)


def situations(found: DataFrame) -> DataFrame:
    return found.where("NOT degenerate").groupBy("situation").agg(F.count("*").alias("n"))


def conflict_hotspots(found: DataFrame, grid: int = 40, top: int = 30, box: Box = STUDY) -> DataFrame:
    """Cells by number of encounters; positions outside are left out."""
    gx, gy = map(F.floor, meeting.place(F.col("longitude"), F.col("latitude"), grid, box))
    rows = found.where("NOT degenerate").select(gx.alias("gx"), gy.alias("gy"), (meeting.half_up(F.col("dcpa_nm"), 4) / 1e4).alias("dcpa")).where(F.col("gx").between(0, grid - 1) & F.col("gy").between(0, grid - 1))
    return _busiest(rows.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count_if(F.col("dcpa") < C.SEVERE_NM).alias("severe"), F.avg("dcpa").alias("mean_dcpa")), grid, top, box)


def _busiest(cells: DataFrame, grid: int, top: int, box: Box) -> DataFrame:
    sx, sy = (box.east - box.west) / grid, (box.north - box.south) / grid
    return cells.orderBy(F.desc("n"), "gx", "gy").limit(top).withColumns({"longitude": cell_centre(F.col("gx"), box.west, sx), "latitude": cell_centre(F.col("gy"), box.south, sy)})


def hotspots(reports: DataFrame, grid: int = 40, top: int = 30, box: Box = STUDY, dcpa_nm: float = C.DCPA_NM, lookahead_min: float = C.LOOKAHEAD_MIN, coarse_nm: float = C.COARSE_NM, min_nm: float = C.MIN_NM, block: int = meeting.BLOCK) -> DataFrame:
    """``conflict_hotspots`` of the reports' ``encounters``, each counted where its ships meet; a row of each would be more than the counting costs."""
    reps = cut(representatives(reports))
    kx = mean_latitude(reps).select(C.M_PER_DEG * F.cos(F.radians("lat0"))).first()[0]
    cells = meeting.counted(reps, meeting.Limits(kx, dcpa_nm, lookahead_min, coarse_nm, min_nm, grid, box), block)
    return _busiest(cells.select("gx", "gy", "n", "severe", (F.col("units") / 1e4 / F.col("n")).alias("mean_dcpa")), grid, top, box)


def domain_pairs(reports: DataFrame, ships: DataFrame, model: str = "fujii", scale: float = 1.0, radius_nm: float | None = None, symmetric: bool = False) -> DataFrame:
    """Pairs in which the target is inside the own ship's domain; own is the smaller mmsi, or either if ``symmetric``.

    Each ship looks as far as its own domain can reach (and ``radius_nm``, if given).
    """
    reps = representatives(reports).join(ships.groupBy("mmsi").agg(F.max("length").alias("length")), "mmsi", "left")
    ahead = F.coalesce("length", F.lit(0.0)) * C.FUJII_A / C.M_PER_NM if model == "fujii" else F.when(F.col("length") > 0, C.GOODWIN_AHEAD)
    reps = cut(reps.select("bucket", "mmsi", "longitude", "latitude", "speed", "course", (ahead * scale).alias("reach_nm"), F.coalesce("length", F.lit(0.0)).alias("length")))
    p = pairs(reps, radius_nm, both=symmetric)
    r = domain_radius_nm(model, F.col("bearing"), F.col("own_length")) * scale
    d = F.col("d0_nm")
    inside: Column = (d > 0) & (d <= F.col("radius_nm")) & (F.col("own_length") > 0)
    return p.withColumn("radius_nm", r).where(inside).select(
        "bucket", "own_mmsi", "target_mmsi", "d0_nm", "bearing", "radius_nm", (1 - d / F.col("radius_nm")).alias("penetration"),
        (d * F.cos(F.radians("bearing"))).alias("along_nm"), (d * F.sin(F.radians("bearing"))).alias("cross_nm"), (d < C.OVERLAP_NM).alias("overlap"),
    )


def deepest(found: DataFrame, limit: int = 500) -> DataFrame:
    return found.orderBy(F.desc("penetration"), "bucket", "own_mmsi", "target_mmsi").limit(limit)


def most_violated(found: DataFrame, top: int = 10) -> DataFrame:
    return found.groupBy("own_mmsi").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "own_mmsi").limit(top)


def headway(found: DataFrame) -> DataFrame:
    """Violations by distance ahead or astern, the last bin open; empty bins count 0."""
    a, bin_ = F.abs("along_nm"), F.lit(0)
    for k, edge in enumerate(C.HEADWAY_EDGES_NM):
        bin_ = F.when(a >= edge, k).otherwise(bin_)
    counts = found.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = found.sparkSession.range(len(C.HEADWAY_EDGES_NM)).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def domain_summary(found: DataFrame) -> DataFrame:
    """Violations, ships concerned, the deepest penetration, and pairs so close that they overlap."""
    return found.agg(F.count("*").alias("violations"), F.count_distinct("own_mmsi").alias("ships"), F.max("penetration").alias("worst"), F.count_if("overlap").alias("overlaps"))
