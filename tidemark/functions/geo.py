"""Geometry and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C


def epoch(ts: Column | str = "timestamp") -> Column:
    """Whole seconds since 1970 of a naive time, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def wrap_deg(d: Column) -> Column:
    """An angle's difference in [-180, 180)."""
    return ((d + 540.0) % 360.0) - 180.0


def _turned(d: Column) -> Column:
    """An angle in [0, 360).  A turn is always added, so all angles are rounded alike: ``pmod`` adds one to negative angles only, and ties such as 22.5 degrees fall otherwise."""
    return (d % 360.0 + 360.0) % 360.0


def heading_difference(a: Column, b: Column) -> Column:
    """Between two courses, 0 to 180."""
    return F.abs(_turned(b - a + 180.0) - 180.0)


def relative_bearing(dx: Column, dy: Column, course: Column) -> Column:
    """Clockwise from the bow, [0, 360)."""
    return _turned(F.degrees(F.atan2(dx, dy)) - course)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)
    return 2 * C.EARTH_KM * F.asin(F.sqrt(h))


def cell(x: Column, low: float, size: float) -> Column:
    """Number of a regular grid's cell."""
    return F.floor((x - low) / size)


def cell_centre(g: Column, low: float, size: float) -> Column:
    return low + (g + 0.5) * size


def crossing_sign(x1: Column, y1: Column, x2: Column, y2: Column, barrier) -> Column:
    """1 or -1 where the segment meets the barrier (ends included), by side of approach; 0 elsewhere and if parallel."""
    (ax, ay), (bx, by) = barrier
    dx, dy, ex, ey = x2 - x1, y2 - y1, F.lit(bx - ax), F.lit(by - ay)
    d = dx * ey - dy * ex
    t = F.try_divide((F.lit(ax) - x1) * ey - (F.lit(ay) - y1) * ex, d)
    u = F.try_divide((F.lit(ax) - x1) * dy - (F.lit(ay) - y1) * dx, d)
    meets = (F.abs(d) >= 1e-15) & t.between(0.0, 1.0) & u.between(0.0, 1.0)
    return F.when(meets, F.when(d > 0, 1).otherwise(-1)).otherwise(0)


def domain_radius_nm(model: str, bearing: Column, length_m: Column) -> Column:
    """A ship domain's radius towards a relative bearing."""
    if model == "fujii":
        a, b, th = C.FUJII_A * length_m, C.FUJII_B * length_m, F.radians(bearing)
        return F.try_divide(a * b, F.sqrt(F.pow(b * F.cos(th), 2.0) + F.pow(a * F.sin(th), 2.0))) / C.M_PER_NM
    if model == "goodwin":
        ahead = (bearing <= 60.0) | (bearing >= 300.0)
        return F.when(ahead, C.GOODWIN_AHEAD).when(bearing < 180.0, C.GOODWIN_STARBOARD).otherwise(C.GOODWIN_PORT)
    raise ValueError(f"no such ship domain: {model}")


def colregs(bearing: Column, difference: Column, own_kn: Column, target_kn: Column) -> tuple[Column, Column]:
    """(situation, responsibility) of an encounter seen from the own ship; overtaking before head-on before crossing."""
    overtaking, head_on = difference < C.TOLERANCE_DEG, difference > 180.0 - C.BEAM_BACK_DEG
    ahead = (bearing <= C.FORWARD_DEG) | (bearing >= 360.0 - C.FORWARD_DEG)
    astern = bearing.between(C.OVERTAKE_DEG, 360.0 - C.OVERTAKE_DEG)
    right, left = (bearing > 0.0) & (bearing < 180.0), (bearing > 180.0) & (bearing < 360.0)
    situation = F.when(overtaking, "overtaking").when(head_on, "head-on").when(right | left, "crossing").otherwise("other")
    by_speed = F.when(own_kn > target_kn, "give way").otherwise("stand on")
    duty = F.when(overtaking, F.when(ahead, "give way").when(astern, "stand on").otherwise(by_speed)).when(head_on, "both give way").when(right, "give way").when(left, "stand on").otherwise("unclear")
    return situation, duty


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar ones as temporary SQL functions."""
    for sql in (
        "wrap_deg(d DOUBLE) RETURNS DOUBLE RETURN ((d + 540D) % 360D) - 180D",
        "heading_difference(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN abs(((b - a + 180D) % 360D + 360D) % 360D - 180D)",
        "relative_bearing(dx DOUBLE, dy DOUBLE, course DOUBLE) RETURNS DOUBLE RETURN ((degrees(atan2(dx, dy)) - course) % 360D + 360D) % 360D",
        f"haversine_km(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE RETURN {2 * C.EARTH_KM}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))",
        f"domain_radius_fujii(bearing DOUBLE, length_m DOUBLE) RETURNS DOUBLE RETURN try_divide({C.FUJII_A * C.FUJII_B}D * length_m * length_m, sqrt(pow({C.FUJII_B}D * length_m * cos(radians(bearing)), 2) + pow({C.FUJII_A}D * length_m * sin(radians(bearing)), 2))) / {C.M_PER_NM}D",
        f"domain_radius_goodwin(bearing DOUBLE, length_m DOUBLE) RETURNS DOUBLE RETURN CASE WHEN bearing <= 60D OR bearing >= 300D THEN {C.GOODWIN_AHEAD}D WHEN bearing < 180D THEN {C.GOODWIN_STARBOARD}D ELSE {C.GOODWIN_PORT}D END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
