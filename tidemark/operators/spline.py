"""Penalised least-squares B-splines along whole tracks, solved in overlapping pieces.

The curve's parameter is the length sailed.  A knot stands at every
``PER_KNOT``-th report, so there are reports between any two knots however
unevenly a ship moves, and the pull of a report on the curve dies away within
some knots.  A piece of a track is therefore solved with a margin of reports on
either side, and what it says of its own stretch is what one solve of the whole
track would say.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.places import along, placed

#: Reports from knot to knot.
PER_KNOT = 4
#: Reports of a piece.
PIECE = 4096


def margin(stiffness: float) -> int:
    """Reports on either side of a piece: forty times the length over which a pull dies away, in knots."""
    return PER_KNOT * math.ceil(40 * max(1.0, (stiffness / PER_KNOT) ** 0.25))


def basis(knots: np.ndarray, degree: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the ``degree + 1`` B-splines that aren't zero at each t, and their values; ``knots`` rise, and the outer ones are repeated."""
    spans = np.clip(np.searchsorted(knots, t, "right") - 1, 0, len(knots) - 2)
    full = np.r_[[knots[0]] * degree, knots, [knots[-1]] * degree]
    at = spans + degree
    values = np.ones((len(t), 1))
    for d in range(1, degree + 1):
        new = np.zeros((len(t), d + 1))
        for k in range(d):
            low, high = full[at + k + 1 - d], full[at + k + 1]
            part = values[:, k] / (high - low)
            new[:, k] += part * (high - t)
            new[:, k + 1] += part * (t - low)
        values = new
    return spans, values


def solve_banded(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric positive definite system; ``bands[k, j]`` is the entry (j + k, j), which is overwritten."""
    width, n = bands.shape
    out = right.copy()
    for j in range(n):
        reach = min(width, n - j)
        column = bands[1:reach, j] / bands[0, j]
        for k in range(1, reach):
            bands[: reach - k, j + k] -= column[k - 1] * bands[k:reach, j]
            out[j + k] -= column[k - 1] * out[j]
    for j in range(n - 1, -1, -1):
        reach = min(width, n - j)
        out[j] = (out[j] - bands[1:reach, j] @ out[j + 1 : j + reach]) / bands[0, j]
    return out


def fitted(t: np.ndarray, points: np.ndarray, knots: np.ndarray, stiffness: float, at: np.ndarray) -> np.ndarray:
    """The curve of least squared distances plus ``stiffness`` times the squared second differences of its coefficients, taken at ``at``."""
    degree = min(3, len(t) - 1)
    m = len(knots) - 1 + degree
    first, values = basis(knots, degree, t)
    bands, right = np.zeros((max(degree, 2) + 1, m)), np.zeros((m, points.shape[1]))
    for a in range(degree + 1):
        np.add.at(right, first + a, values[:, a, None] * points)
        for b in range(a, degree + 1):
            np.add.at(bands[b - a], first + a, values[:, a] * values[:, b])
    for a, x in enumerate((1.0, -2.0, 1.0)):
        for b, y in list(enumerate((1.0, -2.0, 1.0)))[a:]:
            bands[b - a, a : a + max(0, m - 2)] += stiffness * x * y
    bands[0] += 1e-12 * bands[0].max()  # a coefficient that nothing holds stays finite
    coefficients = solve_banded(bands, right)
    first, values = basis(knots, degree, at)
    return sum(values[:, a, None] * coefficients[first + a] for a in range(degree + 1))


def _piece(stiffness: float, evenly: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n", kind="stable")
        own = rows[rows["_for"] == rows["_piece"]]
        mmsi, all_, length = own["mmsi"].iloc[0], int(own["_all"].iloc[0]), float(own["_length"].iloc[0])
        t, points = rows["_t"].to_numpy(), rows[["longitude", "latitude"]].to_numpy()
        if evenly and length > 0:
            # the places from the piece's first report up to the next piece's
            low, last = own["_t"].iloc[0], int(own["_n"].iloc[-1]) + 1 == all_
            high = t[int((rows["_n"] <= own["_n"].iloc[-1]).sum()) - (1 if last else 0)]
            place = np.arange(max(0, math.floor(low / length * (all_ - 1)) - 1), min(all_ - 1, math.ceil(high / length * (all_ - 1)) + 1) + 1)
            at = place * (length / (all_ - 1))
            inside = (at >= low) & ((at < high) | last)
            place, at = place[inside], at[inside]
            at = np.minimum(at, t[-1])
        else:
            place, at = own["_n"].to_numpy(), own["_t"].to_numpy()
        knots = np.unique(np.r_[t[rows["_n"] % PER_KNOT == 0], t[0], t[-1]])
        if len(t) < 3 or len(knots) < 2:  # nothing to smooth, or a ship that lies still
            known = own.set_index("_n")[["longitude", "latitude"]]
            found = known.reindex(place).to_numpy() if length == 0 or len(t) < 3 else np.repeat(points.mean(axis=0)[None], len(place), axis=0)
        else:
            found = fitted(t, points, knots, stiffness, at)
        return pd.DataFrame({"mmsi": mmsi, "place": place, "longitude": found[:, 0], "latitude": found[:, 1]})

    return run


def spline_fitted(reports: DataFrame, stiffness: float = 1.0, evenly: bool = True, piece: int = PIECE) -> DataFrame:
    """(mmsi, place, longitude, latitude): each track on its fitted curve, as many points as it has reports.

    ``evenly`` takes the curve at equal distances along the track, as the
    published smoother does; otherwise at the reports' own distances, and
    ``place`` is then the report's.  Reports without a position play no part.
    Tracks of one or two reports, and ships that never move, stay as they are;
    three reports make a parabola.  Reports of one time come by longitude and
    latitude.  No piece has more than ``piece`` reports and two margins,
    however long a track is.
    """
    if stiffness < 0 or piece < PER_KNOT or piece % PER_KNOT:
        raise ValueError("the stiffness is no less than zero, and a piece is a multiple of the reports from knot to knot")
    rows = reports.where("longitude IS NOT NULL AND latitude IS NOT NULL").select("mmsi", "timestamp", F.col("longitude").cast("double"), F.col("latitude").cast("double"))
    x, y = F.col("longitude") - F.col("_before.longitude"), F.col("latitude") - F.col("_before.latitude")
    track = along(placed(rows, "mmsi", "timestamp", "longitude", "latitude"), "mmsi", F.sqrt(x * x + y * y), piece, "longitude", "latitude")
    # a report goes to its own piece and to those that it is in the margin of
    side = margin(stiffness)
    reach = F.ceil(F.lit(side) / F.lit(piece)).cast("long")
    near = F.filter(
        F.sequence(F.col("_piece") - reach, F.col("_piece") + reach),
        lambda p: (p >= 0) & (p * piece < F.col("_all")) & (F.col("_n") >= p * piece - side) & (F.col("_n") < (p + 1) * piece + side),
    )
    dealt = track.select("mmsi", "_n", "_all", "_t", "_length", "_piece", "longitude", "latitude", F.explode(near).alias("_for"))
    return dealt.groupBy("mmsi", "_for").applyInPandas(_piece(stiffness, evenly), "mmsi long, place long, longitude double, latitude double")
