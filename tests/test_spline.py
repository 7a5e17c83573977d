"""Fitted tracks against one dense solve of the whole track."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.places import along, placed
from tidemark.operators import spline


def _b(knots, i, d, t):
    """The i-th B-spline of degree d, by its recursion."""
    if d == 0:
        return ((knots[i] <= t) & (t < knots[i + 1])).astype(float)
    out = np.zeros(len(t))
    if knots[i + d] > knots[i]:
        out += (t - knots[i]) / (knots[i + d] - knots[i]) * _b(knots, i, d - 1, t)
    if knots[i + d + 1] > knots[i + 1]:
        out += (knots[i + d + 1] - t) / (knots[i + d + 1] - knots[i + 1]) * _b(knots, i + 1, d - 1, t)
    return out


def dense(points, stiffness, evenly):
    t = np.r_[0, np.cumsum(np.hypot(*np.diff(points, axis=0).T))]
    d = min(3, len(t) - 1)
    knots = np.unique(np.r_[t[:: spline.PER_KNOT], t[-1]])
    full = np.r_[[knots[0]] * d, knots, [knots[-1]] * d]
    m = len(full) - d - 1
    design = lambda at: np.stack([_b(full, i, d, np.minimum(at, np.nextafter(t[-1], 0))) for i in range(m)], axis=1)
    a = design(t)
    bend = np.diff(np.eye(m), 2, axis=0)
    c = np.linalg.solve(a.T @ a + stiffness * bend.T @ bend, a.T @ points)
    return design(np.linspace(0, t[-1], len(t)) if evenly else t) @ c


def _track(rng, n):
    return np.cumsum(rng.normal([0.002, 0.001], 0.003, (n, 2)) * rng.choice([0.01, 1.0, 3.0], (n, 1)), axis=0) + [122.0, 30.0]


def _frame(spark, tracks):
    begin = datetime.datetime(2024, 6, 1)
    rows = [(m, begin + datetime.timedelta(seconds=k), float(x), float(y)) for m, p in tracks.items() for k, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "mmsi long, timestamp timestamp_ntz, longitude double, latitude double")


@pytest.mark.parametrize(("stiffness", "evenly"), [(1.0, True), (1.0, False), (300.0, True), (0.0, False)])
def test_pieces_are_one_dense_solve(spark, stiffness, evenly):
    rng = np.random.default_rng(3)
    tracks = {m: _track(rng, n) for m, n in ((1, 1300), (2, 1024), (3, 1025), (4, 3), (5, 4), (6, 5), (7, 9), (8, 64))}
    got = spline.spline_fitted(_frame(spark, tracks).repartition(6), stiffness, evenly, piece=256).toPandas()
    for m, p in tracks.items():
        mine = got[got.mmsi == m].sort_values("place")
        assert mine.place.tolist() == list(range(len(p)))
        assert np.abs(mine[["longitude", "latitude"]].to_numpy() - dense(p, stiffness, evenly)).max() < 1e-6


def test_awkward_tracks(spark):
    still = np.full((700, 2), 5.0)
    stops = np.r_[np.linspace([0.0, 0.0], [1.0, 1.0], 200), np.full((900, 2), 1.0), np.linspace([1.0, 1.0], [2.0, 1.0], 200)]
    frame = _frame(spark, {1: [(1.0, 2.0)], 2: [(1.0, 2.0), (3.0, 4.0)], 3: still, 4: stops, 5: [(1.0, 2.0), (3.0, float("nan"))]})
    frame = frame.withColumn("latitude", F.when(~F.isnan("latitude"), F.col("latitude")))
    for evenly in (True, False):
        got = spline.spline_fitted(frame, 1.0, evenly, piece=128).toPandas()
        assert got.groupby("mmsi").size().to_dict() == {1: 1, 2: 2, 3: 700, 4: 1300, 5: 1}
        assert not got.isna().any().any() and (got[got.mmsi == 3][["longitude", "latitude"]] == 5.0).all().all()
        assert got[got.mmsi == 4].longitude.between(-0.05, 2.05).all()
    assert spline.spline_fitted(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        spline.spline_fitted(frame, -1.0)


def test_places_and_sums_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 7919 % 5003).alias("v")).repartition(9).withColumn("g", F.when(F.col("g") == 1, F.col("g")))
    got = along(placed(rows, "g", "v"), "g", (F.col("v") - F.col("_before.v")).cast("double"), 64, "v").toPandas().fillna({"g": 0})
    for _, mine in got.groupby("g"):
        mine = mine.sort_values("v")
        assert mine._n.tolist() == list(range(len(mine))) and (mine._all == len(mine)).all()
        assert np.allclose(mine._t, mine.v - mine.v.iloc[0]) and np.allclose(mine._length, mine._t.iloc[-1])
