"""What parameters an analysis takes when they come from outside."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

#: Least and largest value of each parameter, both allowed, by operator. Fixed values of the public interface.
RANGES: dict[str, dict[str, tuple[float, float]]] = {
    "grid_density": {"grid": (1, 200)},
    "list_ships": {"limit": (1, 2000), "offset": (0, float("inf"))},
    "trajectory": {"limit": (1, 20_000)},
    "smoothed": {"window": (2, 31)},
    "sample_tracks": {"n_ships": (1, 200), "n_points": (1, 2000)},
    "snapshot": {"limit": (1, 20_000)},
    "corridors": {"grid": (10, 200), "ratio": (0, 1)},
    "od_matrix": {"grid": (5, 100), "top": (1, 100)},
    "simplified": {"tolerance": (0.0001, 0.05), "limit": (1, 50_000)},
    "Raster": {"bandwidth": (0.002, 0.2), "grid": (10, 200)},
    "peaks": {"top": (1, 100)},
    "encounters": {"dcpa_nm": (0.05, 5), "lookahead_min": (1, 120), "min_nm": (0, 1)},
    "most_urgent": {"limit": (1, 5000)},
    "conflict_hotspots": {"grid": (5, 200), "top": (1, 200)},
    "hotspots": {"grid": (5, 200), "top": (1, 200), "dcpa_nm": (0.05, 5), "lookahead_min": (1, 120), "min_nm": (0, 1)},
    "domain_pairs": {"scale": (0.1, 5)},
    "deepest": {"limit": (1, 5000)},
    "base": {"window_min": (0, 120)},
    "statistics": {"maneuver": (0, 60), "steady": (0, 10)},
    "by_type": {"maneuver": (0, 60)},
    "grid": {"cells": (2, 400), "maneuver": (0, 60)},
    "distribution": {"bins": (4, 100)},
    "sample": {"n": (10, 20_000)},
    "export_csv": {"limit": (1, 2_000_000)},
}


def in_range(operator: Callable) -> Callable:
    """The operator, refusing parameters outside their ranges with a ValueError; None (no limit) passes.

    Operators called directly take what makes sense to them: the ranges are for
    requests that come from outside, as in ``in_range(store.grid_density)``.
    """
    limits, signature = RANGES.get(operator.__name__, {}), inspect.signature(operator)

    @wraps(operator)
    def run(*args, **kwargs):
        given = signature.bind(*args, **kwargs).arguments
        for name, (low, high) in limits.items():
            value = given.get(name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} has to lie between {low} and {high}, not at {value}")
        return operator(*args, **kwargs)

    return run
