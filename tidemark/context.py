"""What part of the reports a query looks at: box, time window, ship types."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C


def parse_time(value: str | datetime | None, strict: bool = True) -> datetime | None:
    """A naive UTC time from ISO text (a zone is dropped, not converted; fractions too).

    Text that is no time raises, or counts as no bound if not ``strict``.
    """
    if value is None or isinstance(value, datetime):
        return value
    try:
        return datetime.fromisoformat(value.replace("Z", "")).replace(tzinfo=None, microsecond=0)
    except ValueError:
        if strict:
            raise
        return None


@dataclass(frozen=True)
class Box:
    west: float
    south: float
    east: float
    north: float

    def contains(self, lon: Column | str = "longitude", lat: Column | str = "latitude") -> Column:
        lon, lat = (F.col(x) if isinstance(x, str) else x for x in (lon, lat))
        return lon.between(self.west, self.east) & lat.between(self.south, self.north)

    @staticmethod
    def of(west=None, south=None, east=None, north=None) -> Box | None:
        """A box, or none unless all four sides are given."""
        sides = (west, south, east, north)
        return None if None in sides else Box(*sides)

    @staticmethod
    def filled(west=None, south=None, east=None, north=None) -> Box:
        """A box whose missing sides are the study area's."""
        own = (STUDY.west, STUDY.south, STUDY.east, STUDY.north)
        return Box(*(b if a is None else a for a, b in zip((west, south, east, north), own, strict=True)))


STUDY = Box(C.WEST, C.SOUTH, C.EAST, C.NORTH)


@dataclass(frozen=True)
class Query:
    """Filters that any analysis takes; what isn't given doesn't filter."""

    box: Box | None = None
    start: str | datetime | None = None
    end: str | datetime | None = None
    ship_types: tuple[str, ...] | None = None
    strict: bool = True

    def apply(self, reports: DataFrame, box: bool = True) -> DataFrame:
        """The reports inside, both ends of the window included; plain comparisons, so they reach the scan."""
        if box and self.box:
            reports = reports.where(self.box.contains())
        for bound, below in ((self.start, False), (self.end, True)):
            at = parse_time(bound, self.strict)
            if at is not None:
                lit = F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
                reports = reports.where(F.col("timestamp") <= lit if below else F.col("timestamp") >= lit)
        if self.ship_types:
            reports = reports.where(F.coalesce("ship_type", F.lit(C.OTHER_TYPE)).isin(*self.ship_types))
        return reports


def effective_box(drawn: Box | None, viewport: Box | None) -> Box:
    """A drawn box before the viewport before the study area."""
    return drawn or viewport or STUDY
