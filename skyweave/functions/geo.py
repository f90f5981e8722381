"""Horizontal and vertical geometry as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres.
EARTH_RADIUS = 6378.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km of points in degrees."""
    s = F.sin(F.radians(lat2 - lat1) / 2)
    t = F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def wrap_longitude(lon: Column, start: float) -> Column:
    """Longitude in [start, start + 360)."""
    return F.pmod(lon - F.lit(float(start)), F.lit(360.0)) + F.lit(float(start))


def wrap_start(least: float | None) -> float:
    """Where the range of longitudes begins: at -180 if any is negative, else at 0."""
    return -180.0 if least is not None and least < 0 else 0.0


def pressure_ratio(a: Column, b: Column) -> Column:
    return F.greatest(F.try_divide(a, b), F.try_divide(b, a))


def parse_polygon(wkt: str) -> list[list[tuple[float, float]]]:
    """The rings (x, y) of POLYGON or MULTIPOLYGON text; holes are rings too, as containment counts crossings of all."""
    if not re.match(r"\s*(MULTI)?POLYGON\s*\(", wkt, re.I):
        raise ValueError(f"not a polygon: {wkt[:40]}")
    rings = [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]
    if not rings or any(len(r) < 4 or r[0] != r[-1] for r in rings):
        raise ValueError("a ring must be closed and have four points at least")
    return rings


def polygon_box(rings: list) -> tuple[float, float, float, float]:
    xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
    return min(xs), min(ys), max(xs), max(ys)


def polygon_contains(rings: list, x: Column, y: Column) -> Column:
    """Strictly inside: an odd number of edges crossed to the right, and on no edge."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            within = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
            on_edge = on_edge | ((cross == 0) & within)
            if y1 != y2:
                at = F.lit(x1) + (y - y1) * F.lit((x2 - x1) / (y2 - y1))
                crossings = crossings + (((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < at)).cast("int"))
    return (crossings % 2 == 1) & ~on_edge


def antipode(lat: Column, lon: Column) -> tuple[Column, Column]:
    return -lat, wrap_longitude(lon + 180, -180.0)


def separation(kind: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How far apart two points are: h (km), a or t (absolute difference) or p (ratio, 1 or more). a, b: coordinates by name."""
    return {
        "h": lambda: haversine(a["latitude"], a["longitude"], b["latitude"], b["longitude"]),
        "a": lambda: F.abs(a["altitude"] - b["altitude"]),
        "t": lambda: F.abs(a["time"] - b["time"]),
        "p": lambda: pressure_ratio(a["air_pressure"], b["air_pressure"]),
    }[kind]()


def nearer(kind: str, to: dict[str, Column], p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Whether p is nearer to a point than q is."""
    return separation(kind, to, p) < separation(kind, to, q)


def same_place(a: dict[str, Column], b: dict[str, Column], names: tuple[str, ...] = ("latitude", "longitude", "altitude", "air_pressure")) -> Column:
    """Whether two points have equal coordinates, missing ones alike."""
    out = F.lit(True)
    for n in names:
        if n in a and n in b:
            out = out & a[n].eqNullSafe(b[n])
    return out
