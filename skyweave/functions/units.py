"""A small table of units, and lengths with units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor and offset to the base unit of each kind.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "cm": ("length", 0.01, 0.0), "mm": ("length", 0.001, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 100.0, 0.0), "kPa": ("pressure", 1000.0, 0.0), "mb": ("pressure", 100.0, 0.0), "bar": ("pressure", 1e5, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "celsius": ("temperature", 1.0, 273.15),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 1e-3, 0.0), "mg": ("mass", 1e-6, 0.0), "ug": ("mass", 1e-9, 0.0),
    "1": ("number", 1.0, 0.0), "%": ("number", 0.01, 0.0), "degrees": ("angle", 1.0, 0.0), "radians": ("angle", 57.29577951308232, 0.0),
}


def convert(v: Column, old: str, new: str) -> Column:
    """v in another unit of its kind."""
    if old not in UNITS or new not in UNITS or UNITS[old][0] != UNITS[new][0]:
        raise ValueError(f"cannot convert {old!r} to {new!r}")
    (_, f, o), (_, g, p) = UNITS[old], UNITS[new]
    return (v * F.lit(f) + F.lit(o - p)) / F.lit(g)


def parse_length(text: str | float, unit: str) -> float:
    """`10km` or `1.0e3m` or a plain number, in `unit`."""
    m = re.fullmatch(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2] and UNITS.get(m[2], ("",))[0] != "length":
        raise ValueError(f"not a length: {text!r}")
    return float(m[1]) * UNITS[m[2] or unit][1] / UNITS[unit][1]
