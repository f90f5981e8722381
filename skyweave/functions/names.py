"""Coordinates and their names."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame

from ..errors import CoordinateNotFoundError, DuplicateCoordinateError, InvalidVariableError

#: The standard coordinates in canonical order, and their axis letters.
STANDARD = ("latitude", "longitude", "altitude", "air_pressure", "time")
AXES = {"x": "longitude", "y": "latitude", "z": "altitude", "t": "time", "p": "air_pressure"}
#: Prefixes of variable names that tell a coordinate.
PREFIXES = {"lat": "latitude", "lon": "longitude", "alt": "altitude", "height": "altitude", "pres": "air_pressure", "air_pressure": "air_pressure", "time": "time"}


def guess_standard_name(name: str) -> str | None:
    return next((s for p, s in PREFIXES.items() if name.lower().startswith(p)), None)


def find_coordinate(df: DataFrame, key: str) -> str:
    """The column that a user's key means: its name, a standard name in the field's metadata, an axis letter, or a guessed name."""
    fields = {f.name: f.metadata or {} for f in df.schema.fields}
    if key in fields:
        return key
    target = AXES.get(key.lower(), key)
    for found in (
        [n for n, m in fields.items() if m.get("standard_name") == target],
        [n for n in fields if n == target],
        [n for n, m in fields.items() if str(m.get("axis", "")).lower() == key.lower()],
        [n for n in fields if guess_standard_name(n) == target],
    ):
        if len(found) > 1:
            raise DuplicateCoordinateError(f"{key!r} means any of {found}")
        if found:
            return found[0]
    raise CoordinateNotFoundError(f"no coordinate {key!r} among {list(fields)}")


def coordinates(df: DataFrame) -> list[str]:
    """Standard coordinates that df has, in canonical order."""
    return [c for c in STANDARD if c in df.columns]


def select_variables(df: DataFrame, patterns: list[str], aliases: list[str] | None = None) -> DataFrame:
    """Coordinates and the variables that match the patterns (wildcards allowed), renamed if aliases are given."""
    coords, found = coordinates(df), []
    for p in patterns:
        hit = [c for c in df.columns if c not in coords and fnmatch.fnmatchcase(c, p)]
        if not hit:
            raise InvalidVariableError(f"no variable matches {p!r}")
        found += [c for c in hit if c not in found]
    if aliases is not None and len(aliases) != len(found):
        raise ValueError("as many aliases as variables are needed")
    return df.select(*coords, *[df[c].alias(a) for c, a in zip(found, aliases or found)])
