"""Arithmetic on variables with unit rules. A variable's unit is in its field's metadata under `units`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InconsistentDimensionsError


def unit_of(df: DataFrame, name: str) -> str:
    return (df.schema[name].metadata or {}).get("units", "1")


def with_units(df: DataFrame, name: str, units: str) -> DataFrame:
    return df.withMetadata(name, {**(df.schema[name].metadata or {}), "units": units})


def _put(df: DataFrame, out: str, c: Column, units: str) -> DataFrame:
    return df.withColumn(out, c).withMetadata(out, {"units": units})


def _join(a: str, b: str, op: str) -> str:
    if b == "1":
        return a
    if a == "1":
        return b if op == "*" else f"1/({b})"
    return f"({a}){op}({b})"


def _same(df: DataFrame, a: str, b: str) -> str:
    if unit_of(df, a) != unit_of(df, b):
        raise NotImplementedError(f"units differ: {unit_of(df, a)} and {unit_of(df, b)}")
    return unit_of(df, a)


def side_by_side(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Variables of two sources for arithmetic: the result has a's rows and no more, so `on` must be unique in b."""
    if not b.groupBy(*on).count().where("count > 1").isEmpty():
        raise InconsistentDimensionsError(f"several rows share {on}; the result would have more rows than its left side")
    return a.join(b, on, "left")


def add(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return _put(df, out, F.col(a) + F.col(b), _same(df, a, b))


def subtract(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return _put(df, out, F.col(a) - F.col(b), _same(df, a, b))


def multiply(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return _put(df, out, F.col(a) * F.col(b), _join(unit_of(df, a), unit_of(df, b), "*"))


def divide(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """A zero denominator gives NULL."""
    return _put(df, out, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), _join(unit_of(df, a), unit_of(df, b), "/"))


def exponentiate(df: DataFrame, a: str, n: float, out: str) -> DataFrame:
    u = unit_of(df, a)
    return _put(df, out, F.pow(a, F.lit(float(n))), u if u == "1" else f"({u})^{n:g}")


def absolute(df: DataFrame, a: str, out: str) -> DataFrame:
    return _put(df, out, F.abs(a), unit_of(df, a))


def exp(df: DataFrame, a: str, out: str) -> DataFrame:
    return _put(df, out, F.exp(a), "1")


def log(df: DataFrame, a: str, out: str, base: str = "e") -> DataFrame:
    f = {"e": F.ln, "2": F.log2, "10": F.log10}[base]
    u = unit_of(df, a)
    return _put(df, out, f(F.col(a)), "1" if u == "1" else f"{'ln' if base == 'e' else 'lb' if base == '2' else 'lg'}(re {u})")
