"""What users add: kernels, constraints, collocators and, by skyweave.sources.register, products.

* a kernel is a function of a variable's name that gives a list of aggregate Columns; in a collocation of points these may use the
  sample's coordinates as s_<name>. One that Columns cannot express is a `python_kernel`: it is called once a
  sample, or with batch=True once for a leaf of samples that lie together.
* a constraint is a function () -> boolean Column over s_<name> of the sample and <name> of the data.
* a collocator is a function (sample, data, variables, **options) -> DataFrame.

discover() imports the modules of a folder, whose decorators then register what they define.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame

from .errors import ClassNotFoundError
from .operators import collocate as co

KERNELS: dict[str, Callable[[str], list[Column]] | co.PythonKernel] = {}
CONSTRAINTS: dict[str, Callable[[], Column]] = {}
COLLOCATORS: dict[str, Callable[..., DataFrame]] = {}


def _adder(table: dict, name: str):
    def add(fn):
        table[name] = fn
        return fn

    return add


def kernel(name: str):
    """Register a kernel of Columns."""
    return _adder(KERNELS, name)


def python_kernel(name: str, suffixes: tuple[str, ...] = ("",), batch: bool = False):
    """Register fn(sample: dict, matches: pandas.DataFrame, variable) -> a value for each suffix, or one value; with batch
    fn(samples, data, near, variable) -> an array of a value a sample, or one for each suffix (see PythonKernel)."""

    def add(fn: Callable[..., object]):
        KERNELS[name] = co.PythonKernel(fn, suffixes, batch)
        return fn

    return add


def constraint(name: str):
    return _adder(CONSTRAINTS, name)


def collocator(name: str):
    return _adder(COLLOCATORS, name)


def find(table: dict, name: str):
    if name not in table:
        raise ClassNotFoundError(f"no {name!r}; known: {sorted(table)}")
    return table[name]


def discover(folder: str | None = None) -> list[str]:
    """Import every module of the folder, by default that in SKYWEAVE_PLUGIN_HOME, in order of name; their names."""
    home = folder or os.environ.get("SKYWEAVE_PLUGIN_HOME")
    out = []
    for p in sorted(Path(home).glob("*.py")) if home else ():
        spec = importlib.util.spec_from_file_location(f"skyweave_plugin_{p.stem}", p)
        spec.loader.exec_module(importlib.util.module_from_spec(spec))
        out.append(p.stem)
    return out


@collocator("box")
def _box(sample: DataFrame, data: DataFrame, variables: list[str], kernel: str = "moments", constraint: str | None = None, **options) -> DataFrame:
    return co.box(sample, data, variables, kernel, user_kernels=KERNELS, where=find(CONSTRAINTS, constraint)() if constraint else None, **options)


@collocator("dummy")
def _dummy(sample: DataFrame, data: DataFrame, variables: list[str], **options) -> DataFrame:
    """The data as they are."""
    return data


def collocate(sample: DataFrame, data: DataFrame, variables: list[str], how: str = "box", **options) -> DataFrame:
    """Run a registered collocator."""
    return find(COLLOCATORS, how)(sample, data, variables, **options)
