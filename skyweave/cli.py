"""Command line: python -m skyweave COMMAND ...

    info      [VARS:]FILES
    subset    VARS:FILES[:product=P] LIMITS -o OUT            x=[a,b],t=[2024-01],shape=WKT
    aggregate VARS:FILES[:kernel=K] GRID -o OUT               x=[a,b,step],y=[a,b,step]
    collapse  VARS:FILES[:kernel=K] DIMS -o OUT               x,y (a long-form grid)
    collocate VARS:FILES SAMPLES:METHOD[OPTIONS],kernel=K -o OUT    points.csv:box[h_sep=500km,t_sep=P1D], grid:bin, points.csv:lin
    eval      VARS:FILES [VARS:FILES ...] EXPRESSION UNITS -o [NAME:]OUT [-a k=v,...]
    stats     VAR:FILES [VAR:FILES]
    plot      VARS:FILES [VARS:FILES ...] --type KIND -o OUT                 the figure's tables, one folder each
    version

A variable may be given an alias, VAR=ALIAS; a colon in a name is written \\:. Longitude limits must increase and span 360 at most.
A folder with cells and axes is a grid. Samples: points by box (default), lin or nn (default lin, of a grid); grids by bin (default),
box, lin or nn.
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .dataset import Dataset, read_data_list
from .errors import EngineError, InvalidCommandLineOptionError
from .functions.names import coordinates, find_coordinate
from .functions.time import parse_datetime, parse_duration, to_days
from .functions.units import parse_length
from .operators import aggregate as ag
from .operators import evaluate as ev
from .operators import plotdata
from .operators import stats as st
from .operators.subset import require_rows, subset
from .sources import read, variables
from .sources.sinks import axes_of, save, save_grid

ALIASES = {"col": "collocate", "sub": "subset", "agg": "aggregate"}


def split_outside(text: str, sep: str) -> list[str]:
    """Split at `sep` outside brackets; a backslash keeps the next character."""
    out, depth, now, i = [], 0, "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] == sep:
            now, i = now + sep, i + 2
            continue
        depth += (c in "[(") - (c in "])")
        if depth < 0:
            raise InvalidCommandLineOptionError(f"unbalanced brackets: {text!r}")
        if c == sep and not depth:
            out, now = [*out, now], ""
        else:
            now += c
        i += 1
    if depth:
        raise InvalidCommandLineOptionError(f"unbalanced brackets: {text!r}")
    return [*out, now]


def parse_group(text: str) -> tuple[list[str], list[str] | None, list[str], dict[str, str]]:
    """VARS:FILES[:k=v,...] as variables, aliases (None if none is given), files, options."""
    parts = split_outside(text, ":")
    if len(parts) not in (2, 3):
        raise InvalidCommandLineOptionError(f"not VARS:FILES[:OPTIONS]: {text!r}")
    names = [v.partition("=") for v in split_outside(parts[0], ",")]
    return [n for n, _, _ in names], [a or n for n, _, a in names] if any(a for _, _, a in names) else None, split_outside(parts[1], ","), parse_options(parts[2]) if len(parts) == 3 else {}


def parse_options(text: str) -> dict[str, str]:
    out = {}
    for part in split_outside(text, ","):
        k, eq, v = part.partition("=")
        if not eq:
            raise InvalidCommandLineOptionError(f"not KEY=VALUE: {part!r}")
        out[k] = v
    return out


def parse_method(text: str) -> tuple[str, dict[str, str]]:
    """NAME[k=v,...]."""
    m = re.fullmatch(r"(\w+)(?:\[(.*)\])?", text)
    if not m:
        raise InvalidCommandLineOptionError(f"not NAME[OPTIONS]: {text!r}")
    return m[1], parse_options(m[2]) if m[2] else {}


def _bound(text: str, key: str):
    if text in ("", "None"):
        return None
    try:
        return float(text)
    except ValueError:
        return parse_datetime(text)


def parse_limits(text: str) -> dict:
    """x=[a,b],t=[2024-01],shape=POLYGON(...)."""
    out: dict = {}
    for k, v in parse_options(text).items():
        if k == "shape":
            out[k] = v
            continue
        m = re.fullmatch(r"\[(.*)\]", v)
        ends = [_bound(x, k) for x in m[1].split(",")] if m else []
        if len(ends) not in (1, 2):
            raise InvalidCommandLineOptionError(f"limits are [a] or [a,b]: {k}={v}")
        _check_longitude(k, ends)
        out[k] = tuple(ends)
    return out


def _check_longitude(key: str, ends: list) -> None:
    if key.lower() in ("x", "longitude", "lon") and len(ends) > 1 and None not in ends[:2] and not 0 <= ends[1] - ends[0] <= 360:
        raise InvalidCommandLineOptionError("longitude limits must increase and span 360 degrees at most")


def parse_grid(text: str) -> dict:
    """x=[a,b,step],t=[2024-01-01,2024-02-01,P1D]."""
    out = {}
    for k, v in parse_options(text).items():
        m = re.fullmatch(r"\[([^,]*),([^,]*),([^,]+)\]", v)
        if not m:
            raise InvalidCommandLineOptionError(f"a grid is [start,end,step]: {k}={v}")
        start, end = _bound(m[1], k), _bound(m[2], k)
        start, end = to_days(start.min()) if hasattr(start, "min") else start, to_days(end.max()) if hasattr(end, "max") else end
        step = parse_duration(m[3]).total_seconds() / 86400 if m[3].upper().startswith("P") else float(m[3])
        _check_longitude(k, [start, end])
        out[k] = (start, end, step)
    return out


def separations(options: dict[str, str]) -> dict[str, float]:
    """h_sep in km, a_sep in m (either with units), p_sep a ratio, t_sep a duration or days."""
    read_ = {"h_sep": lambda x: parse_length(x, "km"), "a_sep": lambda x: parse_length(x, "m"), "p_sep": float, "t_sep": lambda x: parse_duration(x).total_seconds() / 86400 if x.upper().startswith("P") else float(x)}
    return {k: f(options[k]) for k, f in read_.items() if k in options}


def _load(spark: SparkSession, text: str) -> tuple[DataFrame, list[str], dict]:
    names, aliases, files, options = parse_group(text)
    df = read(spark, files, names, aliases=aliases, product=options.get("product"))
    return df, [c for c in df.columns if c not in coordinates(df)], options


def _dataset(spark: SparkSession, text: str) -> Dataset:
    names, aliases, files, options = parse_group(text)
    return read_data_list(spark, files, names, product=options.get("product"), aliases=aliases)


def _samples(spark: SparkSession, files: str) -> Dataset:
    """The points, or the grid, of files; the variables in them are left aside."""
    paths = split_outside(files, ",")
    if len(paths) == 1 and axes_of(spark, paths[0]):
        return read_data_list(spark, paths, "*")
    from .sources.products import find_product

    df = find_product(spark, paths[0]).scan(spark, paths)
    return Dataset(df.select(*coordinates(df)), ())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"info": ["data"], "subset": ["data", "limits"], "aggregate": ["data", "grid"], "collapse": ["data", "dims"], "collocate": ["data", "samples"], "eval": ["data", "expression", "units"], "stats": ["data"], "plot": ["data"], "version": []}.items():
        s = sub.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name])
        for a in args:
            s.add_argument(a, nargs="+" if name in ("stats", "eval", "plot") and a == "data" else None)
        if name not in ("info", "stats", "version"):
            s.add_argument("-o", "--output", required=True)
        s.add_argument("--overwrite", action="store_true")
        if name == "plot":
            s.add_argument("--type", default="line")
        if name == "eval":
            s.add_argument("-a", "--attributes", default="")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    command = ALIASES.get(a.command, a.command)
    if command == "version":
        print(__version__)
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(command, a, spark)
    except (EngineError, ValueError) as x:
        print(f"{type(x).__name__}: {x}")
        return 1


def _plot(tables: dict[str, DataFrame], a: argparse.Namespace) -> int:
    for name, table in tables.items():
        save(table, f"{a.output}/{name}", overwrite=a.overwrite)
    return 0


def run(command: str, a: argparse.Namespace, spark: SparkSession) -> int:
    if command == "info":
        if ":" not in a.data.replace("://", ""):
            print("\n".join(variables(spark, a.data)))
            return 0
        df, names, _ = _load(spark, a.data)
        st.describe(df, names).show(truncate=False)
        return 0
    if command == "plot" and len(a.data) == 1:
        return _plot(_dataset(spark, a.data[0]).figure(a.type), a)
    if command in ("stats", "eval", "plot"):
        df, names, _ = _load(spark, a.data[0])
        for i, more in enumerate(a.data[1:], 2):
            other, found, _ = _load(spark, more)
            clash = {n: f"{n}_{i}" for n in found if n in names}
            df, names = ev.align(df, other.withColumnsRenamed(clash), coordinates(other)), names + [clash.get(n, n) for n in found]
    if command == "plot":
        return _plot(plotdata.figure(a.type, df, names), a)
    if command == "stats":
        if len(names) != 2:
            raise InvalidCommandLineOptionError("stats compares exactly two variables")
        for k, v in st.stats(df, *names).first().asDict().items():
            print(f"{k}: {v}")
        return 0
    output = a.output
    if command == "collocate":
        files, _, method = a.samples.rpartition(":")
        parts = split_outside(method, ",")
        how, opts = parse_method(parts[0]) if "=" not in parts[0].split("[")[0] else ("", {})
        more = parse_options(",".join(parts[bool(how) :])) if parts[bool(how) :] else {}
        data, sample = _dataset(spark, a.data), _samples(spark, files)
        keys = {k: v for k, v in opts.items() if k in ("extrapolate",)}
        options = separations(opts) | {k: v.lower() == "true" for k, v in keys.items()}
        if (kernel := more.get("kernel")) and data.gridded:
            raise InvalidCommandLineOptionError("interpolation takes no kernel")
        out = sample.sampled_from(data, how or None, kernel, **options)
        names = [v for v in sample.variables if v in out.df.columns and v not in out.variables]
        if out.gridded:
            save_grid(out.df.drop(*names), list(out.axes), output, overwrite=a.overwrite)
        else:
            save(out.df.drop("sample_id", *names), output, overwrite=a.overwrite)
        return 0
    files = parse_group(a.data)[2] if command in ("subset", "collapse") else []
    if len(files) == 1 and axes_of(spark, files[0]):
        data, options = _dataset(spark, a.data), parse_group(a.data)[3]
        if command == "subset":
            out = data.subset(**parse_limits(a.limits))
            require_rows(out.df)
        else:
            out = data.collapsed(*[find_coordinate(data.df, d) for d in a.dims.split(",")], how=options.get("kernel", "moments"))
        out.save_data(output, overwrite=a.overwrite)
        return 0
    if command != "eval":
        df, names, options = _load(spark, a.data)
    if command == "subset":
        out = require_rows(subset(df, **parse_limits(a.limits)))
    elif command == "aggregate":
        out = ag.aggregate(df, names, options.get("kernel", "moments"), parse_grid(a.grid), coords=coordinates(df))
    elif command == "collapse":
        dims = coordinates(df)
        out = ag.collapse(df, names, dims, [find_coordinate(df, d) for d in a.dims.split(",")], options.get("kernel", "moments"))
    else:
        name, _, path = output.rpartition(":") if not re.match(r"\w+://", output) else ("", "", output)
        output = path
        out = ev.evaluate(df, a.expression, name or "calculated_variable", units=a.units, attributes=parse_options(a.attributes) if a.attributes else None)
    save(out, output, overwrite=a.overwrite)
    return 0
