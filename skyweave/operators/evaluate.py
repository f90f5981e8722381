"""Expressions over variables, compiled from Python syntax to Columns; text is parsed and never executed."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EvaluationError


def _safe(c: Column) -> Column:
    """NaN and infinite results as NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _floordiv(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


def _mod(a: Column, b: Column) -> Column:
    """The sign of Python's modulo follows the divisor."""
    return a - b * F.floor(F.try_divide(a, b))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The logarithm of zero is minus infinity, as in numpy; of less it is NULL."""
    return lambda a: F.when(a == 0, F.lit(float("-inf"))).otherwise(f(a))


def _both(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """NULL if either is NULL, as least and greatest skip NULL."""
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.Pow: lambda a, b: _safe(F.pow(a, b)), ast.FloorDiv: _floordiv, ast.Mod: _mod, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b,
}
COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
BUILTIN = {"abs": F.abs, "round": lambda a, n=None: F.bround(a, n if n is not None else 0), "int": lambda a: a.cast("long"), "float": lambda a: a.cast("double"), "bool": lambda a: a != 0, "pow": lambda a, b: _safe(F.pow(a, b))}
NUMPY = {
    "log": _log(F.ln), "log10": _log(F.log10), "log2": _log(F.log2), "exp": lambda a: _safe(F.exp(a)), "sqrt": lambda a: _safe(F.sqrt(a)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": lambda a: _safe(F.asin(a)), "arccos": lambda a: _safe(F.acos(a)), "arctan": F.atan,
    "arctan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "hypot": F.hypot, "power": lambda a, b: _safe(F.pow(a, b)), "floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"), "sign": F.signum, "abs": F.abs, "absolute": F.abs, "degrees": F.degrees, "radians": F.radians, "square": lambda a: a * a, "rint": F.rint,
    "minimum": _both(F.least), "maximum": _both(F.greatest), "clip": lambda a, lo, hi: F.when(a.isNotNull(), F.least(F.greatest(a, lo), hi)), "isnan": lambda a: F.isnan(a), "nan_to_num": lambda a: F.coalesce(F.nanvl(a.cast("double"), F.lit(0.0)), F.lit(0.0)), "where": lambda c, a, b: F.when(c, a).when(~c, b), "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": BINARY[ast.Div],
}
MASKED = {
    "masked_where": lambda c, a: F.when(~c, a), "masked_less": lambda a, x: F.when(~(a < x), a), "masked_less_equal": lambda a, x: F.when(~(a <= x), a), "masked_greater": lambda a, x: F.when(~(a > x), a), "masked_greater_equal": lambda a, x: F.when(~(a >= x), a),
    "masked_equal": lambda a, x: F.when(~(a == x), a), "masked_not_equal": lambda a, x: F.when(a == x, a), "masked_inside": lambda a, lo, hi: F.when(~a.between(lo, hi), a), "masked_outside": lambda a, lo, hi: F.when(a.between(lo, hi), a), "masked_invalid": _safe,
}
#: Whole-variable aggregates; their one row is given to every row.
AGGREGATES = {"mean": F.avg, "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "amin": F.min, "amax": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "any": lambda a: F.bool_or(a != 0 if not isinstance(a, bool) else a), "all": lambda a: F.bool_and(a != 0), "len": lambda a: F.count(F.lit(1))}
CONSTANTS = {"pi": math.pi, "e": math.e}
REJECTED = ("map", "filter", "zip", "enumerate", "sorted", "reversed", "range", "divmod")


class _Compiler:
    def __init__(self, names: dict[str, str]):
        self.names, self.aggregates, self.rowwise = names, [], False

    def fail(self, what: str):
        raise EvaluationError(what)

    def __call__(self, n: ast.AST, inside: bool = False) -> Column:
        """inside: within an aggregate, where names do not make the result row-wise."""
        go = lambda x: self(x, inside)
        if isinstance(n, ast.Expression):
            return go(n.body)
        if isinstance(n, ast.Constant):
            if isinstance(n.value, (int, float, bool)):
                return F.lit(n.value)
            self.fail(f"constant {n.value!r}")
        if isinstance(n, ast.Name):
            if n.id in ("True", "False"):
                return F.lit(n.id == "True")
            if "__" in n.id:
                self.fail("names with __ are forbidden")
            if n.id not in self.names:
                self.fail(f"no variable {n.id!r}")
            self.rowwise |= not inside
            return F.col(self.names[n.id])
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            return BINARY[type(n.op)](go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp):
            x = go(n.operand)
            return -x if isinstance(n.op, ast.USub) else ~x if isinstance(n.op, (ast.Not, ast.Invert)) else x
        if isinstance(n, ast.BoolOp):
            out = go(n.values[0])
            for v in n.values[1:]:
                out = out & go(v) if isinstance(n.op, ast.And) else out | go(v)
            return out
        if isinstance(n, ast.Compare):
            left, out = go(n.left), None
            for op, right in zip(n.ops, n.comparators):
                if type(op) not in COMPARE:
                    self.fail(f"comparison {type(op).__name__}")
                right = go(right)
                test = COMPARE[type(op)](left, right)
                out, left = test if out is None else out & test, right
            return out
        if isinstance(n, ast.IfExp):
            return F.when(go(n.test), go(n.body)).otherwise(go(n.orelse))
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("numpy", "np") and n.attr in CONSTANTS:
            return F.lit(CONSTANTS[n.attr])
        if isinstance(n, ast.Call):
            return self.call(n, inside)
        self.fail(f"{type(n).__name__} has no meaning for variables")

    def call(self, n: ast.Call, inside: bool) -> Column:
        f, path = n.func, []
        while isinstance(f, ast.Attribute):
            path, f = [f.attr, *path], f.value
        if not isinstance(f, ast.Name):
            self.fail("only named functions can be called")
        path = [f.id, *path]
        if path[0] in ("numpy", "np"):
            name, table = path[-1], MASKED if path[1:-1] == ["ma"] else NUMPY if len(path) == 2 else {}
        elif len(path) == 1:
            name, table = path[0], BUILTIN
        else:
            self.fail(f"no function {'.'.join(path)}")
        if name in REJECTED and table is BUILTIN:
            self.fail(f"{name} has no point-wise meaning")
        if n.keywords and name not in ("std", "var"):
            self.fail("keyword arguments are not supported")
        one = len(n.args) == 1
        if name in ("min", "max") and table is BUILTIN and not one:
            args = [self(a, inside) for a in n.args]
            return F.least(*args) if name == "min" else F.greatest(*args)
        if name == "percentile" and table is NUMPY and len(n.args) == 2 and isinstance(n.args[1], ast.Constant):
            return self.aggregate(F.percentile(self(n.args[0], True), n.args[1].value / 100), inside)
        if name in AGGREGATES and one and (table is NUMPY and name not in ("len",) or table is BUILTIN and name in ("sum", "min", "max", "len", "any", "all")):
            fn = AGGREGATES[name]
            if n.keywords:
                if [k.arg for k in n.keywords] != ["ddof"] or not isinstance(n.keywords[0].value, ast.Constant) or n.keywords[0].value.value not in (0, 1):
                    self.fail(f"{name} takes ddof=0 or 1 only")
                if n.keywords[0].value.value:
                    fn = {"std": F.stddev_samp, "var": F.var_samp}[name]
            return self.aggregate(fn(self(n.args[0], True)), inside)
        if name not in table:
            self.fail(f"no function {'.'.join(path)}")
        if name == "round":
            if len(n.args) == 2 and not isinstance(n.args[1], ast.Constant):
                self.fail("round takes a constant number of digits")
            return F.bround(self(n.args[0], inside).cast("double"), n.args[1].value if len(n.args) == 2 else 0)
        try:
            return table[name](*[self(a, inside) for a in n.args])
        except TypeError as x:
            raise EvaluationError(f"wrong number of arguments for {'.'.join(path)}") from x

    def aggregate(self, c: Column, inside: bool) -> Column:
        if inside:
            self.fail("an aggregate inside an aggregate")
        name = f"_agg{len(self.aggregates)}"
        self.aggregates.append(c.alias(name))
        return F.col(name)


def compile_expression(expr: str, names: dict[str, str]) -> tuple[Column, list[Column]]:
    """(column, aggregates to compute first). names: variable or alias to column."""
    if "__" in expr:
        raise EvaluationError("__ is forbidden")
    try:
        tree = ast.parse(expr.strip(), mode="eval")
    except SyntaxError as x:
        raise EvaluationError(f"cannot read {expr!r}: {x.msg}") from x
    c = _Compiler(names)
    out = c(tree)
    if not c.rowwise:
        raise EvaluationError("the result must have the shape of the variables")
    return out, c.aggregates


def evaluate(df: DataFrame, expr: str, output: str = "calculated_variable", *, aliases: dict[str, str] | None = None, units: str = "", attributes: dict | None = None) -> DataFrame:
    """df with the expression's value as a new column, whose metadata holds its long name, units and attributes."""
    names = {c: c for c in df.columns} | (aliases or {})
    column, aggregates = compile_expression(expr, names)
    if aggregates:
        df = df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    meta = {"long_name": f'Calculated value for expression "{expr}"', "units": units, **(attributes or {})}
    out = df.withColumn(output, column).withMetadata(output, meta)
    return out.drop(*[f"_agg{i}" for i in range(len(aggregates))])


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Variables of two sources side by side: on an explicit row key, or on all coordinates."""
    return left.join(right, on)
