"""Axes, cells and dense spines."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InconsistentDimensionsError

#: A dense grid above this many cells is refused unless asked for.
MOST_CELLS = 200_000_000
#: Edges of a longer axis are in a tree with nodes of so many.
FANOUT = 256
#: Nodes of an axis are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Axis:
    """An ascending axis: points and their half-open cells [lo, hi). step is set where the cells are uniform."""

    name: str
    points: tuple[float, ...]
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    step: float | None = None
    cyclic: bool = field(default=False)

    def __len__(self):
        return len(self.points)

    @classmethod
    def regular(cls, name: str, start: float, stop: float, step: float) -> "Axis":
        """Points start + step / 2, ... below stop + step / 2; the last cell may overhang; a single cell is [start, stop)."""
        n = max(1, math.ceil((stop - start) / step - 1e-9))
        if n == 1:
            return cls(name, (start + step / 2,), (start,), (stop,))
        edges = [start + i * step for i in range(n + 1)]
        return cls(name, tuple(e + step / 2 for e in edges[:-1]), tuple(edges[:-1]), tuple(edges[1:]), step)

    @classmethod
    def of_points(cls, name: str, points: list[float], cyclic: bool = False) -> "Axis":
        """Ascending points with bounds guessed half-way; latitude is clipped at the poles."""
        p = sorted(points)
        if len(p) == 1:
            return cls(name, tuple(p), (p[0] - 0.5,), (p[0] + 0.5,), cyclic=cyclic)
        mid = [(a + b) / 2 for a, b in zip(p, p[1:])]
        lo, hi = [p[0] - (mid[0] - p[0]), *mid], [*mid, p[-1] + (p[-1] - mid[-1])]
        if name == "latitude" and min(p) >= -90 and max(p) <= 90:
            lo[0], hi[-1] = max(lo[0], -90.0), min(hi[-1], 90.0)
        steps = {b - a for a, b in zip(lo, hi)}
        return cls(name, tuple(map(float, p)), tuple(map(float, lo)), tuple(map(float, hi)), steps.pop() if len(steps) == 1 else None, cyclic)

    @classmethod
    def bounded(cls, name: str, bounds: list[tuple[float, float]], points: list[float] | None = None) -> "Axis":
        """Cells with given bounds, which need not touch."""
        b = sorted(bounds)
        return cls(name, tuple(sorted(points) if points else [(x + y) / 2 for x, y in b]), tuple(x for x, _ in b), tuple(y for _, y in b))

    def even(self) -> bool:
        """Whether its lower bounds are lo[0] + i * step to the last digit."""
        return self.step is not None and all(self.lo[0] + i * self.step == v for i, v in enumerate(self.lo))

    def index(self, x: Column) -> Column:
        """The cell that holds x, or NULL. Cells are lo <= x < hi, compared with the edges themselves."""
        if len(self) == 1:
            return F.when((x >= self.lo[0]) & (x < self.hi[0]), F.lit(0))
        if self.even():
            s, d = F.lit(self.lo[0]), F.lit(self.step)
            k = F.floor((x - s) / d)
            # The quotient may be off by one unit in the last place.
            k = k - (x < s + k * d).cast("int") + (x >= s + (k + 1) * d).cast("int")
            return F.when((x >= s) & (x < F.lit(self.hi[-1])), k.cast("int"))
        k = search(self.lo, x, right=True) - 1
        return F.when((k >= 0) & (x < F.element_at(F.array(*map(F.lit, self.hi)), F.greatest(k, F.lit(0)) + 1)), k)


def search(edges: tuple[float, ...], x: Column, right: bool) -> Column:
    """How many of the ascending edges are <= x (right) or < x: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        e = F.lit(float(edges[mid]))
        return F.when(x >= e if right else x > e, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(x.isNotNull(), tree(0, len(edges)))


def value_at(values: tuple[float, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), i + 1)


def _chunks(spark: SparkSession, columns: dict[str, tuple[float, ...]]) -> DataFrame:
    """_node and, for each column, the array of its values FANOUT * _node onwards, FANOUT of them or fewer."""
    n = len(next(iter(columns.values())))
    rows = [(i // FANOUT, *[[float(v) for v in c[i : i + FANOUT]] for c in columns.values()]) for i in range(0, n, FANOUT)]
    out = spark.createDataFrame(rows, "_node int, " + ", ".join(f"`{c}` array<double>" for c in columns))
    return F.broadcast(out) if 8 * n * len(columns) <= BROADCAST_BYTES else out


def _count_in(edges: Column, x: Column, right: bool) -> Column:
    """How many of an array's ascending edges, of FANOUT at most, are <= x (right) or < x, by halving."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        e = F.get(edges, mid)
        go = (e <= x) if right else (e < x)
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(FANOUT.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi")), halve, lambda s: s["lo"])


def rank_in(df: DataFrame, edges: tuple[float, ...], x: str, out: str, right: bool = True, carry: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """df with `out`: how many of the ascending edges are <= column x (right) or < it; NULL for NULL. carry: columns of values, one an
    edge, taken at the last edge counted, or at the first if none is.

    Few edges are a tree of comparisons. Many are a tree of nodes with FANOUT edges each: its root is that, and each level below is one
    equi-join with node numbers, and a search in the node's array; so a row meets one node a level, however uneven the edges are.
    """
    carry, X = carry or {}, F.col(x)
    if len(edges) <= FANOUT:
        df = df.withColumn(out, search(edges, X, right))
        return df.withColumns({c: value_at(v, F.greatest(F.col(out) - 1, F.lit(0))) for c, v in carry.items()}) if carry else df
    levels = [tuple(edges)]
    while len(levels[-1]) > FANOUT:
        levels.append(levels[-1][::FANOUT])
    df = df.withColumn(out, search(levels[-1], X, right))
    for k, level in reversed(list(enumerate(levels[:-1]))):
        held = {"_edges": level} | ({f"_carry_{c}": v for c, v in carry.items()} if k == 0 else {})
        df = df.withColumn("_node", F.greatest(F.col(out) - 1, F.lit(0))).join(_chunks(df.sparkSession, held), "_node", "left")
        df = df.withColumn("_in", F.when(X.isNotNull(), _count_in(F.col("_edges"), X, right)))
        if k == 0:
            df = df.withColumns({c: F.get(f"_carry_{c}", F.greatest(F.col("_in") - 1, F.lit(0))) for c in carry})
        df = df.withColumn(out, F.col("_node") * FANOUT + F.col("_in")).drop("_node", "_in", *held)
    return df


def locate(df: DataFrame, a: Axis, out: str) -> DataFrame:
    """df with `out`: the cell of axis a that holds the column of its name, or NULL, in gaps between cells too."""
    if a.even() or len(a) <= FANOUT:
        return df.withColumn(out, a.index(F.col(a.name)))
    df = rank_in(df, a.lo, a.name, out, carry={"_hi": a.hi})
    return df.withColumn(out, F.when((F.col(out) > 0) & (F.col(a.name) < F.col("_hi")), F.col(out) - 1)).drop("_hi")


def _values(df: DataFrame, i: str, columns: dict[str, tuple[float, ...]]) -> DataFrame:
    """df with each column's value at index i."""
    if len(next(iter(columns.values()))) <= FANOUT:
        return df.withColumns({c: value_at(v, F.col(i)) for c, v in columns.items()})
    held = {f"_v_{c}": v for c, v in columns.items()}
    df = df.withColumn("_node", F.shiftright(F.col(i), FANOUT.bit_length() - 1)).join(_chunks(df.sparkSession, held), "_node", "left")
    return df.withColumns({c: F.get(f"_v_{c}", F.col(i) % FANOUT) for c in columns}).drop("_node", *held)


def spine(spark: SparkSession, axes: list[Axis], most: int = MOST_CELLS) -> DataFrame:
    """Every cell of the axes' product: <name>_i, <name>, <name>_lo, <name>_hi, and cell, its row-major number. No join makes it."""
    n = math.prod(map(len, axes))
    if n > most:
        raise InconsistentDimensionsError(f"a dense grid of {n} cells; ask for a sparse one, or allow it by `most`")
    return with_axes(spark.range(n).withColumnRenamed("id", "cell"), axes)


def with_axes(cells: DataFrame, axes: list[Axis]) -> DataFrame:
    """cells (a column of row-major numbers among others) with <name>_i, <name>, <name>_lo and <name>_hi of each axis."""
    out, stride = cells, math.prod(map(len, axes))
    for a in axes:
        stride //= len(a)
        i = F.floor(F.col("cell") / stride).cast("long") % len(a)
        out = out.withColumn(f"{a.name}_i", i.cast("int"))
        k, lo, even = F.col(f"{a.name}_i"), F.lit(a.lo[0]), a.even()
        stored = {a.name: a.points, f"{a.name}_lo": a.lo, f"{a.name}_hi": a.hi}
        if even:
            out = out.withColumns({f"{a.name}_lo": lo + k * F.lit(a.step), f"{a.name}_hi": lo + (k + 1) * F.lit(a.step)})
            del stored[f"{a.name}_lo"], stored[f"{a.name}_hi"]
            if all(p == e + a.step / 2 for p, e in zip(a.points, a.lo)):
                out = out.withColumn(a.name, F.col(f"{a.name}_lo") + F.lit(a.step / 2))
                del stored[a.name]
        out = _values(out, f"{a.name}_i", stored) if stored else out
    return out


def cell_number(axes: list[Axis], index: dict[str, Column]) -> Column:
    """The row-major number of the cell with these indexes; NULL if any is."""
    out = F.lit(0).cast("long")
    for a in axes:
        out = out * len(a) + index[a.name]
    return out
