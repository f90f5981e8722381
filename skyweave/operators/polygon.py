"""Points in polygons of many edges, by an index of cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import polygon_box, polygon_contains

#: Polygons of more edges have an index; fewer are one condition.
FEW_EDGES = 64
#: The index has at most so many rows and columns.
MOST_ROWS = 1024
#: An index is broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20

CELLS = "_row int, _column int, _odd boolean, _flips array<double>, _x1 array<double>, _y1 array<double>, _x2 array<double>, _y2 array<double>"


def index(rings: list) -> tuple[list[tuple], tuple[float, float, float, float], int]:
    """Rows of CELLS, the polygon's box, and how many rows and columns it is cut into.

    A cell knows its own edges, those whose boxes touch it, and how many edges to its right a ray to the right crosses: whether that is
    odd at the foot of its row, and the heights where it changes. Cells wholly outside have no row; cells wholly inside have one without
    edges. The box is cut into 2 sqrt(edges) rows and columns, so that a cell of a usual polygon has few edges.
    """
    e = np.array([(*p, *q) for r in rings for p, q in zip(r, r[1:])], float)
    x1, y1, x2, y2 = box = polygon_box(rings)
    n = max(4, min(MOST_ROWS, math.ceil(2 * math.sqrt(len(e)))))
    w, h = (x2 - x1) / n or 1.0, (y2 - y1) / n or 1.0
    # Whatever rounding does to a point's cell, its edges are among the cell's own.
    dx, dy = 1e-6 * w, 1e-6 * h
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first = np.clip(np.floor((low - y1 - dy) / h).astype(int), 0, n - 1)
    last = np.clip(np.floor((high - y1 + dy) / h).astype(int), 0, n - 1)
    in_row: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        for j in range(a, b + 1):
            in_row[j].append(k)
    rows = []
    for j, held in enumerate(in_row):
        foot, top = y1 + j * h - dy, y1 + (j + 1) * h + dy
        some = np.array(held, int)
        some = some[np.argsort(-left[some], kind="stable")]
        flips: dict[float, int] = {}
        odd, taken, state = False, 0, (False, [])
        for i in reversed(range(n)):
            lo, hi = x1 + i * w - dx, x1 + (i + 1) * w + dx
            before = taken
            while taken < len(some) and left[some[taken]] > hi:
                k = some[taken]
                if low[k] <= foot < high[k]:
                    odd = not odd
                for y in (low[k], high[k]):
                    if foot < y <= top and low[k] < high[k]:
                        # Edges that meet at a height change it twice, which is not at all.
                        if y in flips:
                            del flips[y]
                        else:
                            flips[y] = 1
                taken += 1
            if taken > before:
                state = (odd, sorted(flips))
            own = some[taken:]
            own = own[right[own] >= lo]
            if len(own) or state[0] or state[1]:
                rows.append((j, i, state[0], [float(y) for y in state[1]], *[e[own, c].tolist() for c in range(4)]))
    return rows, box, n


def _inside(x: Column, y: Column) -> Column:
    """polygon_contains() over a cell's edges: odd crossings, and on no edge."""
    edges = F.arrays_zip("_x1", "_y1", "_x2", "_y2")

    def within(s: Column) -> Column:
        a, b, c, d = (s[k] for k in ("_x1", "_y1", "_x2", "_y2"))
        return ((x - a) * (d - b) - (y - b) * (c - a) == 0) & x.between(F.least(a, c), F.greatest(a, c)) & y.between(F.least(b, d), F.greatest(b, d))

    def crossed(s: Column) -> Column:
        a, b, c, d = (s[k] for k in ("_x1", "_y1", "_x2", "_y2"))
        return (y >= F.least(b, d)) & (y < F.greatest(b, d)) & (x < a + (y - b) * ((c - a) / F.nullif(d - b, F.lit(0.0))))

    crossings = F.size(F.filter(edges, crossed)) + F.size(F.filter("_flips", lambda f: f <= y)) + F.col("_odd").cast("int")
    return F.when(F.size(edges) == 0, crossings % 2 == 1).otherwise((crossings % 2 == 1) & ~F.exists(edges, within))


def mark_inside(df: DataFrame, rings: list, x: str, y: str, out: str) -> DataFrame:
    """df with `out`: whether column x, y is strictly inside the polygon; false for NULL.

    A polygon of few edges is one condition. The edges of a larger one are in cells of an index, and a row meets its own cell's in one
    equi-join; rows of cells that no edge touches are settled by the cell.
    """
    X, Y = F.col(x), F.col(y)
    x1, y1, x2, y2 = polygon_box(rings)
    boxed = F.coalesce(X.between(x1, x2) & Y.between(y1, y2), F.lit(False))
    if sum(map(len, rings)) <= FEW_EDGES:
        return df.withColumn(out, boxed & polygon_contains(rings, X, Y))
    rows, _, n = index(rings)
    cell = lambda v, a, b: F.when(boxed, F.least(F.floor((v - a) / ((b - a) / n or 1.0)), F.lit(n - 1)).cast("int"))
    cells = df.sparkSession.createDataFrame(rows, CELLS)
    if sum(8 * (len(r[3]) + 4 * len(r[4])) + 64 for r in rows) <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    met = df.withColumns({"_row": cell(Y, y1, y2), "_column": cell(X, x1, x2)}).join(cells, ["_row", "_column"], "left")
    return met.withColumn(out, F.coalesce(_inside(X.cast("double"), Y.cast("double")), F.lit(False))).select(*df.columns, out)
