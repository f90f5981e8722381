"""A packed tree of points, for joins by distance that open only what they must.

Points are ordered along a curve that halves their dimensions in turn, the one that is widest for its separation first, and every 128
of them are a leaf: one written row with its points as arrays, the least and greatest value of each dimension, and sums of its
variables. So a leaf is never larger where points are dense, or all at one place. Sixteen nodes in a row have one parent, up to a root.

A join goes down two trees at once, a level a step. A pair of nodes is dropped where none of their points can be within the
separations; it is settled where all of them are, and the data node's sums count for every sample below the other; only else do its
children make pairs. Leaves that stay open meet in Arrow batches, of which no more than sums, or the nearest, leave the task.

On the sphere the dimensions are those of the unit vector, so poles and the date line need no care; chords stand for distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, haversine
from ..scratch import save

LEAF_ROWS, FAN_BITS, CODE_BITS = 128, 4, 40
#: Leaves that meet one leaf in a task at once.
TOGETHER = 256
#: How many blocks of sample leaves there are at least, where there are so many leaves; distinct leaves of data that a task has at once for a
#: block; and how many of these meet one leaf of samples in one step.
BLOCKS, BLOCK_LEAVES, STEP = 96, 4096, 8
#: Rows of a run of data in order of one coordinate, and how many rows on from a sample are looked at for one within its limits.
RUN, AHEAD = 2048, 4096
#: The same, where each pair of points becomes a row.
PAIRED = 16
#: Rounding of chords and differences; what lies within it of a limit is neither settled nor dropped but opened.
SLACK = 1e-11


@dataclass(frozen=True)
class Limits:
    """The separations of a join: haversine <= h km (strict: <), altitude and time differences < a and t, pressure ratio < p."""

    h: float | None = None
    a: float | None = None
    p: float | None = None
    t: float | None = None
    strict: bool = False

    @property
    def dims(self) -> list[str]:
        return [*("xyz" if self.h is not None else ""), *[d for d in "apt" if getattr(self, d) is not None]]

    def reach(self, d: str) -> float:
        return math.log(max(self.p, 1.0)) if d == "p" else getattr(self, d)

    @property
    def chord(self) -> float:
        return 2 * math.sin(min(self.h / (2 * EARTH_RADIUS), math.pi / 2)) if self.h >= 0 else -1.0


#: Columns of the points by the letter of a limit, and what of them is a dimension.
COORDINATES = {"h": ("latitude", "longitude"), "a": ("altitude",), "p": ("air_pressure",), "t": ("time",)}


def dimensions(letters: str) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if "h" in letters:
        lat, lon = F.radians("latitude"), F.radians("longitude")
        out |= {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    if "a" in letters:
        out["a"] = F.col("altitude").cast("double")
    if "p" in letters:
        out["p"] = F.ln(F.col("air_pressure").cast("double"))
    if "t" in letters:
        out["t"] = F.col("time").cast("double")
    return out


def _code(ranges: dict[str, tuple[float, float]], reach: dict[str, float]) -> Column:
    """The place on the curve: at each step a bit more of the dimension that is then widest beside its reach. ranges: of columns."""
    width = {d: (hi - lo) / max(reach[d], 1e-300) for d, (lo, hi) in ranges.items()}
    depth, bits = dict.fromkeys(ranges, 0), []
    cell = {d: f"cast(least(greatest(floor((`{d}` - {lo!r}D) / {(hi - lo) or 1.0!r}D * {2.0**30!r}D), 0), {2**30 - 1}) as bigint)" for d, (lo, hi) in ranges.items()}
    while len(bits) < CODE_BITS and (d := max(width, key=lambda k: width[k])) and width[d] > 0:
        bits.append((d, 29 - depth[d]))
        depth[d] += 1
        width[d] = width[d] / 2 if depth[d] < 30 else 0
    places = [f"shiftleft(shiftright({cell[d]}, {j}) & 1L, {len(bits) - 1 - i})" for i, (d, j) in enumerate(bits)]
    return F.expr(" + ".join(places) or "0L")


@dataclass
class Tree:
    """leaves: a row a leaf (leaf, n, lo_<dim>, hi_<dim>, for each variable v k_v, s_v, q_v, l_v, g_v and the columns as arrays). tall: how
    many levels a part's leaves need; wide: how many the parts need. size: how many leaves there are."""

    leaves: DataFrame
    dims: list[str]
    variables: list[str]
    tall: int
    wide: int
    size: int = 0
    middle: dict[str, float] = field(default_factory=dict)

    def nodes(self, levels: tuple[int, int]) -> DataFrame:
        """(level, id, parent, n, lo_, hi_, sums) of all nodes, for a tree of `levels` (tall, wide)."""
        top = sum(levels)
        each = self.leaves.drop(*[c for c in self.leaves.columns if c.startswith("at_")])
        each = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        ids = F.array(*[node(F.col("leaf"), k, levels) for k in range(top + 2)])
        each = each.withColumns({"id": F.element_at(ids, F.col("level") + 1), "parent": F.element_at(ids, F.col("level") + 2)})
        aggs = [F.sum("n").alias("n")]
        for d in self.dims:
            aggs += [F.min(f"lo_{d}").alias(f"lo_{d}"), F.max(f"hi_{d}").alias(f"hi_{d}")]
        for v in self.variables:
            aggs += [f(f"{c}_{v}").alias(f"{c}_{v}") for c, f in (("k", F.sum), ("s", F.sum), ("q", F.sum), ("l", F.min), ("g", F.max))]
        out, _ = save(each.groupBy("level", "id", "parent").agg(*aggs))
        return out


def node(leaf: Column, level: int, levels: tuple[int, int]) -> Column:
    """The node of a level above a leaf, whose number is its part and its place there. First places are cut, then parts."""
    tall, _ = levels
    part, place = F.shiftright(leaf, 33), leaf.bitwiseAND(F.lit((1 << 33) - 1))
    up = min(level, tall)
    return F.shiftleft(F.shiftright(part, FAN_BITS * (level - up)), 33) + F.shiftright(place, FAN_BITS * up)


def build(points: DataFrame, columns: list[str], letters: str, variables: list[str] = (), *, reach: dict[str, float] | None = None, leaf_rows: int = LEAF_ROWS, centred: bool = True) -> Tree:
    """The tree of points (rows without one of the dimensions are left out), by the coordinates that `letters` name. columns: what the
    leaves hold of each point. variables: doubles whose sums they hold, NULL and NaN aside, about their mean if centred. reach: by
    dimension, what counts as near; without it an eighth of the range."""
    spark, dims = points.sparkSession, dimensions(letters)
    rows = points.select(*dict.fromkeys(columns), *[c.alias(f"_{d}") for d, c in dims.items()]).where(" AND ".join(f"_{d} IS NOT NULL AND NOT isnan(_{d})" for d in dims))
    bounds = [f(f"_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    means = [F.avg(F.when(~F.isnan(F.col(v)), F.col(v))).alias(f"m_{v}") for v in variables]
    r = rows.agg(F.count("*").alias("n"), *bounds, *means).first()
    middle = {v: (r[f"m_{v}"] or 0.0) if centred else 0.0 for v in variables}
    ranges = {f"_{d}": (r[f"lo_{d}"] or 0.0, r[f"hi_{d}"] or 0.0) for d in dims}
    rows = rows.withColumn("_code", _code(ranges, {c: (reach or {}).get(c[1:], (hi - lo) / 8) for c, (lo, hi) in ranges.items()}))
    # Points of one code are told apart by a hash, so that a range holds a bounded share of them too.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), r.n // leaf_rows))
    rows = rows.repartitionByRange(parts, "_code", F.xxhash64(*rows.columns)).sortWithinPartitions("_code")
    kinds = dict(rows.dtypes)
    fields = ["leaf bigint", "n bigint", *[f"{e}_{d} double" for d in dims for e in ("lo", "hi")], *[f"{c}_{v} {'bigint' if c == 'k' else 'double'}" for v in variables for c in "ksqlg"]]
    fields += [f"`at_{c}` array<{kinds[c]}>" for c in columns] + [f"`at__{d}` array<double>" for d in dims]
    flat = list(dims)
    held, names = [*columns, *[f"_{d}" for d in dims]], [f.split()[0].strip("`") for f in fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        leaf, rest = TaskContext.get().partitionId() << 33, None

        def row(t: pa.Table) -> pa.RecordBatch:
            nonlocal leaf
            values, types = [leaf, len(t)], [pa.int64(), pa.int64()]
            for d in flat:
                x = t.column(f"_{d}").to_numpy()
                values += [float(x.min()), float(x.max())]
                types += [pa.float64()] * 2
            for v in variables:
                x = t.column(v).to_numpy().astype(float)
                x = x[~np.isnan(x)]
                y = x - middle[v]
                values += [len(x), float(y.sum()), float((y * y).sum()), *((float(x.min()), float(x.max())) if len(x) else (None, None))]
                types += [pa.int64(), *[pa.float64()] * 4]
            lists = [t.column(c).combine_chunks() for c in held]
            arrays = [pa.array([x], k) for x, k in zip(values, types)]
            arrays += [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), x if isinstance(x, pa.Array) else x.chunk(0)) for x in lists]
            leaf += 1
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while len(rest) >= leaf_rows:
                yield row(rest.slice(0, leaf_rows))
                rest = rest.slice(leaf_rows)
        if rest is not None and len(rest):
            yield row(rest)

    leaves, _ = save(rows.select(*held).mapInArrow(pack, ", ".join(fields)))
    most = leaves.agg(F.max(F.col("leaf").bitwiseAND(F.lit((1 << 33) - 1))), F.max(F.shiftright("leaf", 33)), F.count("*")).first()
    steps = lambda n: math.ceil((n or 0).bit_length() / FAN_BITS)
    return Tree(leaves, list(dims), list(variables), steps(most[0]), steps(most[1]), most[2], middle)


def _apart(d: str, most: bool) -> Column:
    """How far apart the values of a dimension are in two nodes s and d: at least, or at most."""
    s_lo, s_hi, d_lo, d_hi = (F.col(f"{x}.{e}_{d}") for x in "sd" for e in ("lo", "hi"))
    return F.greatest(s_hi - d_lo, d_hi - s_lo) if most else F.greatest(s_lo - d_hi, d_lo - s_hi, F.lit(0.0))


def _chord(most: bool) -> Column:
    """The chord between points of two nodes, at least or at most."""
    x, y, z = (_apart(d, most) for d in "xyz")
    return F.least(F.sqrt(x * x + y * y + z * z), F.lit(2.0))


def descend(samples: Tree, data: Tree, tests: Callable[[], tuple[Column, Column]], *, start: DataFrame | None = None, keys: tuple[str, ...] = (), more: Callable[[], dict[str, Column]] = dict, prune: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both trees' nodes, and the pairs of nodes that are settled, or open at the leaves: (level, a, b, settled, *keys), written.

    tests: whether nodes s and d may have points that meet, and whether all do, as Columns over s.*, d.* and p.<key>. start: rows of keys to
    begin with. prune: takes further pairs of a level away, by columns that `more` makes; none may be settled then.
    """
    levels = (max(samples.tall, data.tall), max(samples.wide, data.wide))
    a, b = samples.nodes(levels), data.nodes(levels)
    top = sum(levels)
    pairs = (start if start is not None else a.sparkSession.range(1).select()).withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "level": F.lit(top + 1), "settled": F.lit(False)})
    for k in range(top, -1, -1):
        if k < min(top, 2):  # joins by broadcast would leave all pairs to the tasks that have the roots
            pairs = pairs.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        up = "id" if k == top else "parent"  # a root each, of number 0
        x, y = a.where(F.col("level") == k).alias("s"), b.where(F.col("level") == k).alias("d")
        may, whole = tests()
        if prune:
            met = pairs.alias("p").join(x, F.col("p.a") == F.col(f"s.{up}")).join(y, F.col("p.b") == F.col(f"d.{up}")).where(may)
            met = met.select(F.lit(k).alias("level"), F.col("s.id").alias("a"), F.col("d.id").alias("b"), F.lit(False).alias("settled"), *[F.col(f"p.{c}").alias(c) for c in keys], *[c.alias(n) for n, c in more().items()])
            pairs = prune(met)
            continue
        # What is settled goes along as it is, so that each level is made once.
        done, open_ = F.col("p.settled"), lambda c: F.when(~F.col("p.settled"), F.col(c))
        met = pairs.alias("p").join(x, open_("p.a") == F.col(f"s.{up}"), "left").join(y, open_("p.b") == F.col(f"d.{up}"), "left")
        met = met.where(done | (F.col("s.id").isNotNull() & F.col("d.id").isNotNull() & may))
        pairs = met.select(F.when(done, F.col("p.level")).otherwise(k).alias("level"), F.coalesce("s.id", "p.a").alias("a"), F.coalesce("d.id", "p.b").alias("b"), (done | whole).alias("settled"), *[F.col(f"p.{c}").alias(c) for c in keys])
    pairs, _ = save(pairs)
    return a, b, pairs


def _tests(limits: Limits) -> tuple[Column, Column]:
    may, whole = F.lit(True), F.lit(True)
    if limits.h is not None and limits.h < math.pi * EARTH_RADIUS:
        may, whole = may & (_chord(False) <= limits.chord + SLACK), whole & (_chord(True) <= limits.chord - SLACK)
    for d in "apt":
        if getattr(limits, d) is not None:
            r = limits.reach(d)
            slack = SLACK * max(1.0, r) if d == "p" else 0.0
            may, whole = may & (_apart(d, False) < r + slack), whole & (_apart(d, True) < r - slack)
    return may, whole


# what leaves do with each other


def _columns(t: pa.Table, i: int, names: list[str], carried: list[str] = ()) -> dict:
    """Row i's arrays; a missing number is NaN. `_carried`: a table of the carried columns, as they are."""
    out = {c: t.column(f"at_{c}")[i].values.to_numpy(zero_copy_only=False) for c in names}
    return out | ({"_carried": pa.table({c: t.column(f"at_{c}")[i].values for c in carried})} if carried else {})


def haversines(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    s, t = np.sin((lat2 - lat1) / 2), np.sin((lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.clip(s * s + np.cos(lat1) * np.cos(lat2) * t * t, 0, 1)))


def _products(s: dict, d: dict) -> np.ndarray:
    """Of unit vectors: cosines of distances."""
    return np.stack([s["_x"], s["_y"], s["_z"]], 1) @ np.stack([d["_x"], d["_y"], d["_z"]])


def within(s: dict, d: dict, limits: Limits) -> np.ndarray:
    """Which data (columns) are within the limits of which samples (rows)."""
    out = None
    for letter, name in (("t", "time"), ("a", "altitude"), ("p", "air_pressure")):
        if (sep := getattr(limits, letter)) is not None:
            x, y = s[name][:, None], d[name]
            near = np.maximum(x / y, y / x) < sep if letter == "p" else np.abs(y - x) < sep
            out = near if out is None else out & near
    if limits.h is not None:
        if limits.h >= math.pi * EARTH_RADIUS * 1.0001:
            near = np.ones((len(s["_x"]), len(d["_x"])), bool)
        else:
            dot, least = _products(s, d), 1 - limits.chord**2 / 2
            near = dot >= least - 1e-12
            if np.count_nonzero(near) != np.count_nonzero(dot > least + 1e-12):  # some are too close to tell from the product
                i, j = np.nonzero(np.abs(dot - least) <= 1e-12)
                h = haversines(s["latitude"][i], s["longitude"][i], d["latitude"][j], d["longitude"][j])
                near[i, j] = h < limits.h if limits.strict else h <= limits.h
        out = near if out is None else out & near
    return out


def meet(samples: Tree, data: Tree, edges: DataFrame, own: list[str], theirs: list[str], fn: Callable[[dict, Iterator[dict]], pa.Table], schema: str, keys: tuple[str, ...] = (), *, carried: tuple[list[str], list[str]] = ((), ()), together: int | None = None) -> DataFrame:
    """fn(a leaf's samples, its leaves of data one after another) for leaf pairs (a, b, *keys); at most `together` leaves of data in one
    call, TOGETHER by default. carried: columns of the samples and of the data that come as Arrow tables."""
    order = Window.partitionBy("a", *keys).orderBy("b")
    edges, _ = save(edges.withColumn("some", F.floor((F.row_number().over(order) - 1) / (together or TOGETHER))))
    by = ["a", "some", *keys]
    at = lambda cols: ["leaf", *[f"at_{c}" for c in dict.fromkeys(cols)]]
    left = edges.select(*by).distinct().join(samples.leaves.select(*at([*own, *carried[0]])), F.col("a") == F.col("leaf")).drop("leaf")
    right = edges.select(*[F.col(c).alias(f"of_{c}") for c in by], "b").join(data.leaves.select(*at([*theirs, *carried[1]])), F.col("b") == F.col("leaf")).drop("leaf", "b")

    def run(key, x: pa.Table, y: pa.Table) -> pa.Table:
        s = _columns(x, 0, own, carried[0])
        s["_keys"] = dict(zip(by, [k.as_py() for k in key]))
        return fn(s, (_columns(y, i, theirs, carried[1]) for i in range(len(y))))

    return left.groupBy(*by).cogroup(right.groupBy(*[f"of_{c}" for c in by])).applyInArrow(run, schema)


def meet_in_blocks(samples: Tree, data: Tree, edges: DataFrame, own: list[str], theirs: list[str], fn: Callable[[dict, Iterator[dict]], pa.Table], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """As meet(), but neighbouring leaves of samples are one block, to which a leaf of data comes once however many of them it meets: what is
    moved grows with the points, not with the pairs of leaves. fn gets STEP leaves of data as one, and may be called for a leaf of samples
    more than once: with over BLOCK_LEAVES leaves of data a block is dealt to several tasks."""
    bits = max(0, (samples.size // BLOCKS).bit_length() - 1)
    edges = edges.withColumn("block", F.shiftright("a", bits))
    many = edges.groupBy("block").agg(F.ceil(F.approx_count_distinct("b") / BLOCK_LEAVES).alias("many"))  # 2 * BLOCKS rows, and one a part, at most
    edges = edges.join(F.broadcast(many), "block").withColumn("some", F.pmod(F.xxhash64("b"), F.col("many"))).drop("many")
    tasks = max(1, min(samples.size, 2 * BLOCKS))
    by, of = ["block", "some"], ["of_block", "of_some"]
    at = lambda cols: ["leaf", *[f"at_{c}" for c in dict.fromkeys(cols)]]
    left = edges.groupBy(*by, "a", *keys).agg(F.collect_list("b").alias("met")).join(samples.leaves.select(*at(own)), F.col("a") == F.col("leaf")).drop("leaf").repartition(tasks, *by)
    right = edges.select(*[F.col(c).alias(f"of_{c}") for c in by], "b").distinct().join(data.leaves.select(*at(theirs)), F.col("b") == F.col("leaf")).drop("leaf").repartition(tasks, *of)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        place = {b: i for i, b in enumerate(y.column("b").to_pylist())}
        whole = {}
        for c in theirs:
            lists = y.column(f"at_{c}").combine_chunks()
            whole[c] = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()

        def some(ids: list[int]) -> dict:
            return {c: np.concatenate([v[at[i] : at[i + 1]] for i in ids]) for c, (v, at) in whole.items()}

        out, held = [], {k: x.column(k).to_pylist() for k in ("met", *keys)}
        for i in range(len(x)):
            ids = sorted(place[b] for b in held["met"][i])
            s = _columns(x, i, own)
            s["_keys"] = {k: held[k][i] for k in keys}
            out.append(fn(s, (some(ids[j : j + STEP]) for j in range(0, len(ids), STEP))))
        return pa.concat_tables(out)

    return left.groupBy(*by).cogroup(right.groupBy(*of)).applyInArrow(run, schema)


MERGE = (("k", F.sum), ("s", F.sum), ("q", F.sum), ("l", F.min), ("g", F.max))


def merged(variables: list[str]) -> list[Column]:
    """Sums of sums: for each variable count, sum, sum of squares, least, greatest."""
    return [f(f"{c}_{v}").alias(f"{c}_{v}") for v in variables for c, f in MERGE]


def _prepared(df: DataFrame, letters: str, limits: Limits, leaf_rows: int, key: str | None = None, **more: Column) -> tuple[DataFrame, list[str], dict]:
    coords = list(dict.fromkeys(c for x in letters for c in COORDINATES[x]))
    own = df.where(F.col(key).isNotNull()) if key else df
    cols = [*([key] if key else []), *[F.col(c).cast("double").alias(c) for c in coords], *[c.alias(n) for n, c in more.items()]]
    reach = {d: limits.chord if d in "xyz" else limits.reach(d) for d in limits.dims}
    return own.select(*cols), coords, {"reach": reach, "leaf_rows": leaf_rows}


@dataclass
class Sums:
    """rows: (key, k_, s_, q_, l_, g_ of each variable), one or more rows a sample; sums are about `middle`. pairs: of nodes that were settled, and
    of leaves that were opened."""

    rows: DataFrame
    middle: dict[str, float]
    pairs: DataFrame


def box_sums(sample: DataFrame, points: DataFrame, variables: list[str], key: str, limits: Limits, *, centred: bool = True, extremes: bool = True, leaf_rows: int = LEAF_ROWS) -> Sums:
    """Count, sum, sum of squares, and if asked the least and the greatest of the data within the limits of each sample; NULL and NaN aside."""
    letters = "".join(d for d in "hapt" if getattr(limits, d) is not None)
    own, coords, how = _prepared(sample, letters, limits, leaf_rows, key)
    theirs, _, _ = _prepared(points, letters, limits, leaf_rows, None, **{v: F.col(v).cast("double") for v in variables})
    s = build(own, [key, *coords], letters, **how)
    d = build(theirs, [*coords, *variables], letters, variables, centred=centred, **how)
    _, b, pairs = descend(s, d, lambda: _tests(limits))
    settled = pairs.where("settled")
    kept = [f"{c}_{v}" for v in variables for c, _ in MERGE]
    whole = settled.join(b.select("level", F.col("id").alias("b"), *kept), ["level", "b"]).groupBy("level", F.col("a").alias("id")).agg(*merged(variables))
    # What a node has settled holds for each leaf below it, and for each sample there.
    shape = (max(s.tall, d.tall), max(s.wide, d.wide))
    ids = F.array(*[F.struct(F.lit(k).alias("level"), node(F.col("leaf"), k, shape).alias("id")) for k in range(sum(shape) + 1)])
    below = s.leaves.select("leaf", F.explode(ids).alias("x")).select("leaf", "x.*").join(whole, ["level", "id"]).groupBy("leaf").agg(*merged(variables))
    rows = s.leaves.select("leaf", F.explode(f"at_{key}").alias(key)).join(below, "leaf").select(key, *kept)
    schema = f"`{key}` {dict(sample.dtypes)[key]}, " + ", ".join(f"`{c}` {'bigint' if c.startswith('k_') else 'double'}" for c in kept)
    dims, middle = [f"_{x}" for x in s.dims], d.middle

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        n = len(x[key])
        got = {v: [np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)] for v in variables}
        for y in leaves:
            near = within(x, y, limits)
            f = near.astype(float)
            for v in variables:
                there = ~np.isnan(y[v])
                z = np.where(there, y[v] - middle[v], 0.0)
                k, total, squares, least, most = got[v]
                sums = f @ np.stack([there.astype(float), z, z * z], 1)
                k += sums[:, 0]
                total += sums[:, 1]
                squares += sums[:, 2]
                if not extremes:
                    continue
                np.minimum(least, np.where(near & there, y[v], np.inf).min(1, initial=np.inf), out=least)
                np.maximum(most, np.where(near & there, y[v], -np.inf).max(1, initial=-np.inf), out=most)
        cols = {key: pa.array(x[key])}
        for v in variables:
            none = got[v][0] == 0
            for (c, _), z in zip(MERGE, got[v]):
                cols[f"{c}_{v}"] = pa.array(np.rint(z).astype(np.int64)) if c == "k" else pa.array(z, mask=none if c in "lg" else None)
        return pa.table(cols)

    edges = pairs.where("NOT settled").select("a", "b")
    met = meet_in_blocks(s, d, edges, [key, *coords, *dims], [*coords, *variables, *dims], fn, schema)
    return Sums(met.unionByName(rows), middle, pairs)


def _runs(rows: DataFrame, order: list[str], size: int, by: str) -> tuple[DataFrame, list]:
    """Rows in their order, `size` of them a written row with arrays: (part, place, n, lo, hi, gap, at_<column>); lo and hi are of the first column
    of the order, gap is the least difference of unequal ones (by p: the least ratio less 1), that before the row included. And a row a
    part: (part, runs, n, lo, hi, gap), in order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds, names = dict(rows.dtypes), rows.columns
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = order[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, before, rest, held = TaskContext.get().partitionId(), 0, None, [], 0

        def row(t: pa.Table) -> pa.RecordBatch:
            nonlocal place, before
            o = t.column(first).to_numpy()
            line = o if before is None else np.concatenate([[before], o])
            steps, base = np.diff(line), np.minimum(np.abs(line[1:]), np.abs(line[:-1]))
            gap = (steps / base if by == "p" else steps)[steps > 0]
            values = [part, place, len(t), float(o[0]), float(o[-1]), float(gap.min()) if len(gap) else math.inf]
            arrays = [pa.array([x], k) for x, k in zip(values, [pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3])]
            arrays += [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for x in (t.column(c).combine_chunks() for c in names)]
            place, before = place + 1, float(o[-1])
            return pa.RecordBatch.from_arrays(arrays, names=["part", "place", "n", "lo", "hi", "gap", *[f"at_{c}" for c in names]])

        for b in batches:
            rest.append(b)
            held += len(b)
            if held >= size:
                t = pa.Table.from_batches(rest)
                while len(t) >= size:
                    yield row(t.slice(0, size))
                    t = t.slice(size)
                rest, held = t.combine_chunks().to_batches() if len(t) else [], len(t)
        if held:
            yield row(pa.Table.from_batches(rest))

    runs, _ = save(rows.mapInArrow(pack, ", ".join(["part int, place bigint, n bigint, lo double, hi double, gap double", *[f"`at_{c}` array<{kinds[c]}>" for c in names]])))
    return runs, runs.groupBy("part").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("gap").alias("gap")).orderBy("part").collect()


def nearest_ahead(own: DataFrame, theirs: DataFrame, coords: list[str], variable: str, key: str, by: str, limits: Limits) -> DataFrame:
    """(key, _far, _rid, variable, done), a row a sample and way: of the data from a sample's own height, pressure or time upwards, and of those
    below it, the first that is within the limits, in order of that coordinate and of _rid. About as many data are looked at as there are
    for one within the limits. Not done: none was found in AHEAD rows, or what comes next was not seen and may be as near."""
    c = COORDINATES[by][0]
    spark, dims = own.sparkSession, dimensions("h")
    both = []
    for df in (own, theirs):
        df = df.select("*", *[x.alias(f"_{d}") for d, x in dims.items()]).where(" AND ".join(f"`{n}` IS NOT NULL AND NOT isnan(`{n}`)" for n in ["_x", "_y", "_z", c]))
        both.append(df.where(F.col(c) > 0) if by == "p" else df)
    n_s, n_d = both[0].count(), both[1].count()
    if not n_s or not n_d:
        return both[0].select(key, F.lit(None).cast("double").alias("_far"), F.lit(None).cast(dict(theirs.dtypes)["_rid"]).alias("_rid"), F.lit(None).cast("double").alias(variable), F.lit(True).alias("done"))
    size = max(16, min(32 * RUN, 32 * RUN * n_s // n_d, max(RUN, n_s // (2 * BLOCKS))))
    held = [*coords, "_x", "_y", "_z"]
    schema = f"`{key}` {dict(own.dtypes)[key]}, _far double, _rid {dict(theirs.dtypes)['_rid']}, `{variable}` double, done boolean"

    def way(sign: float) -> DataFrame:
        s, d = (x.withColumn("_o", F.col(c) * F.lit(sign) + F.lit(0.0)) for x in both)
        s, _ = _runs(s.select("_o", F.xxhash64(key).alias("_h"), key, *held), ["_o", "_h"], size, by)
        d, parts = _runs(d.select("_o", "_rid", "_v", *held), ["_o", "_rid"], RUN, by)
        # A row a part: where its runs begin in the whole order.
        begin = dict(zip([r.part for r in parts], np.cumsum([0, *[r.runs for r in parts]]).tolist()))
        total = sum(r.runs for r in parts)
        ends = [(y.lo - x.hi) / min(abs(x.hi), abs(y.lo)) if by == "p" else y.lo - x.hi for x, y in zip(parts, parts[1:]) if y.lo > x.hi]
        gap, scale = min([r.gap for r in parts] + ends), 1.0 if by == "p" else max(abs(e) for r in parts for e in (r.lo, r.hi))
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]), F.col("part"))
        d = d.withColumn("rank", (offset + F.col("place")).cast("long"))
        tops = F.array(*[F.struct(F.lit(r.hi).alias("hi"), F.lit(r.part).alias("part")) for r in parts])
        lists = d.groupBy("part").agg(F.sort_array(F.collect_list("hi")).alias("his"))
        s = s.withColumn("block", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("place"))).drop("part", "place", "n", "gap")
        # Runs before a sample's place; downwards what is as high as the sample is before it too.
        short = (lambda hi: hi < F.col("o")) if sign > 0 else (lambda hi: hi <= F.col("o"))
        at = s.select("block", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("o")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("o")))).alias("e")).select("block", "e.*")
        at = at.withColumn("part", F.coalesce(F.get(F.filter(tops, lambda t: ~short(t["hi"])), F.lit(0))["part"], F.lit(parts[-1].part)))
        at = at.join(lists, "part").select("block", "end", (offset + F.size(F.filter("his", short))).cast("long").alias("rank"))
        at = at.groupBy("block").agg(F.min("rank").alias("from"), F.max("rank").alias("to"))
        # Samples far apart beside the data get no more than so many runs; those of them that are not done are taken by trees.
        upto = F.least(F.col("to") + 1 + AHEAD // RUN, F.col("from") + 128, F.lit(total - 1))
        right = at.where(F.col("from") < total).select(F.col("block").alias("of"), F.explode(F.sequence("from", F.greatest("from", upto))).alias("rank")).join(d.select("rank", *[f"at_{x}" for x in ["_o", "_rid", "_v", *held]]), "rank")
        left = s.select("block", *[f"at_{x}" for x in ["_o", key, *held]])

        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            y = y.sort_by("rank")
            ranks = y.column("rank").to_pylist()
            last = not ranks or ranks[-1] == total - 1
            s = _columns(x, 0, ["_o", *held])
            keys, n = x.column(f"at_{key}")[0].values, len(s["_o"])
            data = {e: y.column(f"at_{e}").combine_chunks().flatten() for e in ["_o", "_rid", "_v", *held]}
            d = {e: v.to_numpy(zero_copy_only=False) for e, v in data.items() if e != "_rid"}
            start = np.searchsorted(d["_o"], s["_o"], "left" if sign > 0 else "right")
            hit = np.full(n, -1)
            for i in range(0, n, 256):
                act = np.arange(i, min(i + 256, n))
                lo = start[act[0]]
                while len(act) and lo < len(d["_o"]):
                    some = {e: v[lo : lo + 512] for e, v in d.items()}
                    # Samples of which this stretch is wholly before wait.
                    now = act[start[act] < lo + 512]
                    if not len(now):
                        lo = start[act[0]]
                        continue
                    near = within({e: v[now] for e, v in s.items()}, some, limits) & (np.arange(lo, lo + len(some["_o"])) >= start[now][:, None])
                    got = near.any(1)
                    hit[now[got]] = lo + near[got].argmax(1)
                    act = act[hit[act] < 0]
                    lo += 512
            i = np.flatnonzero(hit >= 0)
            measure = (lambda p, q: np.maximum(p / q, q / p)) if by == "p" else (lambda p, q: np.abs(q - p))
            far = np.full(n, np.nan)
            far[i] = measure(s[c][i], d[c][hit[i]])
            # Of values further on, by rounding none may be as near: the next one tells, or that all are apart.
            done = np.full(n, last)
            after = np.searchsorted(d["_o"], d["_o"][hit[i]], "right")
            seen = after < len(d["_o"])
            beyond = np.full(len(i), last or gap > 1e-14 * max(scale, float(np.abs(s[c]).max()) if by != "p" else 1.0))
            beyond[seen] = measure(s[c][i][seen], d[c][after[seen]]) > far[i][seen]
            done[i] = beyond
            index = pa.array(np.where(hit >= 0, hit, 0), mask=hit < 0)
            return pa.table({key: keys, "_far": pa.array(far, mask=hit < 0), "_rid": data["_rid"].take(index), variable: data["_v"].take(index), "done": pa.array(done)})

        return left.groupBy("block").cogroup(right.groupBy("of")).applyInArrow(run, schema)

    return save(way(1.0).unionByName(way(-1.0)))[0]


def nearest_in(sample: DataFrame, points: DataFrame, variable: str, key: str, row_id: str | None, by: str, limits: Limits = Limits(), *, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, _far, _rid, variable): of the data that have the variable, within the limits if there are any, the nearest by h, a, p or t for each
    sample (ties: the least row_id), one or more rows a sample; and the pairs of leaves that were opened.

    A leaf of samples opens no leaf of data that is farther than another at its farthest, where all of that one is within the limits.
    """
    letters = "".join(d for d in "hapt" if getattr(limits, d) is not None or d == by)
    text = row_id is not None and dict(points.dtypes)[row_id] == "string"
    rid = F.col(row_id).cast("string" if text else "long") if row_id else F.lit(0).cast("long")
    own, coords, how = _prepared(sample, letters, limits, leaf_rows, key)
    theirs, _, _ = _prepared(points.where(F.col(variable).isNotNull()), letters, limits, leaf_rows, None, _v=F.col(variable).cast("double"), _rid=rid)
    first = None
    if by in "apt" and limits.dims == ["x", "y", "z"] and (1 - math.cos(min(limits.h / EARTH_RADIUS, math.pi))) / 2 * AHEAD >= 8:
        found = nearest_ahead(own, theirs, coords, variable, key, by, limits)
        first, rest = found.where("_far IS NOT NULL").drop("done"), found.where("NOT done").select(key).distinct()
        if rest.isEmpty():
            return first, own.sparkSession.createDataFrame([], "a bigint, b bigint")
        own = own.join(rest, key, "left_semi")
    s, d = build(own, [key, *coords], letters, **how), build(theirs, [*coords, "_v", "_rid"], letters, **how)

    def tests() -> tuple[Column, Column]:
        return _tests(limits)[0], F.lit(False)

    def more() -> dict[str, Column]:
        near, far = (_chord(False), _chord(True)) if by == "h" else (_apart(by, False), _apart(by, True))
        return {"near": near, "far": F.when(_tests(limits)[1], far)}

    def prune(met: DataFrame) -> DataFrame:
        met = met.withColumn("bound", F.min("far").over(Window.partitionBy("a")))
        return met.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + SLACK) + SLACK)).drop("near", "far", "bound")

    _, _, edges = descend(s, d, tests, more=more, prune=prune)
    edges = edges.select("a", "b")
    schema = f"`{key}` {dict(sample.dtypes)[key]}, _far double, _rid {'string' if text else 'bigint'}, `{variable}` double"
    dims = [f"_{x}" for x in s.dims]

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        n = len(x[key])
        rows, far, rid, val, has = np.arange(n), np.full(n, np.inf), np.zeros(n, object), np.full(n, np.nan), np.zeros(n, bool)
        for y in leaves:
            order = np.argsort(y["_rid"], kind="stable")  # so that the first of equal ones has the least id
            y = {c: z[order] for c, z in y.items()}
            near = within(x, y, limits) if limits.dims else None
            if by == "h":
                # The product tells which are not nearest; distances are taken of the few that may be.
                dot = _products(x, y) if near is None else np.where(near, _products(x, y), -2.0)
                m = np.full(dot.shape, np.inf)
                a, b = np.nonzero(dot >= np.maximum(dot.max(1, keepdims=True) - 1e-12, -1.5))
                m[a, b] = haversines(x["latitude"][a], x["longitude"][a], y["latitude"][b], y["longitude"][b])
            else:
                p, q = x[COORDINATES[by][0]][:, None], y[COORDINATES[by][0]]
                m = np.maximum(p / q, q / p) if by == "p" else np.abs(q - p)
                m = m if near is None else np.where(near, m, np.inf)
            j = m.argmin(1)
            best, ids = m[rows, j], y["_rid"][j]
            take = (best < np.inf) & (~has | (best < far))
            for i in np.flatnonzero(has & (best == far)):
                take[i] = ids[i] < rid[i]
            far[take], rid[take], val[take], has[take] = best[take], ids[take], y["_v"][j][take], True
        i = np.flatnonzero(has)
        return pa.table({key: pa.array(x[key][i]), "_far": pa.array(far[i]), "_rid": pa.array(rid[i].tolist(), pa.string() if text else pa.int64()), variable: pa.array(val[i])})

    met = meet_in_blocks(s, d, edges, [key, *coords, *dims], [*coords, "_v", "_rid", *dims], fn, schema)
    return (met if first is None else met.unionByName(first)), edges


def _open(sample: DataFrame, points: DataFrame, limits: Limits, leaf_rows: int) -> tuple[Tree, Tree, DataFrame, list[str]]:
    """Trees that hold all columns, the pairs (a, b) of leaves whose points may be within the limits, and the columns that tell."""
    letters = "".join(d for d in "hapt" if getattr(limits, d) is not None)
    coords = list(dict.fromkeys(c for x in letters for c in COORDINATES[x]))
    reach = {d: limits.chord if d in "xyz" else limits.reach(d) for d in limits.dims}
    s, d = (build(x.withColumns({c: F.col(c).cast("double") for c in coords}), x.columns, letters, reach=reach, leaf_rows=leaf_rows) for x in (sample, points))
    _, _, edges = descend(s, d, lambda: (_tests(limits)[0], F.lit(False)))
    return s, d, edges.select("a", "b"), [*coords, *[f"_{x}" for x in s.dims]]


def _pair_rows(s: Tree, d: Tree, edges: DataFrame, held: list[str], limits: Limits, names: tuple[list[str], list[str]]) -> DataFrame:
    kinds = [{f.name[3:]: f.dataType.elementType.simpleString() for f in t.leaves.schema if f.name.startswith("at_")} for t in (s, d)]
    schema = ", ".join([*[f"`s_{c}` {kinds[0][c]}" for c in names[0]], *[f"`{c}` {kinds[1][c]}" for c in names[1]]])

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        out = []
        for y in leaves:
            i, j = np.nonzero(within(x, y, limits))
            a, b = x["_carried"].take(pa.array(i)), y["_carried"].take(pa.array(j))
            out.append(pa.table({**{f"s_{c}": a.column(c) for c in names[0]}, **{c: b.column(c) for c in names[1]}}))
        return pa.concat_tables(out)

    return meet(s, d, edges, held, held, fn, schema, carried=names, together=PAIRED)


def paired(sample: DataFrame, points: DataFrame, limits: Limits, *, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Sample rows (columns named s_<name>) with the points within the limits; coordinates as doubles."""
    s, d, edges, held = _open(sample, points, limits, leaf_rows)
    return _pair_rows(s, d, edges, held, limits, (sample.columns, points.columns))


def by_leaf(sample: DataFrame, points: DataFrame, limits: Limits, fn: Callable, schema: str, *, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fn(samples, data, near) once for each leaf of samples, with all data of the leaves that it meets: pandas frames, and which rows of data are
    near which samples. Samples of a leaf that meets over TOGETHER leaves are not called; their pairs are returned, as paired() has
    them. And the pairs of leaves of the first kind."""
    s, d, edges, held = _open(sample, points, limits, leaf_rows)
    crowded = edges.groupBy("a").count().where(F.col("count") > TOGETHER).select("a")
    few, names = edges.join(crowded, "a", "left_anti"), (sample.columns, points.columns)

    def run(x: dict, leaves: Iterator[dict]) -> pa.Table:
        near, data = [], []
        for y in leaves:
            m = within(x, y, limits)
            some = m.any(0)  # data that are near no sample are not held
            near.append(m[:, some])
            data.append(y["_carried"].filter(pa.array(some)))
        return pa.Table.from_pandas(fn(x["_carried"].to_pandas(), pa.concat_tables(data).to_pandas(), np.concatenate(near, 1)), preserve_index=False)

    return meet(s, d, few, held, held, run, schema, carried=names), _pair_rows(s, d, edges.join(crowded, "a", "left_semi"), held, limits, names), few


def nearest_k(sample: DataFrame, points: DataFrame, k: int, key: str, row_id: str, h: float | None = None, *, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, row_id, distance) of each sample's k nearest points (within h km, if given), k or more rows a sample; and the pairs of leaves that were
    opened. Leaves in order of their farthest point hold k points up to a bound; what is wholly beyond it is not opened."""
    limits, coords = Limits(h=h), list(COORDINATES["h"])
    text = dict(points.dtypes)[row_id] == "string"
    own, theirs = sample.select(key, *[F.col(c).cast("double").alias(c) for c in coords]), points.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("string" if text else "long").alias("_rid"), *[F.col(c).cast("double").alias(c) for c in coords])
    s, d = build(own, own.columns, "h", leaf_rows=leaf_rows), build(theirs, theirs.columns, "h", leaf_rows=leaf_rows)

    def prune(met: DataFrame) -> DataFrame:
        upto = Window.partitionBy("a").orderBy("far", "b").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("upto", F.sum("size").over(upto)).withColumn("bound", F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy("a")))
        return met.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + SLACK) + SLACK)).drop("near", "far", "size", "upto", "bound")

    _, _, edges = descend(s, d, lambda: (_tests(limits)[0], F.lit(False)), more=lambda: {"near": _chord(False), "far": _chord(True), "size": F.col("d.n")}, prune=prune)
    edges = edges.select("a", "b")

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        best: pd.DataFrame | None = None
        for y in leaves:
            dot, n = _products(x, y), len(y["_rid"])
            # The product tells which are not among the k nearest of the leaf; distances are taken of those that may be.
            least = -2.0 if n <= k else np.partition(dot, n - k, axis=1)[:, n - k][:, None] - 1e-12
            i, j = np.nonzero(dot >= least)
            far = haversines(x["latitude"][i], x["longitude"][i], y["latitude"][j], y["longitude"][j])
            got = pd.DataFrame({"i": i, "distance": far, "r": y["_rid"][j], "latitude": y["latitude"][j], "longitude": y["longitude"][j]})
            got = (got if h is None else got[got.distance <= h]).sort_values(["i", "distance", "r"])
            best = got if best is None else pd.concat([best, got]).sort_values(["i", "distance", "r"])
            best = best.groupby("i").head(k)
        return pa.table({key: pa.array(x[key][best.i.to_numpy()]), "_rid": pa.array(best.r.tolist(), pa.string() if text else pa.int64()), **{f"s_{c}": pa.array(x[c][best.i.to_numpy()]) for c in coords}, **{c: pa.array(best[c].to_numpy(float)) for c in coords}})

    dims = [f"_{x}" for x in "xyz"]
    met = meet_in_blocks(s, d, edges, [key, *coords, *dims], ["_rid", *coords, *dims], fn, f"`{key}` {dict(sample.dtypes)[key]}, _rid {'string' if text else 'bigint'}, s_latitude double, s_longitude double, latitude double, longitude double")
    return met.select(key, F.col("_rid").cast(dict(points.dtypes)[row_id]).alias(row_id), haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")).alias("distance")), edges


def count_after(points: DataFrame, h: float, key: str, *, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, n), one or more rows a point: how many points of a greater key are within h km."""
    limits = Limits(h=h)
    rows, coords, how = _prepared(points, "h", limits, leaf_rows, key)
    s, d = (build(rows, [key, *coords], "h", **how) for _ in "sd")
    _, _, edges = descend(s, d, lambda: (_tests(limits)[0], F.lit(False)))
    held = [key, *coords, "_x", "_y", "_z"]

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        n = np.zeros(len(x[key]), np.int64)
        for y in leaves:
            n += (within(x, y, limits) & (y[key] > x[key][:, None])).sum(1)
        return pa.table({key: pa.array(x[key]), "n": pa.array(n)})

    return meet_in_blocks(s, d, edges.select("a", "b"), held, held, fn, f"`{key}` {dict(points.dtypes)[key]}, n bigint")


def count_within(left: DataFrame, right: DataFrame, radii: list[float], leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """(radius, n): how many pairs of a row of `left` and a row of `right` are within each radius (km). Pairs of nodes that are wholly within
    it count by the product of their sizes. And the pairs of leaves that were opened, (a, b, q), q being the radius' place."""
    spark, coords = left.sparkSession, list(COORDINATES["h"])
    limits = [Limits(h=float(r)) for r in radii]
    s, d = (build(_prepared(x, "h", Limits(), leaf_rows)[0], coords, "h", leaf_rows=leaf_rows) for x in (left, right))
    start = spark.createDataFrame([(i, x.chord, x.h >= math.pi * EARTH_RADIUS) for i, x in enumerate(limits)], "q int, chord double, everything boolean")

    def tests() -> tuple[Column, Column]:
        every = F.col("p.everything")
        return every | (_chord(False) <= F.col("p.chord") + SLACK), every | (_chord(True) <= F.col("p.chord") - SLACK)

    a, b, pairs = descend(s, d, tests, start=start, keys=("q", "chord", "everything"))
    settled = pairs.where("settled")
    size = lambda nodes, c: nodes.select("level", F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    sizes = settled.join(size(a, "a"), ["level", "a"]).join(size(b, "b"), ["level", "b"]).select("q", (F.col("n_a") * F.col("n_b")).alias("n"))
    edges, held = pairs.where("NOT settled").select("a", "b", "q"), [*coords, "_x", "_y", "_z"]

    def fn(x: dict, leaves: Iterator[dict]) -> pa.Table:
        q = x["_keys"]["q"]
        return pa.table({"q": pa.array([q], pa.int32()), "n": pa.array([sum(int(within(x, y, limits[q]).sum()) for y in leaves)], pa.int64())})

    counted = meet_in_blocks(s, d, edges, held, held, fn, "q int, n bigint", keys=("q",))
    total = sizes.unionByName(counted).groupBy("q").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(i, x.h) for i, x in enumerate(limits)], "q int, radius double")
    return names.join(total, "q", "left").select("radius", F.coalesce("n", F.lit(0).cast("long")).alias("n")), edges
