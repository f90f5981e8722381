"""Findings of the third round: each test failed before its change."""

import contextlib
import io

import numpy as np
from test_tree import SCHEMA, cloud, near

from skyweave.operators import collocate as co
from skyweave.operators import evaluate as ev
from skyweave.operators import tree


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(True)
    return out.getvalue()


def test_logarithm_of_zero_is_minus_infinity(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 2.0), (-1.0, 2.0), (None, 2.0), (1.0, 0.0)], "v double, w double")
    assert [r.x for r in ev.evaluate(df, "numpy.log(v / w)", "x").collect()] == [float("-inf"), -0.6931471805599453, None, None, None]
    assert [r.x for r in ev.evaluate(df.limit(1), "numpy.log10(v) + numpy.log2(v)", "x").collect()] == [float("-inf")]


def test_nearest_along_reads_no_shrinking_frame(spark):
    rows = spark.createDataFrame([(i, 1.5 * i, float(i)) for i in range(40)], "id bigint, time double, v double")
    samples = spark.createDataFrame([(i, 1.1 * i) for i in range(50)], "sample_id bigint, time double")
    got = co.nearest_along(samples, rows, ["v"], "t", row_id="id")
    assert "unboundedfollowing" not in plan(got).lower()
    assert all(r.v == min(range(40), key=lambda i: (abs(1.5 * i - r.time), i)) for r in got.collect())


def test_a_leaf_of_data_comes_once_to_a_block(spark, monkeypatch):
    """What is moved for the pairs of leaves grows with the points: a leaf of data is joined once a block, not once for each leaf of samples."""
    monkeypatch.setattr(tree, "BLOCKS", 4)
    for k in (3, 4096):  # a block's data in several tasks, and in one
        monkeypatch.setattr(tree, "BLOCK_LEAVES", k)
        a, b = cloud(400, 21, 0.3, 20), cloud(600, 22, 0.3, 60)
        s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
        sums = tree.box_sums(s, d, ["v"], "sample_id", tree.Limits(h=4000.0), leaf_rows=10)
        got = {r.sample_id: r.k for r in sums.rows.groupBy("sample_id").agg({"k_v": "sum"}).toDF("sample_id", "k").collect()}
        want = (near(a, b, h_sep=4000.0) & np.array([r[6] is not None for r in b])).sum(1)
        assert [got.get(i, 0) for i in range(400)] == want.tolist()
    trees = [tree.build(x, ["latitude", "longitude"], "h", leaf_rows=10) for x in (s, d)]
    edges = sums.pairs.where("NOT settled").select("a", "b")
    fn = lambda x, leaves: tree.pa.table({"n": tree.pa.array([sum(len(y["latitude"]) for y in leaves)], tree.pa.int64())})
    rows = tree.meet_in_blocks(*trees, edges, ["latitude"], ["latitude"], fn, "n bigint")
    assert rows.agg({"n": "sum"}).first()[0] == edges.join(trees[1].leaves, edges.b == trees[1].leaves.leaf).agg({"n": "sum"}).first()[0]
    assert rows.count() < 2 * trees[0].size


def test_neighbours_are_counted_and_listed_by_trees(spark):
    """No join on cells, where a cell at a pole is one task, and no pair made to be counted."""
    a = cloud(300, 23, 0.3, 20)
    p = spark.createDataFrame(a, SCHEMA)
    inside = near(a, a, h_sep=1500.0)
    got = {r.a: r.n for r in co.neighbour_counts(p, 1500.0, "id").collect()}
    assert got == {i: int(n) for i in range(300) if (n := inside[i, i + 1 :].sum())}
    listed = co.within(p.withColumnRenamed("id", "sample_id"), p.withColumnRenamed("id", "row_id"), 1500.0)
    assert "_columns_in" not in plan(listed) and "Generate explode" not in plan(listed)
    assert {(r.sample_id, r.row_id) for r in listed.collect()} == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(inside)))}
