import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import ann, shards

sys.path.insert(0, str(Path(__file__).parents[2]))
SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=200), st.integers(1, 16), st.sampled_from([4, 64, 1 << 14]))
def test_minimax_cuts_are_the_best(sizes, n, resolution):
    ends, asked = np.cumsum(sizes).tolist(), []

    def fetch(lo, hi, width):
        near = [e for e in ends if lo < e <= hi]
        asked.append(len(near))
        return near if width == 1 else list({(e - 1) // width: e for e in near}.values())

    cuts = shards.minimax_cuts(fetch, ends[-1], max(sizes), n, resolution)
    best = shards.smallest_capacity(ends, n, max(sizes), ends[-1])
    assert cuts[-1] == ends[-1] and len(cuts) <= n and set(cuts) <= set(ends)
    assert max(np.diff([0, *cuts])) <= best
    assert len(asked) < 64


def test_shards(spark, odd, make):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = shards.shard(docs).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    group = Counter()
    for r in got:
        group[r.size, r.text_crc32] += r.size
    assert max(size.values()) <= max(math.ceil(sum(size.values()) / 16) + max(group.values()), max(group.values()))
    assert {r.size for r in got if r.doc_id in (1001,)} == set() and [r.size for r in got if r.text_crc32 == 0] and all(r.size == 1 for r in got if r.text_crc32 == 0)
    assert shards.shard(make([])).count() == 0
    hot = shards.shard(make([(i, "same text") for i in range(40)] + [(100 + i, f"text {i}") for i in range(80)])).collect()
    assert len({r.shard for r in hot if r.doc_id < 40}) == 1 and len({r.shard for r in hot}) == 16


def brute(vectors, k=5):
    ids, v = np.array([i for i, _ in vectors]), np.array([x for _, x in vectors], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_recall(spark):
    from skyweave.llm.queries import QUERIES

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = QUERIES["op10_additive_quantisation"](spark, "/root/testdata/sf0.1").collect()
    want = brute(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert found.keys() == want.keys() and all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {i: np.array(x, float) for i, x in rows}
    for q, by in found.items():
        for i, s in by.values():
            assert math.isclose(s, exact[q] @ exact[i] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[i]), rel_tol=1e-12)


def test_search_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [0.5, 0.5]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [0.0, -3.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS codes", "2 AS norm", "3 AS vector")
    index, books = ann.build(df)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(index, books, index.where("vec_id % 50 = 0").select("vec_id", "vector")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 7, 0.707106781), (0, 5, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (50, 4, 2, 0.0), (50, 5, 7, -0.707106781)]
    # Components whose squares are no doubles.
    far = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [2.0, 0.0]), (3, [0.0, 1e-200])], "vec_id bigint, embedding array<double>")
    index, books = ann.build(far)
    got = [(r.vec_id, round(r.score, 6)) for r in ann.search(index, books, index.where("vec_id = 0").select("vec_id", "vector"), block=1).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.707107), (3, 0.0)]
    index, books = ann.build(df.limit(0))
    assert ann.search(index, books, index.select("vec_id", "vector")).count() == 0


def test_best_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(6)
    for n in (1, 3, 7, 20):
        near = rng.integers(0, 4, (30, 12)).astype(np.float32)
        near[0] = -np.inf
        want = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :n], axis=1)
        assert np.array_equal(ann._best(near, n), want)


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    m = ann.Additive.fit(x, 3, 16)
    cost = lambda beam: ((x - m.decode(m.encode(x, beam))) ** 2).sum()
    assert cost(16) <= cost(1) * 1.001
    codes = m.encode(x)
    assert np.allclose(m.products(x[:5], codes), x[:5] @ m.decode(codes).T, atol=1e-3)


@pytest.fixture(scope="module")
def staged(spark):
    import corpus_pipeline as cp

    from skyweave.llm.common import save

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, stage in cp.STAGES:
        docs, _ = save(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_pipeline_as_brute_force(spark, staged):
    from test_store_pack_simhash import slow_fingerprint
    from test_text_operators import slow_base, slow_share

    from skyweave.llm.decontam import words

    tables = {n: [r.asDict() for r in df.collect()] for n, df in staged}
    columns = staged[0][1].columns
    assert all(df.columns == columns for n, df in staged[:-1])
    ids = lambda n: {r["doc_id"] for r in tables[n]}
    # Language: documents with letters are clean here and stay.
    assert ids("language") == {r["doc_id"] for r in tables["documents"] if r["text"] and any(c.isalpha() for c in r["text"])}
    # Near copies: the smallest id of each component stays.
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in tables["language"]}
    group = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if group[b] < group[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    group[a], changed = group[b], True
    assert ids("near_duplicates") == {d for d in fps if group[d] == d} and len(tables["near_duplicates"]) == len(ids("near_duplicates"))
    # Benchmark: what a word-by-word alignment over the whole text flags is gone; a quick test passes over the rest.
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(x[i : i + 2]) for i in range(len(x) - 1)} for x in items]
    bad = set()
    for r in tables["near_duplicates"]:
        w = words(r["text"])
        own = {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
        bad |= {r["doc_id"] for x, g in zip(items, grams) if len(g & own) >= len(g) / 3 and slow_share(x, w) >= 0.5}
    assert ids("decontaminate") == ids("near_duplicates") - bad
    # Secrets: all documents stay, without a base secret, and as they were if they had none.
    before = {r["doc_id"]: r["text"] for r in tables["decontaminate"]}
    assert ids("secrets") == ids("decontaminate")
    for r in tables["secrets"]:
        assert not slow_base(r["text"].replace("[secret]", " "))
    # Packing: each token of each document is in one place.
    size = Counter()
    for r in tables["pack"]:
        size[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in tables["pack"]} == ids("secrets") and max(size.values()) <= 4096
    assert len(size) <= -(-sum(size.values()) // 4096) + 1 and len(before) == len(tables["secrets"])


def test_pipeline_odd_rows(spark, odd, make):
    import corpus_pipeline as cp

    docs = odd
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "pack" or docs.columns == odd.columns
    assert docs.count() >= 5
    docs = make([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
