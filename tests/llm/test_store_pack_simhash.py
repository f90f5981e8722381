import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyweave.llm import packing, simhash, token_store
from skyweave.llm.bpe import WordEncoder
from skyweave.llm.common import workdir

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text("abT's ,.<|>\n éÉ́", max_size=30), max_size=4))
def test_words_encode_as_the_whole_text(texts):
    got = WordEncoder.of(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(t) for t in texts]


def test_store_round_trip(spark, odd):
    path = workdir(spark)
    token_store.write_tokens(odd, path, tokenizer=PATH, block_docs=3)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    want = sorted((r.doc_id if r.doc_id is not None else -(10**9), [*whole(r.text), 2]) for r in odd.collect())
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    assert sorted((r.doc_id if r.doc_id is not None else -(10**9), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(map(tuple, token_store.read_document(spark, path, 4))) == sorted(tuple([*whole(r.text), 2]) for r in odd.collect() if r.doc_id == 4)
    assert token_store.read_document(spark, path, 77) == []
    # In a block that begins with a null id.
    assert token_store.read_document(spark, path, -9) == [[*whole("a\x1cb\x0bc,.d"), 2]]


def test_store_of_an_empty_table(spark, make):
    path = workdir(spark)
    token_store.write_tokens(make([]), path, tokenizer=PATH)
    assert token_store.read_tokens(spark, path).count() == 0


def test_tokenizers_that_join_words_are_refused():
    with pytest.raises(ValueError, match="white space"):
        WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_segments_by_cost():
    assert [simhash.cheapest_segments(n, 4) for n in (10, 10**5, 10**7, 10**12)] == sorted((simhash.cheapest_segments(n, 4) for n in (10, 10**5, 10**7, 10**12)), reverse=True)


def test_store_dictionary_is_shared(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = workdir(spark)
    token_store.write_tokens(docs, path, tokenizer=PATH)
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert len(row.dictionary) > 1000 and {r.dict_hash for r in spark.read.parquet(f"{path}/blocks").collect()} == {row.dict_hash}
    sample = docs.limit(3).collect()
    for r in sample:
        assert token_store.read_document(spark, path, r.doc_id) == [[*whole(r.text), 2]]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=30))
def test_plan_is_whole_and_tight(counts):
    slots, n = packing.plan(counts, 50)
    bins, left = {}, dict(counts)
    for k, (length, lo, seq, off) in enumerate(slots.tolist()):
        later = slots[k + 1 :].tolist()
        hi = later[0][1] if later and later[0][0] == length else counts[length]
        for r in range(lo, hi):
            bins.setdefault(seq + r - lo, []).append((off, length))
            left[length] -= 1
    assert not any(left.values()) and set(bins) == set(range(n))
    for items in bins.values():
        at = 0
        for off, length in sorted(items):
            assert off == at
            at += length
        assert at <= 50
    gaps = []  # first-fit decreasing, item by item
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= length), None)
        if k is None:
            gaps.append(50 - length)
        else:
            gaps[k] -= length
    assert -(-sum(k * v for k, v in counts.items()) // 50) <= n <= 1.05 * len(gaps) + 1


def test_two_fit_beats_one():
    slots, n = packing.plan({6: 1, 3: 1, 2: 2}, 10)  # 6 + 3 leaves 1; 6 + 2 + 2 fills
    assert n == 2 and (slots[:, 3] + slots[:, 0]).max() == 10


def test_pack(spark, odd, make):
    got = packing.pack(odd, tokenizer=PATH, capacity=64).collect()
    by_doc = {}
    for r in got:
        assert r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 64 * r.piece
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append([*whole(r.text), 1])
    for d, wants in texts.items():
        if len(wants) == 1:
            ids = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece))
            assert np.frombuffer(ids, "<u4").tolist() == wants[0]
    assert len([r for r in got if r.doc_id == 4]) == 3
    for r in got:
        by_doc.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by_doc.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0, *(n for _, n in items)])[:-1].tolist() and sum(n for _, n in items) <= 64
    total = sum(r.length for r in got)
    assert len(by_doc) <= -(-total // 64) + 2
    seqs = packing.sequences(packing.pack(odd, tokenizer=PATH, capacity=64)).collect()
    assert sum(r.n_tokens for r in seqs) == total and all(len(r.ids) == 4 * r.n_tokens for r in seqs)
    assert packing.pack(make([]), tokenizer=PATH).count() == 0


def slow_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_as_brute_force(spark, odd, make):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.doc_id not in range(9)] + [(1000, None), (1001, "")]
    fps = {d: slow_fingerprint(t) for d, t in rows}
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r for r in simhash.near_duplicates(make(rows)).collect()}
    assert {d: r.fp % 2**64 for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == {d: find(d) for d in fps}


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_are_whole(spark, segments):
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(np.uint64(b) ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)))) for b in base for _ in range(25)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 4}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), segments=segments).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_fingerprints_are_not_broadcast(spark, odd):
    """Only frequent fingerprints go through the driver, whatever size Spark takes the others, or their look-ups, to have."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 * 2**20
    assert "Broadcast" not in plan(simhash.links(spark.range(1000).selectExpr("xxhash64(id) AS fp")))
    assert plan(simhash.near_duplicates(odd)).count("BroadcastHashJoin") == 2
    assert "Broadcast" not in plan(simhash.representatives(odd.where("doc_id <> 4")))


def test_near_duplicates_odd_rows(odd, make):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(make([])).count() == 0


def test_representatives_of_null_and_repeated_ids(spark, make):
    """One row of each class, whatever the ids: a null or shared doc_id joins no two texts and saves no copy."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    a, b, c, d, e, f = (" ".join(f"{x}{n}" for n in rng.integers(0, 10**9, 80)) for x in "abcdef")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (None, e), (None, f), (None, a), (8, f), (9, None), (None, ""), (11, c), (7, d)]
    want = [(3, a), (5, b), (7, c), (7, d), (8, f), (9, None), (None, e)]
    docs = make(rows)
    got = cp.near_duplicates(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert cp.near_duplicates(spark, make([]), None).count() == 0
