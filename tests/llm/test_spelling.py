import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skyweave.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def slow_words(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def slow_near(words):
    """By what each word is with any one code point taken out or masked."""
    masked, out = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                out[w].add(short)
                out[short].add(w)
    for ws in masked.values():
        for a, b in itertools.permutations(ws, 2):
            out[a].add(b)
    return out


def slow_variants(n, times=10):
    near, form, rows = slow_near(n), {}, set()
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return rows


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_edit(a, b):
    edits = {b[:i] + b[i + 1 :] for i in range(len(b))} | {b[:i] + c + b[i + k :] for i in range(len(b) + 1) for c in "ab" for k in (0, 1)}
    assert spelling.one_edit(a, b) == (a != b and a in edits)


def test_spelling_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()]
    want = slow_variants(slow_words(rows))
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_words_of_odd_documents(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {r.word: r.n for r in spelling.words(odd).collect()} == slow_words(rows)
    many = spark.createDataFrame([(i % 40 or None, "Naïveté ÀÉÎÕÜß÷×ÿ bookkeeper Bookkeepers x" * 3, "w") for i in range(200)], "doc_id bigint, text string, word string")
    got = {r.word: r.n for r in spelling.words(many).collect()}
    assert got == slow_words([(r.doc_id, r.text) for r in many.collect()]) and len(got) > 5  # some runs were changed


@pytest.mark.parametrize("limits", [{}, {"most_shared": 8, "most_dealt": 20, "shard_rows": 50}])
def test_variants_of_crowded_words(spark, limits):
    """Halves that many words share, very short and very long words, other scripts, ties, chains of forms; with small limits halves are
    halved again, until one code point is left."""
    n = {}
    for i, t in enumerate(itertools.product("abc", repeat=5)):
        n["common" + "".join(t)] = 1 + i % 7
    for t in itertools.product("abcd", repeat=3):
        n["".join(t) + "shared"] = 2
    n |= {"": 3, "a": 50, "ab": 600, "b": 50, "é": 700, "x" * 3000: 5, "x" * 3001: 70, "x" * 2999 + "y": 70, "日本語": 2, "日本": 40, "日本人": 40, "🙂🙂": 1, "🙂": 20}
    n |= {"chainaaaa": 1, "chainaaab": 10, "chainaabb": 100, "chainabbb": 1000, "mississippi": 1, "missisippi": 9, "mississippis": 10, "aaaaaaa": 3, "aaaaaaaa": 30}
    df = spark.createDataFrame([*n.items()], "word string, n bigint").selectExpr("*", "1 AS ctx", "'x' AS rest").repartition(4)
    got = [tuple(r) for r in spelling.variants(df, **limits).collect()]
    want = slow_variants(n)
    assert len(got) == len(want) and set(got) == want
    assert next(r for r in want if r[0] == "chainaaaa")[2] == "chainabbb"


def test_no_words(spark):
    df = spark.createDataFrame([], "word string, n bigint")
    assert spelling.variants(df).count() == 0
