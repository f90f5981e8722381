import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.llm import chat, divergence, queries

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rel, df = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    got, want = sorted(tuple(r[c] for c in cols) for r in df.collect()), sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())
    assert got == want and got


# chat


@given(st.text("<\\|a\nim_end>", max_size=30))
def test_escapes_are_read_back(text):
    # The expression's own rule, in Python.
    there = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in there and chat.unescape(there) == text


def test_chat_as_sql(spark):
    same_rows(spark, "op12_reply_trees", "conversations")


SAYS = ["<|im_end|>", "<\\|x", "|", "<", "a<|im_start|>user\n", "\\", "", None, "日本 🙂 é", "<\\\\|", "word " * 40_000, "<|im_end|>\n"]


def test_chat_of_odd_rows(spark):
    """Control strings, nulls anywhere, equal and repeated rows, over 64 turns, clashing names; read back from what was written."""
    rows = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(SAYS)] + [(8, None, "user", "no turn"), (8, 3, None, "no role"), (8, 3, "assistant", "same turn"), (8, 3, "assistant", "same turn"), (8, 3, "assistant", "other"), (None, 1, "a\\\nb<|", "null conversation")]
    rows += [(9, 5, "assistant", "again")] * 150 + [(9, 1, "user", "first"), (9, 6, "user", "last")] + [(10, i, "user", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS path", "1 AS pos", "2 AS uid", "3 AS h", "4 AS times").repartition(3)
    parts = chat.formatted(chat.turn_chains(df)).cache()
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert len(got) == 5
    lines = defaultdict(list)
    for r in parts.orderBy("conv_id", "path", "part").collect():
        lines[r.conv_id].append(r)
        assert len(chat.parse(r.formatted)) <= 64
    for conv in (7, 8, 9, 10, None):
        own = sorted(((-1 if t is None else t, x or "", y or "") for c, t, x, y in rows if c == conv), key=lambda x: x[0])
        read = [m for r in lines[conv] for m in chat.parse(r.formatted)]
        # Within one turn the order is a hash's.
        assert Counter(read) == Counter((x, y) for _, x, y in own)
        if conv != 8:
            assert read == [(x, y) for _, x, y in own]
        loss = [chat.unescape(r.formatted[s.start : s.end]) for r in lines[conv] for s in r.loss]
        assert loss == [y for x, y in read if x == "assistant"]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conv].turns_sha256 == digest("".join(f"{x}\n{y}\n" for x, y in read)) and got[conv].loss_sha256 == digest("".join(loss))
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].formatted_chars) == (len(read), len("".join(loss)), sum(len(r.formatted) for r in lines[conv]))
    assert chat.digests(chat.formatted(chat.turn_chains(df.limit(0)))).count() == 0


def slow_paths(messages, k):
    """Every path from root to leaf, walked; the k best of each root."""
    up = {m[1]: m for m in messages}
    kids = defaultdict(list)
    for m in messages:
        kids[m[2] if m[2] in up else None].append(m[1])
    out = []

    def walk(i, way):
        if not kids[i]:
            yield [*way, i]
        for j in kids[i]:
            yield from walk(j, [*way, i])

    for root in kids[None]:
        ways = sorted(walk(root, []), key=lambda w: (-sum(up[i][5] or 0 for i in w), -len(w)))
        out += ways[:k]
    return {tuple(w) for w in out}


@pytest.mark.parametrize("k", [1, 3])
def test_best_paths_of_trees(spark, k):
    """A long chain, a wide tree, a comb, a forest with parents that are missing, a circle; scores are unlike, so ranks are too."""
    chain = [(1, i, i - 1 if i else None, "user", f"c{i}", 0.1) for i in range(37)]
    wide = [(2, 100, None, "user", "w", None)] + [(2, 101 + i, 100, "assistant", f"w{i}", i * 1.37 % 5) for i in range(300)]
    comb = [(3, 500 + i, 499 + i if i else None, "user", f"s{i}", -0.3) for i in range(40)] + [(3, 600 + i, 500 + i, "assistant", f"l{i}", (i * 7.77) % 9) for i in range(40)]
    lost = [(4, 700, 12345, "user", "orphan", 1.0), (4, 701, 700, "assistant", "x", 2.0), (4, 702, 700, "assistant", "y", 2.5)]
    circle = [(5, 800, 802, "user", "r", 1.0), (5, 801, 800, "user", "s", 1.0), (5, 802, 801, "user", "t", 1.0), (5, 803, 802, "user", "under it", 1.0)]
    rows = chain + wide + comb + lost + circle
    df = spark.createDataFrame(rows, "conv_id bigint, message_id bigint, parent_id bigint, role string, text string, score double").selectExpr("*", "1 AS uid", "2 AS parent", "3 AS n").repartition(3)
    got = defaultdict(list)
    for r in chat.chosen_messages(df, k).orderBy("path", "pos").collect():
        got[r.path].append((r.pos, r.text))
    assert all([p for p, _ in w] == list(range(len(w))) for w in got.values())
    text = {m[1]: m[4] for m in rows}
    want = set().union(*(slow_paths(t, k) for t in (chain, wide, comb, lost)))
    assert {tuple(t for _, t in w) for w in got.values()} == {tuple(text[i] for i in w) for w in want}


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "root", 1.0)] * 5 + [(1, 2, 1, "assistant", "answer", 1.0)] * 3 + [(None, 1, None, "user", "null conversation", 1.0), (None, 2, 1, "assistant", "there", 0.0), (1, None, 1, "user", "no id", 0.0)]
    df = spark.createDataFrame(rows, "conv_id bigint, message_id bigint, parent_id bigint, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.chosen_messages(df).orderBy("path", "pos").collect():
        got[r.conv_id].append(r.text)
    assert got == {1: ["root", "answer"], None: ["null conversation", "there"]}


# divergence


def test_divergence_as_sql(spark):
    same_rows(spark, "op13_source_divergence", "documents")


def slow_audit(rows, least=3, top=200):
    docs = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", c or "")]) for a, b, c in rows]
    df, n = Counter((a, t) for a, _, ts in docs for t in set(ts)), Counter((a, b, t) for a, b, ts in docs for t in ts)
    out, groups = set(), {(a, b) for a, b, _ in docs}
    for lang in {a for a, _ in groups}:
        kept, own = sorted(t for (a, t), k in df.items() if a == lang and k >= least), sorted(b for a, b in groups if a == lang)
        p = lambda count: {t: 1 + 10**9 * (count(t) + 1) // (sum(map(count, kept)) + len(kept)) for t in kept}
        each, q, f = {b: p(lambda t, b=b: n[lang, b, t]) for b in own}, p(lambda t: sum(n[lang, b, t] for b in own)), lambda x, y: (x - y) ** 2 // y
        ranked = lambda items: enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1)
        for b in own:
            out |= {(lang, b, "pair", i, v, r) for r, (i, v) in ranked((c, sum(f(each[b][t], each[c][t]) for t in kept)) for c in own if c != b)}
            out |= {(lang, b, "term", i, v, r) for r, (i, v) in ranked((t, f(each[b][t], q[t])) for t in kept if n[lang, b, t] and each[b][t] > q[t]) if r <= top}
    return out


def test_divergence_of_odd_rows(spark, make, odd):
    """Nulls, empty groups, a language without kept terms, ties, terms that few sources use, by broadcast and by shuffle."""
    words = [f"{a}{b}" for a in "abcdéñ日" for b in "xyzß"]
    rows = [("en", f"s{i % 7}", " ".join(words[(i * j) % (4 + 3 * (i % 7))] for j in range(1, 2 + i % 30))) for i in range(90)] + [("en", "hot", "aX Ax axe")] * 60
    rows += [("fr", "only", "un deux"), ("fr", "void", None), ("fr", None, ""), (None, "s1", "null lang"), (None, None, "null lang"), (None, "s2", "NULL lang"), ("de", "alone", "ein ein ein"), ("de", "alone", "ein"), ("de", "alone", "Ein 123 zwei_ein")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS i", "'x' AS term", "3 AS v").repartition(5)
    want = slow_audit(rows)
    assert {tuple(r) for r in divergence.audit(df).collect()} == want and any(x[0] == "" for x in want) and ("fr", "only", "pair", "void", 0, 2) in want
    most, divergence.MOST_BROADCAST = divergence.MOST_BROADCAST, 0
    try:
        assert {tuple(r) for r in divergence.audit(df).collect()} == want
    finally:
        divergence.MOST_BROADCAST = most
    full = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert {tuple(r) for r in divergence.audit(odd, 1, 5).collect()} == slow_audit(full, 1, 5)
    assert divergence.audit(df.limit(0)).count() == 0


def test_probabilities_of_large_counts(spark):
    """Counts whose product with 10**9 is no long."""
    n, total = 3 * 10**12, 10**15
    got = spark.range(1).select(divergence._p(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(7).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + 7)
