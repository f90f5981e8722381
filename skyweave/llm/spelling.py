"""Words that differ by one code point, by Aho-Corasick automata of their halves, and the frequent form of each.

Of two words one edit apart, one has an intact half in the other: its first half where that word begins, or its second where it ends.
A word is thus sought by its own length and the next, at either end, and stands under its own two halves. Automata are dealt by the
kind of half (end, length of its word) and its first code points: a shard's automaton holds the halves of the words dealt to it, all
words that may hold such a half are scanned there, offsets and lengths are compared, and the distance is verified.

A half that very many words share is no pattern for a shard: of these words, what is left beside the half is halved again, and the
same is done with the rests, within that half. Rests of one code point are as many as the alphabet, which ends it.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, save, table

RUN = r"[A-Za-zÀ-ÿ]+"
#: Fixed values of the contract: a run is changed where 31 divides its hash; words have 7 code points and 2 occurrences; a form is 10 times as frequent.
CHANGED, LEAST_LENGTH, LEAST_COUNT, TIMES = 31, 7, 2, 10
#: More rows that share a half are halved again; more rows that share a half's beginning are dealt by the whole half.
MOST_SHARED, MOST_DEALT = 256, 4096
SHARD_ROWS = 20_000
PAIRS = "word string, n bigint, near string, near_n bigint"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents' texts (null: none), with the changes that the contract makes. A null doc_id is written as nothing."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("w"))
    # A change takes one code point away, so shorter runs give no word.
    runs = runs.where(F.length("w") >= LEAST_LENGTH).select("d", F.translate("w", UPPER, LOWER).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    out = runs.withColumn("h", h).select(F.when(F.col("h") % CHANGED == 0, cut).otherwise(F.col("w")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return out.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _halves(rests: DataFrame) -> DataFrame:
    """Rows (ctx, word, n, rest) as (ctx, word, n, rest, side, size, seg, holds): the half `seg` at the end `side` of a rest of `size` code
    points; holds: the rest is that long itself, so the half is its own."""
    size, out = F.length("rest"), []
    for more in (0, 1):
        whole = size + more
        first = F.floor(whole / 2).cast("int")
        for side in (0, 1):
            own = F.substring(F.col("rest"), F.lit(1), first) if side == 0 else F.substring(F.col("rest"), size - (whole - first) + 1, whole - first)
            fits = size >= (first if side == 0 else whole - first)
            out.append(F.when(fits, F.struct(F.lit(side).alias("side"), whole.alias("size"), own.alias("seg"), F.lit(more == 0).alias("holds"))))
    rows = rests.select("ctx", "word", "n", "rest", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("x")).select("ctx", "word", "n", "rest", "x.*")
    return rows.withColumn("key", F.xxhash64("ctx", "side", "size", "seg"))


def _matches(rows: list[tuple]) -> tuple[list, list, list, list]:
    """Pairs, both ways, of a shard's rows (ctx, word, n, rest, side, size, seg, holds)."""
    import ahocorasick

    auto, held = ahocorasick.Automaton(), {}
    for ctx, word, n, rest, side, size, seg, holds in rows:
        if holds:
            held.setdefault(seg, {}).setdefault((ctx, side, size), set()).add((word, n))
    for seg, at in held.items():
        if seg:
            auto.add_word(seg, (len(seg), at))
    auto.make_automaton()
    found: set[tuple] = set()
    # A rest is scanned once in a shard, whatever it was dealt for.
    scanned: dict[tuple, set] = {}
    for ctx, word, n, rest, side, size, seg, holds in rows:
        scanned.setdefault((ctx, word, n, rest), set()).add((side, size))
    for (ctx, word, n, rest), asked in scanned.items():
        if not rest:
            hits = iter(())
        else:
            hits = auto.iter(rest) if len(auto) else iter(())
        last = len(rest) - 1
        ends = [(end - length + 1, end, at) for end, (length, at) in hits]
        if "" in held:
            ends.append((0, last, held[""]))
        for start, end, at in ends:
            for side, size in asked:
                # The half must stand at its own end of the word.
                if (start == 0 if side == 0 else end == last) and (near := at.get((ctx, side, size))):
                    for other, m in near:
                        if (len(other) > len(word) or other > word) and one_edit(word, other):
                            found.add((word, n, other, m))
    a, b = [*found], [(o, m, w, n) for w, n, o, m in found]
    return tuple(list(c) for c in zip(*a, *b)) if a else ([], [], [], [])


def near_pairs(vocabulary: DataFrame, most_shared: int = MOST_SHARED, most_dealt: int = MOST_DEALT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, near, near_n) of all words of `vocabulary` (word, n; words distinct) that are one edit apart, each both ways and once."""
    rests, out = vocabulary.select(F.lit(0).cast("long").alias("ctx"), "word", "n", F.col("word").alias("rest")), None
    while True:
        rows = _halves(rests)
        begins = F.xxhash64("ctx", "side", "size", F.substring("seg", 1, 3))
        keys = rows.groupBy("key", begins.alias("deal"), (F.col("size") > 2).alias("long")).agg(F.count("*").alias("all"), F.sum(F.col("holds").cast("long")).alias("own"))
        # A half that no word has, or one alone, makes no pair.
        keys = keys.where("own > 0 AND all > 1").withColumn("again", F.col("long") & (F.col("all") > most_shared))
        keys, _ = save(keys.select("key", "deal", "all", "again"))
        deals = keys.where("NOT again").groupBy("deal").agg(F.sum("all").alias("dealt")).where(F.col("dealt") > most_dealt).select("deal", F.lit(True).alias("whole"))
        total = keys.where("NOT again").agg(F.sum("all")).first()[0] or 0
        shards = max(1, math.ceil(total / shard_rows))
        placed = keys.where("NOT again").join(deals, "deal", "left").select("key", F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("key")).otherwise(F.col("deal"))), F.lit(shards)).alias("shard"))

        def match(t: pa.Table) -> pa.Table:
            got = _matches(list(zip(*[t.column(c).to_pylist() for c in ("ctx", "word", "n", "rest", "side", "size", "seg", "holds")])))
            return pa.table(dict(zip(("word", "n", "near", "near_n"), [pa.array(c, k) for c, k in zip(got, (pa.string(), pa.int64(), pa.string(), pa.int64()))])))

        pairs = rows.join(placed, "key").groupBy("shard").applyInArrow(match, PAIRS)
        done, _ = save(pairs)
        out = done if out is None else out.unionByName(done)
        again = keys.where("again").select("key")
        if again.isEmpty():
            break
        half = F.length("seg")
        left = F.when(F.col("side") == 0, F.substring(F.col("rest"), half + 1, F.length("rest"))).otherwise(F.substring(F.col("rest"), F.lit(1), F.length("rest") - half))
        rests, _ = save(rows.join(again, "key").select(F.col("key").alias("ctx"), "word", "n", left.alias("rest")))
        release(rests.sparkSession)
    return out.dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the way over forms, by joins that double the part of it that each word knows. Counts rise
    along it at least tenfold, so there is no circle and the rounds are few."""
    s, _ = save(forms.select("word", F.col("form").alias("root")))
    while True:
        up = s.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        met, _ = save(s.join(up, "root", "left").select("word", "root", "beyond"))
        if met.where("beyond IS NOT NULL").isEmpty():
            return s
        s = met.select("word", F.coalesce("beyond", "root").alias("root"))


def variants(vocabulary: DataFrame, times: int = TIMES, **limits) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `vocabulary` (word, n).

    form: of the words one edit away the most frequent (ties: first in code-point order) if it is `times` as frequent as the word, else
    NULL. root: from the word over forms to the last. Words are code points as they are; an empty vocabulary gives no rows.
    """
    vocabulary, _ = save(vocabulary.select("word", "n"))
    near = near_pairs(vocabulary, **limits)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best, _ = save(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n")))
    forms, _ = save(vocabulary.join(best, "word").where(F.col("near_n") >= times * F.col("n")).select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    out = vocabulary.join(best.select("word", "n_near"), "word", "left").join(forms.join(roots(forms), "word"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined cases of the documents: null or empty text: no words; repeated rows: each counts; null doc_id: hashed as ''."""
    return variants(words(table(spark, sf_dir, "documents")))
