"""How the sources of a language differ: wide term vectors and the contributions of pairs.

Each kept term of a language is one row, whose vector holds a count for each source that uses it, ordered by the source's place among
the language's sources; sources that don't use it are its zeros and are not stored. Higher-order functions turn counts into
probabilities and emit a row for each pair of sources that both use the term, with what both ways contribute; sums are partial before
they move. What a pair owes to terms that one of its sources lacks depends on a count and on a source alone, so it comes from the
number of terms of each count, and what it owes to terms that both lack is one number. Thus a term costs the square of the sources
that use it, not of all sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of so many groups, some 100 bytes each, is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Terms shown of a group, by the contract.
TOP = 200

#: What bytes of UTF-8 become: A-Z lower case, all other ASCII but a-z a space.
LETTERS = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n bigint, df bigint"


def terms(text: bytes, stretch: int = 1 << 22) -> Iterator[list[bytes]]:
    """The runs of letters of a text in UTF-8, of which only A-Z are lower-cased and all that is not ASCII is a letter; long texts in parts."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + stretch)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, df): occurrences and rows of documents, null lang, source and text being ''. Tasks send their counts of
    `most` terms at a time, which are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*g, t, k, df[t]) for g, (n, df) in held.items() for t, k in n.items()]
            held.clear()
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["lang", "source", "term", "n", "df"])

        for b in slices(batches, 100):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for some in terms(text.as_py()):
                    n.update(some)
                    seen.update(some)
                df.update(seen)
                size += len(n) - before
                if size >= most:
                    yield out()
                    size = 0
        yield out()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _p(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + v)) of longs, exactly."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), (total + v).cast("decimal(19,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def vectors(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(lang, term, total, v: [(i, n)]) of the terms in at least least_docs documents of a language, and (lang, i, source) of all
    groups that occur, i being the source's place in order; both written. And the number of groups."""
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups, _ = save(names.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    n_groups = groups.count()
    counts = term_counts(docs).join(_small(groups, n_groups), ["lang", "source"])
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("v"))
    kept, _ = save(wide.where(F.col("df") >= least_docs).drop("df"))
    return kept, groups, n_groups


def audit(docs: DataFrame, least_docs: int = 3, top: int | None = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: item is each other source of the language, value the sum over all kept terms of (p - q)**2 / q, each rounded down,
    where p and q are the terms' shares of the two sources in billionths, counts raised by one. Part `term`: item is each term that
    the source uses more than its language does, value its own such summand; the first `top`, all if None. Ranks are by value
    descending, then item in UTF-8 order.

    Defined cases: null lang, source or text: ''; a group without terms: counts of zero; a language without kept terms: its pairs
    have value 0; empty table: no rows; repeated rows: each is a document; doc_id and other columns are ignored.
    """
    kept, groups, n_groups = vectors(docs, least_docs)
    entries = kept.select("lang", "term", F.explode("v").alias("e")).select("lang", "term", F.col("e.i").alias("i"), F.col("e.n").alias("n"))
    # How many terms of a group have each count: sums of counts, and all that terms lacking in another source owe to it.
    by_count, _ = save(entries.groupBy("lang", "i", "n").agg(F.count("*").alias("m")))
    own = by_count.groupBy("lang", "i").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("used"))
    own = groups.join(own, ["lang", "i"], "left").fillna(0, ["total", "used"])
    whole = kept.groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("total").alias("kept_total"))
    langs = own.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "total", "used", "source"))).alias("g")).join(whole, "lang", "left").fillna(0, ["kept_terms", "kept_total"])
    langs = langs.withColumn("p0", F.when(F.col("kept_terms") > 0, F.transform("g", lambda x: _p(F.lit(0).cast("long"), x["total"], F.col("kept_terms")))))
    langs, _ = save(langs)  # a row a language
    by_lang = _small(langs, n_groups)
    at = lambda a, i: F.element_at(a, i + 1)

    # Terms that both sources use.
    p = F.transform("v", lambda e: F.struct(e["i"].alias("i"), _p(e["n"], at(F.col("g"), e["i"])["total"], F.col("kept_terms")).alias("p"), at(F.col("p0"), e["i"]).alias("z")))
    both = kept.join(by_lang, "lang").select("lang", p.alias("v")).select("lang", F.explode("v").alias("a"), "v")
    both = both.select("lang", "a", F.explode(F.filter("v", lambda b: b["i"] > F.col("a.i"))).alias("b"))
    both = both.select("lang", F.col("a.i").alias("i"), F.col("b.i").alias("j"), *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in "pz"])
    more = lambda x, y: F.sum(_f(F.col(f"p_{x}"), F.col(f"p_{y}")) - _f(F.col(f"p_{x}"), F.col(f"z_{y}")) - _f(F.col(f"z_{x}"), F.col(f"p_{y}")) + _f(F.col(f"z_{x}"), F.col(f"z_{y}")))
    both = both.groupBy("lang", "i", "j").agg(more("a", "b").alias("there"), more("b", "a").alias("back"))
    both = both.select("lang", F.explode(F.array(F.struct("i", "j", F.col("there").alias("f")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("f")))).alias("x"))
    parts = [both.select("lang", "x.i", "x.j", "x.f")]

    # Terms of a source, as if the other lacked them all.
    one = by_count.join(by_lang, "lang").select("lang", "i", "m", "p0", _p(F.col("n"), at(F.col("g"), F.col("i"))["total"], F.col("kept_terms")).alias("p"))
    one = one.select("lang", "i", "m", "p", F.posexplode("p0").alias("j", "z")).where("i <> j")
    parts.append(one.select("lang", "i", "j", (F.col("m") * _f(F.col("p"), F.col("z"))).alias("f")))
    parts.append(one.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), (F.col("m") * _f(F.col("z"), F.col("p"))).alias("f")))

    # Terms that both lack, by the same token.
    none = langs.select("lang", "kept_terms", "g", "p0", F.posexplode("g").alias("i", "x")).select("lang", "kept_terms", "p0", "i", F.col("x.used").alias("k"), F.posexplode("g").alias("j", "y")).where("i <> j")
    f0 = F.when(F.col("kept_terms") > 0, (F.col("kept_terms") - F.col("k") - F.col("y.used")) * _f(at(F.col("p0"), F.col("i")), at(F.col("p0"), F.col("j")))).otherwise(F.lit(0))
    parts.append(none.select("lang", "i", "j", f0.cast("long").alias("f")))

    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    name = lambda c, to: _small(groups, n_groups).select("lang", F.col("i").alias(c), F.col("source").alias(to))
    pairs = pairs.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    # Terms of a source beside its language.
    used = kept.join(by_lang, "lang").select("lang", "term", F.explode(F.transform("v", lambda e: F.struct(at(F.col("g"), e["i"])["source"].alias("source"), _p(e["n"], at(F.col("g"), e["i"])["total"], F.col("kept_terms")).alias("p")))).alias("e"), _p(F.col("total"), F.col("kept_total"), F.col("kept_terms")).alias("q"))
    used = used.where(F.col("e.p") > F.col("q")).select("lang", F.col("e.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("e.p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    used = used.withColumn("rank", rank)
    return pairs.withColumn("rank", rank).unionByName(used if top is None else used.where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of sources and every kept term, zeros too. p and q are hugeint throughout.
OP13_SQL = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
 k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
 m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM m),
 l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM m GROUP BY ALL),
 q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
