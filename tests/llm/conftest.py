import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names operators use themselves.
CLASHES = ("block", "ids", "length", "size", "part", "root", "start", "fp", "key", "score", "shard", "bucket")


@pytest.fixture(scope="session")
def make(spark):
    """make(rows of (doc_id, text[, lang])): documents with extra columns of clashing names."""

    def go(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
        return df

    return go


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty, blank, repeated, very long and non-Latin texts."""
    return make([(None, "null id here today"), (1, None), (2, ""), (3, "  \n\t "), (4, "Hello, World's end!"), (4, "Hello, World's end!"), (4, "other text, same id"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "<|endoftext|> and <|ENDOFTEXT|>"), (8, "Ünïcode ÇA ΣΊΣΥΦΟΣ İstanbul é  nbsp em 日本語 🙂"), (-9, "a\x1cb\x0bc,.d")])
