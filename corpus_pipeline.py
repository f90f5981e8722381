"""From raw documents to packed training sequences.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which the next one gets as
docs. All but the last return the columns of docs. run() writes each stage's rows to the shared folder and reads them again, so
a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import decontam, langid, packing, secret_scan, simhash
from skyweave.llm.common import release, save, table

#: Documents whose language is less certain are rejected.
LEAST_LANGUAGE_SCORE = 0.5

#: Trained models and alignments are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found; without letters, or without a likely language, they go. If no row has a
    language to learn from, all documents with a letter stay."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(langid.learnable(F.col("doc_id"))), path)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model, path, least_score=LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that of smallest doc_id; rows with null or repeated ids are judged by their text."""
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item, exact or edited."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark; all documents stay."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    packed = packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = save(docs)
            release(spark)  # the stage's shuffle files and broadcasts
    return docs
