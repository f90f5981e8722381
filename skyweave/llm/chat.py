"""Conversations from reply trees: paths from root to leaf, the best of each tree, formatted with a loss mask.

Messages are nodes that name the one they answer. Self-joins of ids alone double the part of the way to the root that each message
knows, so a chain of n messages takes log2(n) of them; each round's table is written. Leaves are ranked within their tree by the
score of their path, and the rounds' tables, taken backwards, list the messages of the chosen paths. Only then do texts come in.

A formatted path is one row for each 64 of its messages, in order (`part`), so that a path of any length is no single value:

    <|im_start|>role
    text<|im_end|>

In texts a backslash is put between `<` and `|`, also where there are backslashes between them already, so that no control string
stands in a text and the original can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, release, save, table, workdir

START, END = "<|im_start|>", "<|im_end|>"
PART_MESSAGES = 64
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


# paths


def _rounds(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For links (uid, parent, score), parent being the uid of a row or NULL: (uid, root, n, score) with the number and the score of the
    messages from the root; and the tables (uid, anc) of the ancestors 1, 2, 4, ... steps up. Messages on a circle, or that answer one
    there, have no root and are left out."""
    s, _ = save(links.select("uid", F.col("parent").alias("anc"), F.col("uid").alias("root"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    jumps, left = [], s.where("anc IS NOT NULL").count()
    while left:
        jumps.append(s.where("anc IS NOT NULL").select("uid", "anc"))
        up = s.select(F.col("uid").alias("anc"), F.col("anc").alias("up_anc"), F.col("root").alias("up_root"), F.col("n").alias("up_n"), F.col("score").alias("up_score"))
        on = s.where("anc IS NOT NULL").join(up, "anc").select("uid", F.col("up_anc").alias("anc"), F.col("up_root").alias("root"), (F.col("n") + F.col("up_n")).alias("n"), (F.col("score") + F.col("up_score")).alias("score"))
        s, _ = save(s.where("anc IS NULL").unionByName(on))
        before, left = left, s.where("anc IS NOT NULL").count()
        if left == before:  # a round brings some to their root, if any has one
            break
    return s.where("anc IS NULL").drop("anc"), jumps


def best_paths(links: DataFrame, k: int = 1) -> DataFrame:
    """(path, uid, pos, score): the messages of the k best paths of each tree, path being the leaf's uid, pos counting from the root and
    score that of the way to the message.

    The score of a path is the sum of its messages' (NULL: 0); equal ones are ranked by length, longest first, then by the leaf's uid.
    """
    whole, jumps = _rounds(links)
    leaves = whole.join(links.where("parent IS NOT NULL").select(F.col("parent").alias("uid")).distinct(), "uid", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), F.desc("n"), "uid"))
    on, _ = save(leaves.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("uid").alias("path"), "uid"))
    for up in reversed(jumps):
        # Every ancestor is reached in one way: by the powers of two that make up its distance, greatest first.
        on, _ = save(on.unionByName(on.join(up, "uid").select("path", F.col("anc").alias("uid"))))
    return on.join(whole.select("uid", (F.col("n") - 1).alias("pos"), "score"), "uid")


def reply_trees(messages: DataFrame) -> DataFrame:
    """(uid, parent, score, conv_id, message_id) of messages (conv_id, message_id, parent_id, score), written.

    A message whose parent_id is NULL or names no message of its conversation is a root. Of messages with one id in a conversation the
    one with the first parent_id (NULL first), then the highest score, counts; messages with NULL ids can't be answered, and all count.
    """
    own = messages.select("conv_id", "message_id", "parent_id", F.col("score").cast("double").alias("score"))
    first = Window.partitionBy("conv_id", "message_id").orderBy(F.col("parent_id").asc_nulls_first(), F.desc("score"))
    once = own.where("message_id IS NOT NULL").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    nodes, _ = save(once.unionByName(own.where("message_id IS NULL")).withColumn("uid", F.monotonically_increasing_id()))
    up = nodes.where("message_id IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), F.col("uid").alias("parent"))
    out, _ = save(nodes.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("m")), "left").select("uid", "parent", "score", "conv_id", "message_id"))
    return out


def chosen_messages(messages: DataFrame, k: int = 1) -> DataFrame:
    """conv_id, path, pos, role, text: messages (conv_id, message_id, parent_id, role, text, score) of the k best paths of each tree."""
    trees = reply_trees(messages)
    placed = best_paths(trees, k).join(trees.where("message_id IS NOT NULL").select("uid", "conv_id", "message_id"), "uid")
    first = Window.partitionBy("conv_id", "message_id").orderBy(F.col("parent_id").asc_nulls_first(), F.desc("score"))
    texts = messages.where("message_id IS NOT NULL").withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), "role", "text")
    return placed.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message_id") == F.col("m"))).select("conv_id", "path", "pos", "role", "text")


def turn_chains(turns: DataFrame) -> DataFrame:
    """conv_id, path, pos, role, text of rows (conv_id, turn, role, text): each row answers the one before it in its conversation, so a
    conversation is a tree of one path. Rows of one turn (NULL first) are in order of role and of a hash of their text; equal rows all count.

    Order and paths are made of keys and hashes; texts move once, to their places.
    """
    key = ["conv_id", "turn", "role", "h"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("double").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    own = rows.groupBy(*key).agg(F.count("*").alias("times"))
    # The id is (range, place in it), so the row before has the id below, or is the last of the ranges before.
    own = own.repartitionByRange(partitions(turns.sparkSession), *key).sortWithinPartitions(*key)
    own, _ = save(own.withColumn("uid", F.monotonically_increasing_id()))
    split = lambda c: F.shiftright(c, 33)
    ends = own.groupBy(split(F.col("uid")).alias("b")).agg(F.max("uid").alias("last"))  # a row a range
    ends = ends.select(F.lead("b").over(Window.orderBy("b")).alias("b"), F.col("last").alias("before"))
    before = own.withColumn("b", split(F.col("uid"))).join(F.broadcast(ends), "b", "left").select("uid", "conv_id", F.when(F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.col("before")).otherwise(F.col("uid") - 1).alias("before"))
    up = own.select(F.col("uid").alias("before"), F.col("conv_id").alias("c"))
    # A chain has one path, so its score may count: rows up to and with this one.
    links = before.join(up, "before", "left").select("uid", F.when(F.col("conv_id").eqNullSafe(F.col("c")), F.col("before")).alias("parent"))
    links, _ = save(links.join(own.select("uid", F.col("times").alias("score")), "uid"))
    placed, _ = save(best_paths(links).join(own, "uid").withColumn("pos", F.col("score").cast("long") - F.col("times")).drop("uid", "score"))
    met = rows.alias("r").join(placed.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & F.col("r.turn").eqNullSafe(F.col("p.turn")) & (F.col("r.role") == F.col("p.role")) & (F.col("r.h") == F.col("p.h")))
    met, out = met.select("r.conv_id", "path", "pos", "r.role", "r.text", "times"), ["conv_id", "path", "pos", "role", "text"]
    if placed.where("times > 1").isEmpty():
        return met.select(*out)
    # Of equal rows one is taken and repeated at as many places.
    again = met.where("times > 1").dropDuplicates(["path", "pos"]).withColumn("pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("times") - 1)))
    return met.where("times = 1").unionByName(again).select(*out)


# format


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """A role without line ends and `<`."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def formatted(chosen: DataFrame) -> DataFrame:
    """conv_id, path, part, formatted, loss: the paths of `chosen` (conv_id, path, pos, role, text) in rows of 64 messages. loss: the spans
    (start, end) of `formatted`, in code points, that hold the escaped texts of the assistant. Null roles and texts are empty."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    m = F.struct("pos", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("own"))
    out = chosen.select("conv_id", "path", F.floor(F.col("pos") / PART_MESSAGES).alias("part"), m.alias("m")).groupBy("conv_id", "path", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    size = lambda x: F.length(x["head"]) + F.length(x["text"]) + len(END) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def on(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["head"])
        span = F.struct(at.alias("start"), (at + F.length(x["text"])).alias("end"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["text"], F.lit(END + "\n"))), "")
    return out.select("conv_id", "path", "part", whole.alias("formatted"), F.aggregate("m", start, on)["spans"].alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) of each message of a formatted row."""
    out = []
    for piece in text.split(END + "\n")[:-1]:
        if not piece.startswith(START):
            raise ValueError("a message does not begin with its control string")
        role, _, own = piece[len(START) :].partition("\n")
        out.append((unescape_role(role), unescape(own)))
    return out


def digests(rows: DataFrame) -> DataFrame:
    """A row a path, read from formatted rows: DIGEST. A path's rows pass one task in order, one by one; nothing of them is kept but the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, n, chars, own = None, None, None, 0, 0, 0

        def out() -> pa.RecordBatch:
            row = (now[0], n, turns.hexdigest(), own, loss.hexdigest(), chars)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=[f.split()[0] for f in DIGEST.split(", ")])

        for b in batches:
            for i in range(len(b)):
                r = {c: b.column(c)[i].as_py() for c in ("conv_id", "path", "formatted", "loss")}
                if now != (r["conv_id"], r["path"]):
                    if now is not None:
                        yield out()
                    now, turns, loss, n, chars, own = (r["conv_id"], r["path"]), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in parse(r["formatted"]):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in r["loss"]:
                    text = unescape(r["formatted"][s["start"] : s["end"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    own += len(text)
                chars += len(r["formatted"])
        if now is not None:
            yield out()

    return rows.repartition(partitions(rows.sparkSession), "conv_id", "path").sortWithinPartitions("conv_id", "path", "part").mapInArrow(run, DIGEST)


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    path = workdir(spark)
    formatted(turn_chains(turns.unionByName(more))).write.option("compression", "zstd").parquet(path)
    release(spark)
    return digests(spark.read.parquet(path))


_ESCAPED = r"regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')"
OP12_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok')
 SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum({len(START) + len(END) + 2} + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l')) + length({_ESCAPED}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""
