"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that tags words.

The field tags each white-space separated word as outside (O), begin (B) or inside (I) of a secret,
from its shape, the words beside it and features of the whole text, decoded by Viterbi. It learns from
what the patterns find in a bounded sample and adds spans of like shape and surroundings.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, slices, smallest_hashes, table

#: The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that Viterbi runs over at a time.
BATCH_WORDS = 1 << 18
#: Words that a worker remembers at most, some 250 bytes each.
REMEMBERED_WORDS = 250_000
KINDS = ("assign", "access", "hex", "crf")

_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|auth|bearer|credential|private|access|key", re.IGNORECASE)
_VALUE = re.compile(r"[A-Za-z0-9+/_.=~-]{6,}")
_WORD = re.compile(r"\S+")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), sorted; kind indexes KINDS. Cheap tests of the whole text pass over texts without any."""
    raw = text.encode("utf-8", "surrogatepass")
    low, out = raw.lower(), []
    if any(k.encode() in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 24 covers eight consecutive of every third byte.
    third = _IS_HEX[np.frombuffer(raw, np.uint8)[::3]].astype(np.int8)
    if len(third) >= 8:
        sums = np.cumsum(np.concatenate([[0], third]), dtype=np.int64)
        if (sums[8:] - sums[:-8]).max() == 8:
            out += [(m.start(), 2, m.end(), m.start()) for m in _HEX_RUN.finditer(text)]
    return sorted(out)


def shape(word: str) -> tuple[str, ...]:
    """Features of one word."""
    bare = word.strip(".,;:!?\"'()[]{}<>|*#$%&")
    if bare.isalpha() and not _KEY.search(bare):
        return ("prose", f"len{min(len(bare) // 4, 6)}", "upper" if bare.isupper() and len(bare) > 3 else "plain")
    n = max(1, len(bare))
    digits, uppers, lowers = sum(map(str.isdigit, bare)), sum(map(str.isupper, bare)), sum(map(str.islower, bare))
    f = ["mixed", f"len{min(n // 4, 12)}", f"digits{10 * digits // n}", f"upper{4 * uppers // n}", f"lower{4 * lowers // n}", f"kinds{(digits > 0) + (uppers > 0) + (lowers > 0)}", f"varied{10 * len(set(bare)) // n}"]
    if _KEY.search(bare):
        f.append("keyword")
    if re.search(r"[:=]$", word):
        f.append("assigns")
    if re.search(r"[:=].", bare):
        f.append("assigned")
    if word[:1] in "\"'`":
        f.append("quoted")
    if "@" in bare:
        f.append("at")
    if bare.count(".") >= 2 and digits and not lowers:
        f.append("dotted")
    if n >= 16 and re.fullmatch(r"[0-9a-f]+", bare) and digits < n:
        f.append("hex")
    if n >= 16 and _VALUE.fullmatch(bare) and digits and lowers + uppers > n // 4:
        f.append("dense")
    if re.match(r"AKIA|ASIA|gh[pousr]_|sk[-_]|xox|eyJ|AIza|-----BEGIN", bare):
        f.append("prefix")
    return tuple(f)


def text_features(text: str) -> tuple[str, ...]:
    """Features of the whole file: its length, how often it assigns, its share of code's punctuation, the length of its lines."""
    n = len(text) + 1
    code = sum(map(text.count, "{}();<>"))
    return (f"size{min(n.bit_length() // 2, 9)}", f"signs{min(text.count('=').bit_length(), 4)}", f"code{min(100 * code // n, 4)}", f"lines{min((n // (text.count(chr(10)) + 1)).bit_length() // 2, 5)}")


class Field:
    """Weights by feature name: own, prev and next hold {feature: [O, B, I]}, text likewise; moves[from, to]."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.forget()
        # What a word gains in moves by another tag than O: between two words, as the first and as the last. If O is ahead by more
        # everywhere, setting a word to O always gains, so the best path is O throughout.
        into, out = (moves[:, 1:] - moves[:, :1]).max(), (moves[1:] - moves[:1]).max()
        between = max(moves[a, x] + moves[x, b] - moves[a, 0] - moves[0, b] for a in range(3) for b in range(3) for x in (1, 2))
        self.sure = max(0.0, into, out, between)

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.by_shape: dict[tuple, np.ndarray] = {}
        self.rows = np.zeros((1024, 3, 3))

    def _of_shape(self, f: tuple) -> np.ndarray:
        if f not in self.by_shape:
            zero = np.zeros(3)
            self.by_shape[f] = np.array([sum((self.weights.get(f"{where}:{x}", zero) for x in f), zero) for where in ("own", "prev", "next")])
        return self.by_shape[f]

    def scores(self, texts: list[list[str]], whole: list[str]) -> list[np.ndarray]:
        """Per text, given as words and as a whole, the score of each word and tag, without moves."""
        if len(self.at) > REMEMBERED_WORDS:
            self.forget()
        new = list(set().union(*texts) - self.at.keys())
        first = len(self.at)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((first + 2 * len(new) - len(self.rows), 3, 3))])
        for i, w in enumerate(new, first):
            self.rows[i] = self._of_shape(shape(w))
            self.at[w] = i
        out, zero = [], np.zeros(3)
        for ws, text in zip(texts, whole):
            at = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
            e = self.rows[at, 0]
            e[1:] += self.rows[at[:-1], 1]
            e[:-1] += self.rows[at[1:], 2]
            out.append(e + sum((self.weights.get(f"text:{x}", zero) for x in text_features(text)), zero))
        return out

    def tag(self, texts: list[list[str]], whole: list[str] | None = None) -> list[np.ndarray | None]:
        """The best path of each text; None: O throughout. Viterbi runs over texts of like length together. whole: the texts themselves,
        by default their words with blanks between."""
        out: list[np.ndarray | None] = [None] * len(texts)
        scores = self.scores(texts, whole or [" ".join(ws) for ws in texts])
        todo = sorted((i for i, e in enumerate(scores) if len(e) and (e[:, 0] - e[:, 1:].max(1)).min() <= self.sure), key=lambda i: len(scores[i]))
        while todo:
            # As many as are BATCH_WORDS words in all, padding too; a longer text is alone.
            size = 1
            while size < min(len(todo), 64) and (size + 1) * len(scores[todo[size]]) <= BATCH_WORDS:
                size += 1
            some, todo = todo[:size], todo[size:]
            n = np.array([len(scores[i]) for i in some])
            # Shorter texts are padded in front with words that score 0 for O and cannot be another.
            e = np.full((len(some), n.max(), 3), -1e9)
            e[:, :, 0] = 0
            for row, i in zip(e, some):
                row[len(row) - len(scores[i]) :] = scores[i]
            began = n.max() - n
            best, back = e[:, 0].copy(), np.zeros((n.max(), len(some), 3), np.int8)
            for t in range(1, n.max()):
                via = best[:, :, None] + np.where((began >= t)[:, None, None], 0.0, self.moves)
                back[t] = via.argmax(1)
                best = via.max(1) + e[:, t]
            x = best.argmax(1)
            path = np.zeros((len(some), n.max()), np.int8)
            for t in range(n.max() - 1, -1, -1):
                path[:, t] = x
                x = back[t, np.arange(len(some)), x] if t else x
            for row, i, size in zip(path, some, n):
                out[i] = row[len(row) - size :]
        return out

    def spans(self, texts: list[str], base: list[list[tuple]]) -> list[list[tuple[int, int, int, int]]]:
        """The base spans and those that the field adds beside them: the secret-like part of each tagged run of words."""
        words = [t.split() for t in texts]
        out = []
        for text, ws, own, tags in zip(texts, words, base, self.tag(words, texts)):
            found = list(own)
            if tags is not None and tags.any():
                runs, prev = [], 0
                for k, m in enumerate(_WORD.finditer(text)):
                    if tags[k] == 1 or tags[k] == 2 and not prev:
                        runs.append([m.start(), m.end()])
                    elif tags[k] == 2:
                        runs[-1][1] = m.end()
                    prev = tags[k]
                for i, j in runs:
                    for m in _VALUE.finditer(text, i, j):
                        if all(m.end() <= s or m.start() >= e for s, _, e, _ in own):
                            found.append((m.start(), 3, m.end(), m.start()))
            out.append(sorted(found))
        return out


def label(text: str) -> tuple[list[str], np.ndarray]:
    """Words of a text and their tags by the base patterns' values."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    tags = np.zeros(len(at), np.int64)
    starts = np.array([s for s, _ in at])
    for _, _, end, value in base_spans(text):
        k, first = int(np.searchsorted(starts, value, "right")) - 1, True
        while 0 <= k < len(at) and at[k][0] < end:
            if not tags[k]:
                tags[k] = 1 if first else 2
            k, first = k + 1, False
    return [text[s:e] for s, e in at], tags


def _chosen(places: np.ndarray, most: int) -> list[int]:
    """At most `most` of these places, by a hash of the place, so that they lie all over the text."""
    h = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(places[np.argsort(h ^ (h >> np.uint64(29)))[:most]]).tolist()


def windows_of(text: str, reach: int, tagged: int, plain: int) -> list[tuple[list[str], list[int], list[str]]]:
    """Words, tags and the whole text's features of windows round at most `tagged` tagged words, `plain` untagged ones with digits and
    one in the middle. The first are there twice, the second time without the two words before the secret, so that its shape is
    learned beside its surroundings."""
    words, tags = label(text)
    extra = list(text_features(text))
    digits = np.array([i for i, w in enumerate(words) if not tags[i] and any(map(str.isdigit, w))], np.int64)
    marks = _chosen(np.flatnonzero(tags), tagged) + _chosen(digits, plain) + [len(words) // 2] * bool(words)
    out = [(words[max(0, k - reach) : k + reach], tags[max(0, k - reach) : k + reach].tolist(), extra) for k in marks]
    for k in marks:
        if tags[k] == 1:
            keep = [*range(max(0, k - reach), max(0, k - 2)), *range(k, min(len(words), k + reach))]
            out.append(([words[i] for i in keep], [int(tags[i]) for i in keep], extra))
    return out


def fit(docs: DataFrame, *, sample_docs: int = 300, reach: int = 25, tagged: int = 20, plain: int = 4, rounds: int = 80) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Train the field on windows round the base patterns' finds, and round other words with digits, in a bounded sample of labelled
    rows: the sample_docs texts with and as many without a keyword, those of smallest hash, and of each whole text at most 2 * tagged + plain
    + 1 windows of 2 * reach words, by a hash of their places. Empty table: all O."""
    t = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    low = F.lower("text")
    keyed = F.col("text").contains("AKIA")
    for k in KEYWORDS:
        keyed = keyed | low.contains(k)
    t = t.withColumn("keyed", keyed)
    total = {r.keyed: r.n for r in t.groupBy("keyed").agg(F.count("*").alias("n")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 50):
            rows = [w for t in b.column(0).to_pylist() for w in windows_of(t, reach, tagged, plain)]
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in rows], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["words", "tags", "extra"])

    some = lambda k: smallest_hashes(t.where(F.col("keyed") == k), sample_docs, "secrets", total=total.get(k, 0)).select("text")
    found = some(True).unionByName(some(False)).mapInArrow(cut, "words array<string>, tags array<bigint>, extra array<string>")
    # The rows come in any order; sums of their gradients shall not depend on it.
    windows = [(w, np.array(y, np.int64), x) for w, y, x in sorted((r.words, r.tags, r.extra) for r in found.collect())]
    moves = np.zeros((3, 3))
    if not windows:
        return {"own:prose": np.array([9.0, 0, 0]), "own:mixed": np.array([9.0, 0, 0])}, moves
    # Features of each word as indexes; all windows at once, padded behind.
    names: dict[str, int] = {}
    width = max(len(w) for w, _, _ in windows)
    rows, cols = [], []
    y = np.full((len(windows), width), -1)
    for i, (words, tags, extra) in enumerate(windows):
        y[i, : len(tags)] = tags
        shapes = [shape(w) for w in words]
        for j in range(len(words)):
            f = [f"own:{x}" for x in shapes[j]] + [f"prev:{x}" for x in (shapes[j - 1] if j else ())] + [f"next:{x}" for x in (shapes[j + 1] if j + 1 < len(words) else ())] + [f"text:{x}" for x in extra]
            rows += [i * width + j] * len(f)
            cols += [names.setdefault(x, len(names)) for x in f]
    rows, cols, real = np.array(rows), np.array(cols), y >= 0
    w = np.zeros((len(names), 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3))]
    hot = np.eye(3)[np.maximum(y, 0)] * real[:, :, None]
    both = real[:, 1:] & real[:, :-1]
    moved = np.einsum("bti,btj->ij", hot[:, :-1] * both[:, :, None], hot[:, 1:])
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(rows, w[cols, s], y.size) for s in range(3)], 1).reshape(*y.shape, 3)
        m, z = np.exp(moves), np.exp(e - e.max(2, keepdims=True))
        a, b = np.zeros_like(z), np.ones_like(z)
        a[:, 0] = z[:, 0] / z[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            now = (a[:, t - 1] @ m) * z[:, t]
            a[:, t] = np.where(real[:, t, None], now / now.sum(1, keepdims=True), a[:, t - 1])
        for t in range(width - 2, -1, -1):
            now = (z[:, t + 1] * b[:, t + 1]) @ m.T
            b[:, t] = np.where(real[:, t + 1, None], now / now.sum(1, keepdims=True), 1.0)
        g = a * b
        g = g / g.sum(2, keepdims=True) * real[:, :, None]
        pair = a[:, :-1, :, None] * m * (z * b)[:, 1:, None, :]
        pair = pair / pair.sum((2, 3), keepdims=True) * both[:, :, None, None]
        diff = (hot - g).reshape(-1, 3)
        grad = np.stack([np.bincount(cols, diff[rows, s], len(names)) for s in range(3)], 1) - 0.05 * w
        grad_m = moved - pair.sum((0, 1)) - 0.05 * moves
        for x, gx, k in ((w, grad, 0), (moves, grad_m, 2)):  # Adam
            state[k] = 0.9 * state[k] + 0.1 * gx
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * gx**2
            x += 0.15 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return {k: w[i] for k, i in names.items()}, moves


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, model: tuple[dict[str, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, spans: every whole text's spans, by start and then kind as in KINDS; starts and ends are code points, ends exclusive.

    Null or empty text: no spans. Null or repeated doc_ids: each row is returned. Other columns are ignored.
    """
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # some hundred features
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = kept(key, lambda: Field(*shared.value))
        for part in slices(batches):
            found = _found(field, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[(KINDS[k], s, e) for s, k, e, _ in x] for x in found], kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def _found(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    texts = [t or "" for t in texts]
    return field.spans(texts, [base_spans(t) for t in texts])


def redact(docs: DataFrame, model: tuple[dict[str, np.ndarray], np.ndarray], mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with the value of every span in `text` replaced by `mark`, and n_chars (if there) made anew. Null texts stay."""
    key, shared, schema = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = kept(key, lambda: Field(*shared.value))
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            new = []
            for t, spans in zip(texts, _found(field, texts)):
                out, at = [], 0
                for value, end in sorted((v, e) for _, _, e, v in spans):
                    if end > at:
                        out += [t[at : max(at, value)], mark * (value >= at)]
                        at = end
                new.append(t if t is None or not spans else "".join(out) + t[at:])
            arrays = [pa.array(new, b.schema.field("text").type) if f == "text" else pa.array([None if o is None else o if n == x else len(n) for o, n, x in zip(b.column(f).to_pylist(), new, texts)], b.schema.field(f).type) if f == "n_chars" else b.column(f) for f in b.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, fit(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(F.filter("spans", lambda s: s["kind"] != "crf")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
