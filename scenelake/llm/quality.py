"""Quality scores: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

Two families of n-grams are hashed into one space: of words (one and two), and of the words' forms (one to three). A
form says how a word is written (case, digits, what marks end it) and whether it stands again where the last words or
the last forty stood, so that what makes a text noisy is learnt whatever its words. Counts enter by their square root, and
each family has length 1.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import bounded_batches, key, keyed_texts, mixed, remainder, slices, unkey

BITS = 18
#: Labelled rows that are learnt from, at most: those with the least hashes of their ids.
MOST_LABELLED = 6_000
#: Bytes of their texts, at most, but for the last of them.
MOST_BYTES = 32 << 20
_PAIR = struct.Struct("<QQ")
_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


_TAIL, _HEAD = b".,;:!?$#&*%|<>/\\@+=-_~^", b".,;:!?$#&*%|<>/\\@+=-_~^(\"'"


def _form(word: bytes) -> int:
    """A number for how a word is written: case, digits, size of its core, the marks before and after it."""
    if word.isalpha() and word.islower():
        return zlib.crc32(b"1 0 %d   " % (min(len(word), 24) // 4))
    core = _MARKS.sub(b"", word)
    text = core.decode(errors="ignore")
    case = 0 if not core else 1 if text.islower() else 2 if text.istitle() else 3 if text.isupper() else 4
    end = word[len(word.rstrip(_TAIL)) :][:3]
    start = word[: len(word) - len(word.lstrip(_HEAD))][:2]
    digits = any(48 <= b <= 57 for b in core)
    return zlib.crc32(b"%d %d %d " % (case, digits, min(len(core), 24) // 4) + start + b" " + end)


class _Words(dict):
    """Hashes of the folded word and of its form, as 16 bytes, for a bounded number of words at once."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 250_000:
            self.clear()
        value = self[word] = _PAIR.pack(xxhash.xxh3_64_intdigest(word.lower()), _form(word))
        return value


def features(body: bytes, known: _Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's n-grams; the empty text has the one feature that all have."""
    words = body.split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    w, f = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(-1, 2).T.copy()
    again = np.zeros(len(w), np.uint64)
    for back, mark in ((1, 1), (2, 2), (3, 4)):
        again[back:] |= np.where(w[back:] == w[:-back], np.uint64(mark), np.uint64(0))
    order = np.argsort(w, kind="stable")
    near = np.zeros(len(w), bool)
    near[order[1:]] = (w[order[1:]] == w[order[:-1]]) & (order[1:] - order[:-1] <= 40)
    f = mixed(f * np.uint64(16) + again + np.where(near, np.uint64(8), np.uint64(0)))
    gram = lambda x, n: mixed(sum((x[i : len(x) - n + 1 + i] * np.uint64(2 * i + 3) for i in range(n)), np.uint64(n)))
    out_i, out_v = [np.zeros(1, np.int64)], [np.ones(1, np.float32)]
    half = np.int64(1 << (bits - 1))  # each family has a half of the space; place 0 is the constant
    for family, x, most in ((0, w, 2), (1, f, 3)):
        grams = np.concatenate([gram(x, n) for n in range(1, min(most, len(x)) + 1)])
        place = np.maximum((mixed(grams) >> np.uint64(65 - bits)).astype(np.int64), 1) + family * half
        place, count = np.unique(place, return_counts=True)
        v = np.sqrt(count)
        out_i.append(place)
        out_v.append((v / np.sqrt(count.sum())).astype(np.float32))
    return np.concatenate(out_i), np.concatenate(out_v)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, rounds: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Weights after ``rounds`` passes of per-coordinate follow-the-regularised-leader updates."""
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for r in rng.permutation(len(rows)):
            at, v, y = rows[r]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w  # places are distinct
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(k, body, y) of at most ``most`` labelled documents that may be learnt from, half of them of either label, and
    of so many of these as have ``most_bytes`` of text: the sample is bounded, as one task learns from it.

    The ids and labels taken are so few that they are broadcast; texts are not shuffled. Null labels and ids teach
    nothing; of several labels of one id the largest counts; rows that repeat an id are all taken.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(divisor) != held))
    usable = usable.groupBy(key().alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    halves = [usable.where(y).orderBy(F.xxhash64("k"), "k").limit(most // 2) for y in ("y <= 0", "y > 0")]
    taken = halves[0].unionByName(halves[1])
    sizes = keyed_texts(docs).select("k", F.octet_length("body").cast("long").alias("size")).join(F.broadcast(taken), "k")
    sizes = sizes.groupBy("k", "y").agg(F.sum("size").alias("size"))  # a row for each of the few taken
    before = F.sum("size").over(Window.orderBy(F.xxhash64("k"), "k")) - F.col("size")
    taken = sizes.withColumn("before", before).where(F.col("before") < most_bytes).select("k", "y")
    return keyed_texts(docs).join(F.broadcast(taken), "k")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, held: int = 0, most: int = MOST_LABELLED, bits: int = BITS) -> np.ndarray:
    """Learns from a bounded sample of labelled rows: features are made by all tasks, updates follow in one task."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            k, bodies, y = (batch.column(batch.schema.get_field_index(c)) for c in ("k", "body", "y"))
            found = [features(b, known, bits) for b in bodies.to_pylist()]
            yield pa.RecordBatch.from_arrays([k, pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32())), y.cast(pa.int32())], names=["k", "at", "v", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for k, at, v, y in zip(*batch.columns, strict=True):
                rows.append((k.as_py(), at.values.to_numpy(), v.values.to_numpy(), y.as_py()))
        rows.sort(key=lambda r: r[0])
        weights = ftrl([r[1:] for r in rows], 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    rows = labelled(docs, labels, label, divisor, held, most).mapInArrow(hashed, "k long, at array<int>, v array<float>, y int")
    found = rows.repartition(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(bytes(found[0]["weights"]), np.float32) if found else np.zeros(1 << bits, np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, held: int = 0, threshold: float = 0.3, most: int = MOST_LABELLED, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for every document.

    Nothing but the text enters a score. Null and empty texts get the score of the constant feature. Without labels
    every score is 0.5. Every row is returned, whatever its id.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, divisor, held, most, bits))  # 4 * 2**bits bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = _Words(), weights.value
        for batch in batches:
            for some in slices(batch):
                z = [float(w[at] @ v) for at, v in (features(b, known, bits) for b in some.column(1).to_pylist())]
                p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -35, 35)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(p)], names=["k", "score"])

    out = keyed_texts(docs).mapInArrow(score, "k long, score double").withColumn("doc_id", unkey("k"))
    return out.select("doc_id", (remainder(divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold; one pass without a shuffle."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, divisor, held))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = _Words(), weights.value
        for batch in batches:
            z = np.array([float(w[i] @ v) for i, v in (features((t or "").encode(), known) for t in batch.column(at).to_pylist())], float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
