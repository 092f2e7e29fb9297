"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence's probability is a logistic function of its hashed words and word pairs; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). The model is trained through the noisy-or from document labels alone, which leaves the blame
with the sentences that only labelled documents have, so it can then say where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import WordHashes, bounded_batches, keyed_texts, mixed, remainder, slices, unkey
from scenelake.llm.quality import labelled

BITS = 22
#: Features of fewer labelled documents teach nothing: rare words would be learnt by heart.
LEAST_DOCUMENTS = 5
#: Labelled rows that are learnt from, at most: those with the least hashes of their ids.
MOST_LABELLED = 6_000
_END = b"\x01"
_FOLD = bytes(
    1 if chr(b) in ".!?\n" else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)  # full stops, exclamation and question marks and line feeds end sentences; letters are folded; other marks are blanks


def sentences(body: bytes, known: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places of features, starts of sentences in them); a text without words is one sentence without features.

    Place 0 stands for the start of each sentence and carries the constant.
    """
    words = body.translate(_FOLD).replace(_END, b" \x01 ").split()
    end = known[_END]
    h = known.of(words)
    # one mark before each sentence; empty sentences vanish
    mark = h == np.uint64(end)
    keep = ~mark | np.r_[~mark[1:], False] if len(h) else mark
    h, mark = h[keep], mark[keep]
    if not len(h) or not mark[0]:
        h, mark = np.r_[np.uint64(end), h], np.r_[True, mark]
    single = np.where(mark, 0, np.maximum(1, mixed(h) >> np.uint64(64 - bits)).astype(np.int64))
    pair = np.zeros(len(h), np.int64)
    pair[1:] = np.maximum(1, mixed(h[1:] * np.uint64(3) + mixed(h[:-1])) >> np.uint64(64 - bits)).astype(np.int64)
    pairs = ~mark & ~np.r_[True, mark[:-1]]  # pairs lie within a sentence
    both = np.stack([single, pair], 1).reshape(-1)
    use = np.stack([np.ones(len(h), bool), pairs], 1).reshape(-1)
    start = np.flatnonzero(np.stack([mark, np.zeros(len(h), bool)], 1).reshape(-1)[use])
    return both[use], start


def log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - p) of sentences."""
    return -np.logaddexp(0, z)


def document_score(w: np.ndarray, at: np.ndarray, start: np.ndarray) -> float:
    return float(-np.expm1(log_clean(np.add.reduceat(w[at], start)).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, rounds: int = 150, rate: float = 1.0, l1: float = 0.5, prior: float = -6.0) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the features that are used, by proximal steps on the noisy-or likelihood of all rows.

    ``l1`` is the penalty, in documents, of a unit of weight: what only a document or two would gain from stays 0.
    Features of fewer than LEAST_DOCUMENTS documents share a place whose weight is 0; the constant is not penalised.
    """
    seen = np.zeros(size, np.int32)
    for at, *_ in rows:
        seen[np.unique(at)] += 1
    seen[0] = LEAST_DOCUMENTS
    used = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    number = np.full(size, len(used), np.int32)
    number[used] = np.arange(len(used))
    w, n = np.zeros(len(used) + 1), np.full(len(used) + 1, 1.0)
    w[0] = prior  # a sentence is clean unless something speaks against it
    if not rows:
        return used, w[:-1].astype(np.float32)
    at = number[np.concatenate([a for a, *_ in rows])]
    sizes = np.array([len(a) for a, *_ in rows])
    start = np.concatenate([s + o for (_, s, _), o in zip(rows, np.cumsum(sizes) - sizes, strict=True)])
    first = np.cumsum([0, *[len(s) for _, s, _ in rows[:-1]]])
    y = np.array([y for *_, y in rows])
    many, lengths = np.array([len(s) for _, s, _ in rows]), np.diff(np.r_[start, len(at)])
    penalty = np.full(len(w), l1)
    penalty[0] = 0
    for _ in range(rounds):
        z = np.add.reduceat(w[at], start)
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        clean = np.exp(np.add.reduceat(log_clean(z), first))
        blame = np.where(y == 1, -clean / np.maximum(1e-9, 1 - clean), 1.0)
        g = np.bincount(at, np.repeat(p * np.repeat(blame, many), lengths), len(w))
        n += g * g
        step = rate / np.sqrt(n)
        new = w - step * g
        w = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        w[-1] = 0
    some = np.flatnonzero(w[:-1])
    return used[some], w[some].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 3, held: int = 1, most: int = MOST_LABELLED, bits: int = BITS) -> np.ndarray:
    """Learns from a bounded sample of labelled rows: all tasks make the features, one task takes the steps."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            k, bodies, y = (batch.column(batch.schema.get_field_index(c)) for c in ("k", "body", "y"))
            found = [sentences(b, known, bits) for b in bodies.to_pylist()]
            yield pa.RecordBatch.from_arrays([k, *[pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)], y.cast(pa.int32())], names=["k", "at", "start", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k.as_py(), at.values.to_numpy(), s.values.to_numpy(), y.as_py()) for b in batches for k, at, s, y in zip(*b.columns, strict=True)]
        rows.sort(key=lambda r: r[0])
        places, weights = fit([r[1:] for r in rows], 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(weights, pa.float32())], names=["place", "weight"])

    rows = labelled(docs, labels, label, divisor, held, most).mapInArrow(hashed, "k long, at array<int>, start array<int>, y int")
    found = rows.repartition(1).mapInArrow(learn, "place long, weight float").collect()  # 2**bits rows at most, a few thousand in use
    weights = np.zeros(1 << bits, np.float32)
    weights[[r["place"] for r in found]] = [r["weight"] for r in found]
    return weights


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 3, held: int = 1, threshold: float = 0.7, most: int = MOST_LABELLED, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence (its number) and worst_score of every document.

    Nothing but the text enters a score. Null, empty and wordless texts have one sentence with the constant alone.
    Without labels the constant is all there is. Every row is returned, whatever its id.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, divisor, held, most, bits))  # 4 * 2**bits bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = WordHashes(), weights.value
        for batch in batches:
            for some in slices(batch):
                rows = []
                for body in some.column(1).to_pylist():
                    at, start = sentences(body, known, bits)
                    z = np.add.reduceat(w[at].astype(np.float64), start)
                    worst = int(z.argmax())
                    rows.append((float(-np.expm1(log_clean(z).sum())), len(start), worst, float(1 / (1 + np.exp(-np.clip(z[worst], -35, 35))))))
                kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["k", "score", "n_sentences", "worst_sentence", "worst_score"])

    out = keyed_texts(docs).mapInArrow(score, "k long, score double, n_sentences long, worst_sentence long, worst_score double").withColumn("doc_id", unkey("k"))
    return out.select("doc_id", (remainder(divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score")


def offending_sentences(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """(doc_id, sentence, start, stop, score): byte places of the sentences whose own score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = WordHashes(), shared.value
        for batch in batches:
            rows = [(0, 0, 0, 0, 0.0)][:0]
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, start = sentences(body, known, bits)
                score = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at].astype(np.float64), start), -35, 35)))
                places = [m.span() for m in re.finditer(rb"[^\x01]*[^\x01 ][^\x01]*", body.translate(_FOLD))] or [(0, len(body))]
                rows += [(k, i, *places[i], float(score[i])) for i in np.flatnonzero(score >= threshold).tolist()]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "sentence", "start", "stop", "score"])

    return keyed_texts(docs).mapInArrow(locate, "k long, sentence long, start long, stop long, score double").select(unkey("k").alias("doc_id"), "sentence", "start", "stop", "score")
