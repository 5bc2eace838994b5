"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms are 2- to 4-grams of a text's shape (runs of capitals, small letters and digits are one symbol
each, all else stands for itself), and one term each for repeated lines and repeated three-word runs.
Words themselves are no terms: quality is about form, and texts come in several languages, whose words
would separate languages in the latent space before they separate good texts from bad ones.

A bounded, hash-chosen sample of labelled rows (MAX_FIT_DOCS, training folds only) gives the
vocabulary (the VOCABULARY terms that are most frequent there, a parameter of the model), the document
frequencies and a truncated singular value decomposition. The labelled vectors (at most MAX_FIT_DOCS x
RANK floats) and the projection (VOCABULARY x RANK) travel with the task. Every document's whole text
is projected, its exact cosine to every labelled vector is computed in blocks, and the labels of its
NEIGHBOURS nearest vectors vote with the POWER of their similarity as weight.

Similarities are compared in steps of 1 / STEPS, so that they are the same in blocks of any size, and
equal ones go to the smaller doc_id of the sample.

Defined cases: a null or empty text, or one with no known term, gets the share of label 1 in the
sample; without any labelled row every score is 0.5; repeated rows are scored alike, and rows of one id
each by its own text; very long texts are blocks of their own; an empty table gives an empty table;
other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, Chunk, byte_class, chunks, shapes, window_hash, words
from .language_id import counted, fold

MAX_FIT_DOCS = 2000
VOCABULARY = 2048
RANK = 48
NEIGHBOURS = 15
POWER = 4
STEPS = 100_000
FOLDS, HELD_OUT = 3, 1
_ROWS = 512
_TABLE_BITS = 20
LINES = byte_class(b"\n")


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term keys, document of each): shape 2- to 4-grams, and one term for each repeated line or word run."""
    c, doc = shapes(data, offs)
    keys, docs = [], []
    gram = c
    for size in (2, 3, 4):
        gram = (gram[:-1] << np.uint64(16)) | c[size - 1 :] if len(c) >= size else c[:0]
        inside = doc[: len(gram)] == doc[size - 1 :] if len(gram) else np.zeros(0, bool)
        keys.append(gram[inside])
        docs.append(doc[: len(gram)][inside])
    chunk = Chunk(data, offs, None, 0)
    w = words(chunk, SPACED)
    runs, run_doc = window_hash(w.hash, 3), w.doc[2:]
    inside = w.doc[: len(runs)] == run_doc
    lines = words(chunk, LINES)
    for k, (h, d) in enumerate(((lines.hash, lines.doc), (runs[inside], run_doc[inside]))):
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (d[1:] == d[:-1]))) if len(h) else np.zeros(0, bool)
        docs.append(np.repeat(d[again], 2))
        keys.append(np.full(len(docs[-1]), 0xFFFFFFFFFFFF0000 + k, dtype=np.uint64))
    return np.concatenate(keys), np.concatenate(docs)


class Lookup:
    """Place of a term in the vocabulary by a collision-free multiplicative hash."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        for seed in range(1, 2000):
            m = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64))
            slot = self._slot(vocabulary, m)
            if len(np.unique(slot)) == len(slot):
                break
        self.m = m
        self.table = np.full(1 << _TABLE_BITS, len(vocabulary), dtype=np.int32)
        self.table[slot] = np.arange(len(vocabulary))
        self.key = np.append(vocabulary, np.uint64(0))

    @staticmethod
    def _slot(keys: np.ndarray, m: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * m) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def counts(self, keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Matrix of n documents by terms."""
        at = self.table[self._slot(keys, self.m)]
        hit = self.key[at] == keys
        v = len(self.vocabulary)
        return np.bincount(doc[hit] * v + at[hit], minlength=n * v)[: n * v].reshape(n, v).astype(np.float32)


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_FIT_DOCS) -> Model | None:
    """Model from a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    # the sample's ids are few, so the documents are filtered by a broadcast of a proven size
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def pairs(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                keys, doc = terms(c.data, c.offs)
                order = np.argsort(doc, kind="stable")
                keys, cut = keys[order], np.searchsorted(doc[order], np.arange(c.n + 1))
                own = [counted(keys[cut[k] : cut[k + 1]])[0] for k in range(c.n)]
                k, n = counted(np.concatenate(own)) if own else counted(np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    # of rows of one id, one: the sample is bounded by rows as well
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").repartition(8)
    frequent = sample.mapInArrow(pairs, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = sorted(((r["term"], r["n"]) for r in frequent.orderBy(F.desc("n"), "term").limit(VOCABULARY).collect()))
    if not found:
        return None
    vocabulary = np.array([k for k, _ in found], dtype=np.int64).view(np.uint64)
    look = Lookup(vocabulary)

    def vectors(batches):
        for batch in batches:
            for c in chunks(batch.column(1), max_rows=_ROWS):
                x = look.counts(*terms(c.data, c.offs), c.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n).cast(pa.int64()), batch.column(2).slice(c.first, c.n).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    got = sorted(sample.mapInArrow(vectors, "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
    counts = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    y = np.array([1 if r["label"] == 1 else 0 for r in got], dtype=np.float32)
    idf = (np.log((1 + len(got)) / (1 + np.array([n for _, n in found]))) + 1).astype(np.float32)
    x = weighted(counts, idf)
    # randomised range finder of fixed seed, then an exact decomposition of the small matrix
    rank = min(RANK, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    return Model(vocabulary, idf, np.ascontiguousarray(basis), unit(x @ basis), y, float(y.mean()))


def vote(m: Model, docs: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity.

    The vectors of the model are in the order of their doc_id, and so is the rank of equal similarities.
    """
    step = np.rint((docs @ m.vectors.T).astype(np.float64) * STEPS).astype(np.int64)
    n = step.shape[1]
    k = min(NEIGHBOURS, n)
    # one number for the similarity and, behind it, the place: no two are equal
    key = step * n + np.arange(n - 1, -1, -1)
    near = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), step.shape), axis=1)
    w = (np.maximum(np.take_along_axis(step, near, axis=1), 0) / STEPS) ** POWER
    total = w.sum(axis=1)
    return np.where(total > 1e-12, (w * m.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), m.base)


def predict(docs: DataFrame, m: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score >= 0.5)."""
    look = Lookup(m.vocabulary) if m else None

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1), max_rows=_ROWS):
                if m is None:
                    score = np.full(c.n, 0.5)
                else:
                    x = weighted(look.counts(*terms(c.data, c.offs), c.n), m.idf)
                    score = np.clip(vote(m, unit(x @ m.basis)), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), batch.column(2).slice(c.first, c.n), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), FOLDS) == HELD_OUT).alias("held_out"))
    kind = dict(plain.dtypes)["doc_id"]
    scored = plain.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
