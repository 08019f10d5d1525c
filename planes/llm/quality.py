"""Quality of texts by nearest-neighbour voting.

A text is a bag of terms: how its words are written, how they repeat, and the words
themselves, hashed. Term counts, damped and weighted by rarity, are projected into a latent
semantic space fitted on labelled texts. The labelled vectors are broadcast; each document's
cosine with every one of them is computed exactly, a block of documents at a time, and the
nearest neighbours vote for their labels with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from planes.llm.common import slices
from planes.llm.tokens import Words, mix, words

# The most labelled texts that are broadcast and fitted on, whatever the input.
SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
# Votes weigh as this power of the similarity.
SHARPNESS = 8
SHAPES, WORDS, REPEATS = 1024, 1024, 32
TERMS = SHAPES + WORDS + REPEATS
BLOCK = 1024

# Classes of bytes: small letters, capitals, digits, other signs each for itself.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[0x80:] = 1


def term_counts(w: Words) -> np.ndarray:
    """Rows by terms: how often each term occurs."""
    rows = len(w.first) - 1
    counts = np.zeros((rows, TERMS), np.float32)
    if not len(w.codes):
        return counts
    row = w.row
    size = w.end - w.begin
    at = lambda k: _CLASS[w.data[np.clip(w.begin + k, w.begin, w.end - 1)]]
    back = lambda k: _CLASS[w.data[np.clip(w.end - k, w.begin, w.end - 1)]]
    shape = ((at(0) * 256 + at(1)) * 256 + back(1)) * 256 + back(2)
    shape = mix((shape * 4 + np.minimum(size, 24) // 8).view(np.uint64)) % np.uint64(SHAPES)
    terms = [(row, shape.astype(np.int64)), (row, SHAPES + (w.codes % np.uint64(WORDS)).astype(np.int64))]
    # Words that come again after few words, by how many.
    for k in range(1, REPEATS):
        same = np.flatnonzero((w.codes[k:] == w.codes[:-k]) & (row[k:] == row[:-k]))
        terms.append((row[same], np.full(len(same), SHAPES + WORDS + k)))
    flat = np.concatenate([r * TERMS + t for r, t in terms])
    return np.bincount(flat, minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)


def damped(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's words."""
    return np.sqrt(counts / np.maximum(n_words, 1)[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Term weights, the latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int):
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x = unit(x * self.idf)
        # Truncated singular vectors by power iteration from a fixed start.
        q = np.random.Generator(np.random.PCG64(7)).standard_normal((x.shape[1], dimensions + 8)).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.space = (q @ v.T)[:, :dimensions].astype(np.float32)
        self.vectors = unit(x @ self.space).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, x: np.ndarray) -> np.ndarray:
        return unit(unit(x * self.idf) @ self.space)

    def scores(self, x: np.ndarray, neighbours: int) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(neighbours, len(self.labels))
        if not k:
            return out
        for a in range(0, len(x), BLOCK):
            cosines = self.project(x[a : a + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            some = total > 0
            out[a : a + BLOCK][some] = ((weight * self.labels[near]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """A model of the labelled texts, of no more than ``sample`` of them: those whose ids have
    the least hashes. Rows with a null id or label are passed over; of several labels of
    one id the highest counts, and texts that share an id each count."""
    chosen = (
        labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` pairs of numbers are broadcast.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches):
        for batch in slices(batches, "text", rows=BLOCK):
            w = words(batch.column("text"))
            x = damped(term_counts(w), np.diff(w.first))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label").cast(pa.float64()), pa.array([r.astype(np.float32).tobytes() for r in _sparse(x)], pa.binary())],
                ["doc_id", "label", "terms"],
            )

    got = sorted(((r["doc_id"], r["label"], bytes(r["terms"])) for r in rows.mapInArrow(run, "doc_id long, label double, terms binary").orderBy(F.xxhash64("doc_id"), "terms").limit(sample).collect()))
    x = np.zeros((len(got), TERMS), np.float32)
    for i, (_, _, terms) in enumerate(got):
        at, value = np.frombuffer(terms, np.float32).reshape(2, -1)
        x[i, at.astype(np.int64)] = value
    return Model(x, np.array([r[1] for r in got], np.float32), dimensions)


def _sparse(x: np.ndarray):
    for row in x:
        at = np.flatnonzero(row)
        yield np.stack([at.astype(np.float32), row[at]])


def score(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher where label 1 is likelier.

    Null and empty texts, and those with no labelled text anything like them, have the share
    of label 1 among the labelled texts. All rows and other columns are kept; a column of
    that name is replaced. An empty table gives no rows.
    """
    schema = [f for f in docs.schema if f.name != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, "text", rows=BLOCK):
            w = words(batch.column("text"))
            x = damped(term_counts(w), np.diff(w.first))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema), pa.array(model.scores(x, neighbours))], [*(f.name for f in schema), name])

    return docs.mapInArrow(run, StructType([*schema, StructField(name, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.quality``, learned from rows that are not held out."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(~held_out())
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
