"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its pairs of neighbouring characters, by class: upper and lower case,
letters beyond ASCII, digits, white space, line ends, and each ASCII punctuation mark on its
own. Weighted by inverse document frequency and projected on the leading singular vectors
of a labelled sample, texts become short vectors. The sample's vectors (about ``SAMPLE``, chosen by a hash of the id)
are broadcast; for every document, exact cosine products with all of them are computed in
blocks, and the labels of the nearest vote with their similarity as weight.

Defined results: a null or empty text has no direction and gets the sample's mean label;
without labelled rows the score is 1; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .shingles import slices

SAMPLE = 4000
RANK = 32
NEAREST = 25
BOUND = 0.3

_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
CLASSES = 6 + len(_PUNCTUATION)
_CLASS = np.full(256, 2)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 0, 1, 3
_CLASS[:0x21], _CLASS[0x7F], _CLASS[0x0A] = 4, 4, 5
_CLASS[_PUNCTUATION] = range(6, CLASSES)
TERMS = CLASSES * CLASSES


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts (texts x terms) of class pairs within each text."""
    n = len(at) - 1
    kind = _CLASS[data]
    pair = kind[:-1] * CLASSES + kind[1:] if len(data) else kind
    text = np.repeat(np.arange(n), np.diff(at))
    inside = text[:-1] == text[1:] if len(data) else np.zeros(0, bool)
    return np.bincount(text[:-1][inside] * TERMS + pair[inside], minlength=n * TERMS).reshape(n, TERMS) if len(data) else np.zeros((n, TERMS), np.int64)


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * idf
    return x.astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in slices(batch.column(0)):
            counts = term_counts(data, at)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint32).tobytes() for x in counts], pa.binary()), batch.column(1)[a:b]], names=["terms", "label"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model of labelled texts (doc_id, text, label): term weights, projection, and the sample's vectors and labels."""
    n = labelled.count()
    share = int(1_000_000 * min(1, 0.95 * sample / max(n, 1)))
    rows = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text", F.col("label").cast("double"))
    rows = rows.mapInArrow(_counted, "terms binary, label double").toArrow()
    if not rows.num_rows:
        return {"idf": np.zeros(TERMS), "project": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0)}
    counts = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.uint32).reshape(-1, TERMS)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    x = _unit(_weights(counts, idf))
    _, vectors = np.linalg.eigh(x.T @ x)
    project = np.ascontiguousarray(vectors[:, ::-1][:, :RANK])
    return {"idf": idf, "project": project, "vectors": _unit(x @ project), "labels": rows.column("label").to_numpy()}


def vote(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest sample vectors of each row."""
    vectors, labels = model["vectors"], model["labels"]
    if not len(labels):
        return np.ones(len(x))
    cosine = x @ vectors.T
    k = min(NEAREST, len(labels))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 2
    total = weight.sum(1)
    return np.where(total > 0, (weight * labels[near]).sum(1) / np.where(total > 0, total, 1), labels.mean()).clip(0, 1)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in slices(batch.column(1)):
                for c in range(0, b - a, 512):  # bounds a block of products
                    d = min(c + 512, b - a)
                    x = _unit(_unit(_weights(term_counts(data[at[c] : at[d]], at[c : d + 1] - at[c]), model["idf"])) @ model["project"])
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a + c : a + d], pa.array(vote(x, model), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of ``docs``, learned from labelled rows whose id's crc32 modulo 5 is not 0."""
    own = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    train = docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(own, "doc_id")
    out = score(docs, fit(train))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= BOUND).cast("int").alias("predicted"))
