"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the presence of words and of their stems (first letters), so that
a word whose ending was never seen still counts. For labelled texts that name a group, the
text is repeated with the group's term swapped for others of its kind, and the squared
change of the score's logit is penalised, so that the mere mention of a group moves no
score. Word counts, vocabulary and features are made in Spark; the fit runs over the
features of a bounded sample of labelled rows (about ``SAMPLE``, chosen by a hash of the id). Every document is
scored, whole.

Defined results: a null or empty text has no words and gets the score of the intercept;
without labelled rows of both classes scores are 0; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

SAMPLE = 20_000
WORDS = 20_000
LEAST = 3
#: Words whose number of toxic texts is off by fewer standard deviations are left out.
TELLING = 3.0
BOUND = 0.7
PENALTY = 1.0
DECAY = 5e-5
STEPS = 300
#: Letters of the stems of longer words.
STEMS = (4, 5, 6)

# fixed values: terms that name groups, by kind; a swap stays within its kind
KINDS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("she", "he"),
    ("her", "his"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "russian", "turkish", "polish", "indian"),
    ("deaf", "blind", "disabled", "autistic"),
    ("young", "old", "elderly"),
)
_KIND = {term: k for k, terms in enumerate(KINDS) for term in terms}

_LETTERS = regex.compile(r"\p{L}+")


def word_set(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def features(text: str | None) -> set[str]:
    """Words of a text, and stems (with an asterisk) of those that name no group."""
    words = word_set(text)
    return words | {f"{w[:k]}*" for w in words if w not in _KIND for k in STEMS if len(w) > k}


def swaps(words: set[str]) -> list[tuple[str, str]]:
    """(term, other) for each group term of a text and each other of its kind that it lacks."""
    return [(t, o) for t in words if t in _KIND for o in KINDS[_KIND[t]] if o not in words]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, pairs: np.ndarray, size: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept, by gradient descent with moments and a step that falls to zero.

    ``rows`` are word ids; ``pairs`` (term, other, times) are swaps with their number, each
    of which changes the logit by the difference of two weights.
    """
    w, b = np.zeros(size), 0.0
    if not len(rows) or not 0 < labels.sum() < len(labels):
        return w, -math.inf
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    n = len(rows)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, STEPS + 1):
        logit = np.bincount(row, w[flat], n) + b
        off = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels
        grad = np.append(np.bincount(flat, off[row], size) / n + DECAY * w, off.mean())
        if len(pairs):
            change = 2 * penalty * pairs[:, 2] * (w[pairs[:, 0]] - w[pairs[:, 1]]) / n
            grad[:-1] += np.bincount(pairs[:, 0], change, size) - np.bincount(pairs[:, 1], change, size)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        step = 0.1 * (1 - k / (STEPS + 1)) * mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(labelled: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[dict[str, float], float]:
    """Word weights and intercept of labelled texts (doc_id, text, label)."""
    n = labelled.count()
    share = int(1_000_000 * min(1, 0.95 * sample / max(n, 1)))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "label"])

    rows = stored(some.select("text", F.col("label").cast("int")).mapInArrow(sets, "words array<string>, label int"))
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    rate = sums["toxic"] / max(sums["n"], 1)
    told = F.abs(F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(max(rate * (1 - rate), 1e-9)))
    common = (
        rows.select(F.explode("words").alias("word"), "label").groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
        .where((F.col("n") >= LEAST) & (told >= TELLING)).orderBy(F.desc(told), "word").limit(WORDS)
    )
    vocabulary = sorted({r["word"] for r in common.select("word").collect()} | set(_KIND))
    index = {w: i for i, w in enumerate(vocabulary)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [np.array([index[w] for w in x if w in index], np.int32).tobytes() for x in words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column(1), pa.array([[f"{t} {o}" for t, o in swaps(set(x))] for x in words], pa.list_(pa.string()))], names=["ids", "label", "swaps"])

    got = stored(rows.mapInArrow(numbered, "ids binary, label int, swaps array<string>"))
    pairs = [(index[a], index[b], r["n"]) for r in got.select(F.explode("swaps").alias("swap")).groupBy("swap").agg(F.count("*").alias("n")).collect() for a, b in [r["swap"].split()]]
    table = got.select("ids", "label").toArrow()
    w, b = fit_rows([np.frombuffer(x, np.int32) for x in table.column("ids").to_pylist()], table.column("label").to_numpy().astype(float), np.array(pairs, np.int64).reshape(-1, 3), len(vocabulary), penalty)
    return {word: float(w[i]) for word, i in index.items() if w[i]}, b


def score(docs: DataFrame, weights: dict[str, float], intercept: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: its columns ``keep`` and the score of its text."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", toxicity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(weights)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                logits = [sum(weights[w] for w in sorted(features(t) & known)) + intercept for t in part.column(0).to_pylist()]
                values = [1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) if intercept > -math.inf else 0.0 for x in logits]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(values, pa.float64())], names=[*keep, "toxicity"])

    return docs.select(F.col("text").alias("toxicity__text"), *keep).mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """The model learned from labelled rows whose id's crc32 modulo 3 is not 1."""
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return fit(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text").join(own, "doc_id"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of ``docs``: doc_id, held_out, score and predicted."""
    out = score(docs, *trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= BOUND).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """The rows of ``docs`` that score under the bound, with their columns."""
    names = tuple(c for c in docs.columns if c != "toxicity")
    return score(docs.select(*names), weights, intercept, names).where(F.col("toxicity") < BOUND).select(*names)
