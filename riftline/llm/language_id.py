"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum, over all its segmentations into pieces, of the product of their
probabilities (a forward pass); a text's is the product over its words. Piece probabilities
are fitted by expectation maximization: expected piece counts come from forward-backward
passes over the (language, word, count) table in Spark tasks and are summed by Spark; what
reaches the driver is bounded by vocabulary and languages.

Only a sample of about ``SAMPLE`` documents of each language is used for fitting, chosen by
a hash of the id; every document is scored, whole.

Defined results: a null text, or one without letters, gets ``und`` and score 0; ties go to
the language that sorts first; if nothing can be learned, all get ``und``. Other columns
are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

SAMPLE = 1200
ROUNDS = 2
#: Longer words aren't learned from; all are scored.
LEARNED = 60
#: Scored words that a worker remembers.
MEMORY = 600_000
START = "▁"
SMOOTH = 0.1

_LETTERS = regex.compile(r"\p{L}+")


def default_pieces() -> list[str]:
    """The pieces of a public vocabulary that are made of letters, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    every = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in every if regex.fullmatch(START + r"?\p{L}*", p) and p)


def longest_of(index: dict[str, int]) -> int:
    """Letters of the longest piece, which no span exceeds."""
    return max(map(len, index), default=1)


def spans(words: list[str], index: dict[str, int], longest: int) -> dict[tuple[int, int], np.ndarray]:
    """For words of one length, the pieces at each span: ids, -1 where none; unknown letters are the last id."""
    n, unknown, out = len(words[0]), len(index), {}
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            ids = np.fromiter((index.get(w[j:i], -1) for w in words), np.int32, len(words))
            if i - j == 1:
                ids[ids < 0] = unknown
            if (ids >= 0).any():
                out[j, i] = ids
    return out


def forward(words: list[str], index: dict[str, int], chance: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Log-probabilities (words x languages) of words of one length; ``chance`` has a row per piece, the last of zeros for none."""
    n, longest = len(words[0]), longest or longest_of(index)
    at = spans(words, index, longest)
    alpha: list[np.ndarray | None] = [np.ones((len(words), chance.shape[1]))]
    scale = np.zeros_like(alpha[0])
    for i in range(1, n + 1):
        total = np.zeros_like(scale)
        for j in range(max(0, i - longest), i):
            if (j, i) in at:
                total += alpha[j] * chance[at[j, i]]
        alpha.append(total)
        if i % 16 == 0:  # keeps long words from underflowing
            scale += np.log(total)
            for k in range(max(0, i - longest), i + 1):
                alpha[k] = alpha[k] / total
        if i > longest:
            alpha[i - longest - 1] = None
    return np.log(alpha[n]) + scale


def expected(words: list[str], counts: np.ndarray, index: dict[str, int], chance: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Expected piece counts of words of one length (of at most LEARNED letters) in one language."""
    n, longest = len(words[0]), longest or longest_of(index)
    at = spans(words, index, longest)
    alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    alpha[0] = beta[n] = 1
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            if (j, i) in at:
                alpha[i] += alpha[j] * chance[at[j, i]]
    for j in range(n - 1, -1, -1):
        for i in range(j + 1, min(n, j + longest) + 1):
            if (j, i) in at:
                beta[j] += chance[at[j, i]] * beta[i]
    out = np.zeros(len(chance))
    for (j, i), ids in at.items():
        out += np.bincount(ids % len(chance), alpha[j] * chance[ids] * beta[i] / alpha[n] * counts, len(chance))
    return out


def _by_length(words) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


def fit(docs: DataFrame, pieces: list[str], sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and the piece probabilities (pieces, the unknown letter, none) x languages, of documents (doc_id, text, lang)."""
    docs = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    index = {p: i for i, p in enumerate(pieces)}
    chance = np.zeros((len(pieces) + 2, len(langs)))
    chance[:-1] = 1 / (len(pieces) + 1)
    if not langs:
        return langs, chance
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(int(1_000_000 * min(1, sample / sizes[lang]))))))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])
    counts = stored(some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).where(F.length("word") <= LEARNED).groupBy("lang", "word").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        now = chance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, longest = np.zeros(now.shape), longest_of(index)
            for batch in batches:
                rows = defaultdict(list)
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows[lang].append((START + word, n))
                for lang, own in rows.items():
                    col = langs.index(lang)
                    for at in _by_length([w for w, _ in own]).values():
                        total[:, col] += expected([own[i][0] for i in at], np.array([own[i][1] for i in at], float), index, now[:, col], longest)
            piece, col = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(col, pa.int32()), pa.array(total[piece, col])], names=["piece", "col", "n"])

        sums = counts.select("lang", "word", "n").mapInArrow(run, "piece int, col int, n double").groupBy("piece", "col").agg(F.sum("n").alias("n")).toArrow()
        chance = np.zeros(now.shape)
        chance[:-1] = SMOOTH
        chance[sums.column("piece").to_numpy(), sums.column("col").to_numpy()] += sums.column("n").to_numpy()
        chance[-1] = 0
        chance /= chance.sum(0)
    return langs, chance


_known: dict[str, object] = {}


class _Scorer:
    """Scores words once each; kept by the worker for later tasks with the same model."""

    def __init__(self, pieces: list[str], chance: np.ndarray):
        self.index, self.chance = {p: i for i, p in enumerate(pieces)}, chance
        self.longest = longest_of(self.index)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.logs = np.zeros((1024, self.chance.shape[1]))
        self.done = 0

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (texts x languages), and which texts have letters."""
        if self.done > MEMORY:
            self._clear()
        at = [np.fromiter(map(self.place.__getitem__, _LETTERS.findall(t.lower() if t else "")), np.int64) for t in texts]
        new = [START + w for w in list(self.place)[self.done :]]
        if self.done + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs[: self.done], np.zeros((len(new) + len(self.logs), self.logs.shape[1]))])
        for rows in _by_length(new).values():
            for a in range(0, len(rows), 4096):
                part = rows[a : a + 4096]
                self.logs[self.done + np.array(part)] = forward([new[i] for i in part], self.index, self.chance, self.longest)
        self.done += len(new)
        return np.stack([self.logs[x].sum(0) for x in at]), np.array([len(x) > 0 for x in at])


def predict(docs: DataFrame, langs: list[str], pieces: list[str], chance: np.ndarray) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, and score, the posterior of that language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = hash((len(pieces), chance.tobytes()))
        if _known.get("tag") != tag:
            _known.update(tag=tag, scorer=_Scorer(pieces, chance))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                logs, letters = _known["scorer"].score(part.column(1).to_pylist())
                if langs:
                    best = logs.argmax(1)
                    score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                names = [langs[best[i]] if langs and letters[i] else "und" for i in range(part.num_rows)]
                values = [float(score[i]) if langs and letters[i] else 0.0 for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Languages of ``docs``, learned from those of its rows whose id's crc32 modulo 4 is not 2."""
    pieces = default_pieces()
    langs, chance = fit(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"), pieces)
    out = predict(docs, langs, pieces, chance)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
