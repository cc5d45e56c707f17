"""Collocations: phrases of two or three words that stand together more often than by chance, by language.

Texts are cut into pieces at punctuation and line ends, and pieces into words. The pieces of a
language are dealt to shards of a bounded number of positions, with a gap between pieces. A shard keeps for each of its words
the bitmap of its positions, compressed: frequent words as packed bits, all others as ascending positions. A phrase's
bitmap marks where its last word stands; shifted by one and ANDed with a word's bitmap it is that of the longer
phrase, and the number of bits left is how often that one occurs. Phrases are extended depth-first,
a few first words at a time; shards' counts are summed by Spark.

A phrase can't be frequent if one of its words or its pairs isn't. So words are counted first, then pairs of frequent
words, then triples of frequent pairs. What is frequent is told to the shards as a map of bits, of a
bounded size: where it is full it lets rare phrases through, which are dropped when their counts are summed. So counts are exact.

A shard starts with the last two positions of the one before, as context: phrases that end there aren't counted again.
So pieces of any length are cut into shards without losing a phrase.

Defined results: a null text counts as empty; a null lang is ``und``, and one with those that are named so; repeated rows count each;
phrases without a word don't exist; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import packed, unpacked
from .common import bit_map, in_map, joined_small, stored
from .shingles import mixed

#: Least count of a phrase; parts in a hundred of a phrase's count at which a longer one replaces it; phrases to a language.
LEAST, REPLACED, MOST = 10, 50, 2000
#: Positions to a shard, and positions of first words that are extended at once.
SHARD, BATCH = 1 << 20, 1 << 17
#: Words that stand in one of so many positions have packed bits.
DENSE = 64
#: Bytes of a text that are split at once.
STEP = 1 << 20
#: Bits of a map: sixteen for each key, and no more than the second number.
MAP_BITS = (1 << 16, 1 << 27)

_CUT = bytes(0x0A if chr(c) in ".,;:!?\n\v\f\r" else 0x20 if c == 0x09 else c for c in range(256))
_WORDS = "lang string, positions int, context int, words array<string>, counts array<int>, sizes array<int>, dense int, bits binary, sparse binary"


class _Stream:
    """The words of one language, as numbers by position; 0 is a gap."""

    def __init__(self, lang: str, most: int, dense: int):
        self.lang, self.most, self.dense = lang, most, dense
        self._open([])

    def _open(self, before: list[bytes]) -> None:
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[b"\n"] = 0
        self.ids = [np.array([self.words[w] for w in before], np.int64)]
        self.length, self.context = len(before), len(before)

    def add(self, text: str) -> Iterator[pa.RecordBatch]:
        data = text.encode().lower().translate(_CUT)  # bytes.lower changes A-Z only
        a = 0
        while a < len(data):
            b = data.find(b" ", a + STEP) if len(data) - a > STEP else -1
            b = b if b >= 0 else len(data)
            own = filter(None, data[a:b].replace(b"\n", b" \n ").split(b" "))
            ids = np.fromiter(map(self.words.__getitem__, own), np.int64)
            a = b
            yield from self._put(ids)
        yield from self._put(np.zeros(1, np.int64))

    def _put(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        while len(ids):
            room = self.most - self.length
            part, ids = ids[:room], ids[room:]
            self.ids.append(part)
            self.length += len(part)
            if self.length >= self.most:
                names = list(self.words)
                rest = [names[i] for i in ids]
                last = [names[i] for i in np.concatenate(self.ids)[-2:]]
                yield self.closed()
                self._open(last)
                ids = np.fromiter((self.words[w] for w in rest), np.int64, len(rest))

    def closed(self) -> pa.RecordBatch:
        """The shard: words by falling count, with their bitmaps."""
        ids, names = np.concatenate(self.ids), list(self.words)
        size = np.bincount(ids, minlength=len(names))
        order = np.argsort(-size[1:], kind="stable")
        place = np.full(len(names), -1)
        place[order + 1] = np.arange(len(order))
        at, sizes = place[ids], size[order + 1]
        used = int((sizes > 0).sum())
        counts = np.bincount(at[self.context :][at[self.context :] >= 0], minlength=len(order))
        dense = int((sizes * self.dense >= max(len(at), self.dense**2)).sum())
        bits = b"".join(np.packbits(at == w, bitorder="little").tobytes() for w in range(dense))
        by_word = np.argsort(at, kind="stable")[int((at < 0).sum()) + int(sizes[:dense].sum()) :]
        step = np.diff(by_word, prepend=0)
        first = np.cumsum(sizes[dense:used]) - sizes[dense:used]
        step[first] = by_word[first]
        words = [names[i + 1].decode() for i in order[:used]]
        of = lambda x, kind: pa.array([x], kind)
        columns = [pa.array([self.lang]), of(len(at), pa.int32()), of(self.context, pa.int32()), of(words, pa.list_(pa.string())), of(counts[:used], pa.list_(pa.int32())), of(sizes[:used], pa.list_(pa.int32()))]
        columns += [of(dense, pa.int32()), of(zstandard.compress(bits, 3), pa.binary()), of(packed(step), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "positions", "context", "words", "counts", "sizes", "dense", "bits", "sparse"])


def shards(docs: DataFrame, most: int = SHARD, dense: int = DENSE) -> DataFrame:
    """The shards of ``docs`` (text, lang), each a row with its words and their compressed bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, _Stream] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in streams:
                    streams[lang] = _Stream(lang, most, dense)
                yield from streams[lang].add(text.as_py())
                if sum(s.length for s in streams.values()) > 4 * most:  # of many languages
                    yield from (s.closed() for s in streams.values())
                    streams.clear()
        yield from (s.closed() for s in streams.values())

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _WORDS)


class Shard:
    """A shard's bitmaps, unpacked."""

    def __init__(self, row: dict):
        self.lang, self.positions, self.context = row["lang"], row["positions"], row["context"]
        self.words, sizes, self.dense = pa.array(row["words"], pa.string()), np.array(row["sizes"], np.int64), row["dense"]
        width = (self.positions + 7) // 8
        rows = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8).reshape(self.dense, width)
        bits = np.zeros((self.dense, 8 * (width // 8 + 1)), np.uint8)  # whole words of 64 bits, with room for a shift
        bits[:, :width] = rows
        self.bits = bits.view(np.uint64)
        step = unpacked(row["sparse"]).astype(np.int64)
        ends = np.cumsum(sizes[self.dense :])
        first = ends - sizes[self.dense :]
        run = np.cumsum(step)
        sparse = run - np.repeat(run[first] - step[first], sizes[self.dense :]) if len(step) else step
        #: ascending positions of each word, one word after the other, and where each word's begin
        self.held = np.concatenate([*(self.marked(b) for b in self.bits), sparse]).astype(np.int64)
        self.begin = np.r_[0, np.cumsum(sizes)]
        self.at = np.full(self.positions + 1, -1)
        self.at[self.held] = np.repeat(np.arange(len(sizes)), sizes)
        own = np.full(len(self.bits[0]) if self.dense else 0, ~np.uint64(0))
        if self.dense and self.context:
            own[0] = ~np.uint64((1 << self.context) - 1)
        self.own = own  # positions after the context

    def marked(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little"))

    def keys(self) -> np.ndarray:
        return word_keys(self.lang, self.words.to_pylist())

    def phrases(self, longest: int, passes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of ``longest`` words that ``passes`` lets through on the way, and how often each ends after the context."""
        cuts = np.unique(np.r_[np.searchsorted(self.begin, np.arange(0, len(self.held), BATCH)), self.dense, len(self.begin) - 1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            words = np.arange(a, b)
            held, size = self.held[self.begin[a] : self.begin[b]], np.diff(self.begin[a : b + 1])
            yield from self._sparse(words[:, None], held, size, longest, passes, b <= self.dense)
        for w in range(self.dense):
            yield from self._dense(np.array([w]), self.bits[w], longest, passes)

    def _sparse(self, phrases: np.ndarray, held: np.ndarray, size: np.ndarray, longest: int, passes, apart: bool) -> Iterator:
        """Extends phrases by positions. ANDing a shifted list of positions with all words' bitmaps is to look up which word
        stands there; ``apart``: words with packed bits are left to ``_dense``."""
        of, then = np.repeat(np.arange(len(phrases)), size), held + 1
        word = self.at[then]
        on = word >= (self.dense if apart else 0)
        of, then, word = of[on], then[on], word[on]
        order = np.argsort(of * len(self.words) + word, kind="stable")
        of, then, word = of[order], then[order], word[order]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (word[1:] != word[:-1])]) if len(of) else np.zeros(0, np.int64)
        longer = np.c_[phrases[of[new]], word[new]]
        many = np.diff(np.r_[new, len(of)])
        keep = passes(longer)
        if longer.shape[1] < longest:
            on = np.repeat(keep, many)
            if keep.any():
                yield from self._sparse(longer[keep], then[on], many[keep], longest, passes, False)
        elif len(new):
            counts = np.add.reduceat(then >= self.context, new)
            keep &= counts > 0
            yield longer[keep], counts[keep]

    def _dense(self, phrase: np.ndarray, bits: np.ndarray, longest: int, passes) -> Iterator:
        """Extends a phrase by the words with packed bits: shift, AND, popcount."""
        shifted = bits << np.uint64(1)
        shifted[1:] |= bits[:-1] >> np.uint64(63)
        longer = np.c_[np.repeat(phrase[None], self.dense, 0), np.arange(self.dense)]
        keep = passes(longer)
        for words in longer[keep]:
            both = shifted & self.bits[words[-1]]
            if len(words) == longest:
                count = int(np.bitwise_count(both & self.own).sum())
                if count:
                    yield words[None], np.array([count])
            elif both.any():
                held = self.marked(both)
                yield from self._sparse(words[None], held, np.array([len(held)]), longest, passes, True)
                yield from self._dense(words, both, longest, passes)


def word_keys(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(3) + (second ^ (second >> np.uint64(32))))


def _map_of(known: DataFrame) -> np.ndarray:
    """A map of the keys of phrases (lang, phrase) of one or two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = word_keys(lang, phrase.split(" "))
                keys.append(k[0] if len(k) == 1 else _pair_keys(k[:1], k[1:])[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())], names=["key"])

    least, most = MAP_BITS
    bits = min(most, max(least, 1 << (16 * known.count()).bit_length()))
    return bit_map(known.select("lang", "phrase").mapInArrow(run, "key long"), "key", bits)


def _counted(index: DataFrame, longest: int, frequent: np.ndarray) -> DataFrame:
    """(lang, phrase, f) of the phrases of so many words, all of whose words (of three: pairs) are in the map, with a sum of LEAST at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                key = shard.keys()
                word = in_map(frequent, key)
                passes = (lambda p: word[p[:, -2]] & word[p[:, -1]]) if longest == 2 else (lambda p: in_map(frequent, _pair_keys(key[p[:, -2]], key[p[:, -1]])))  # noqa: B023
                found, held = [], 0
                for part in shard.phrases(longest, passes):
                    found.append(part)
                    held += len(part[1])
                    if held > BATCH:
                        yield from _rows(shard, found)
                        found, held = [], 0
                yield from _rows(shard, found)

    def _rows(shard: Shard, found: list) -> Iterator[pa.RecordBatch]:
        phrases, counts = np.concatenate([p for p, _ in found] or [np.zeros((0, longest), np.int64)]), np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)])
        for a in range(0, len(counts), 1 << 15):
            part = phrases[a : a + (1 << 15)]
            text = pc.binary_join_element_wise(*(shard.words.take(pa.array(part[:, k])) for k in range(longest)), " ")
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(part)), text, pa.array(counts[a : a + len(part)], pa.int64())], names=["lang", "phrase", "f"])

    columns = index.select("lang", "positions", "context", "words", "sizes", "dense", "bits", "sparse")
    return columns.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def score() -> Column:
    """A million times a*a over l*r, rounded down; exact for counts below 10**15, where longs would overflow."""
    return F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def _best(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each language, with their ranks. Parts of a language are cut down first, so that no task gets all of it."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(1024))
    for parts in (1024, 32):
        own = Window.partitionBy("lang", "part").orderBy(*order)
        df = df.withColumn("part", part % parts).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    return df.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, most: int = MOST, shard: int = SHARD, dense: int = DENSE) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a (its count), l and r (its parts' counts), n (words of the language), score."""
    index = stored(shards(docs, shard, dense))
    words = stored(index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= LEAST)
    pairs = stored(_counted(index, 2, _map_of(words)))
    triples = stored(_counted(index, 3, _map_of(pairs)))
    # every way to cut a phrase in two
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    rest, most_of = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"), F.substring_index("phrase", " ", 2)
    cuts = pairs.select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), first.alias("left"), last.alias("right"))
    for k, x, y in ((1, first, rest), (2, most_of, last)):
        cuts = cuts.unionByName(triples.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), x.alias("left"), y.alias("right")))
    known = words.unionByName(pairs)
    cuts = joined_small(cuts, known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = joined_small(cuts, known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", score()).groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a pair gives way to a triple around it that is frequent enough
    around = triples.select("lang", F.explode(F.array(most_of, rest)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    scored = joined_small(scored, around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < REPLACED * F.col("a")))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = _best(scored, [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return joined_small(best, total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
