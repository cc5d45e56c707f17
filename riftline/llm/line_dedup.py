"""Line dedup: a line goes if an earlier one, in any document, is within one edit of it.

Lines are ordered by document id and number. Equal lines have equal 128-bit hashes, and the
first of them stays. Lines, however short, are then compared by deletion
neighbourhood: each emits hashed keys of itself and of its variants with one character
deleted, and lines with equal keys are joined: equal variants at the same place differ by
one substitution, a variant that equals a whole line by one insertion. Within a key only the
earliest line matters, so a minimum replaces the pairs; the edit distance to it is then
verified on the texts.

One edit leaves the first or the last half of a line as it is, and all but one of its
sixteen segments. So lines emit variants only if they share a half with another, and only
for segments outside of which they equal another. No partner is lost by that.

Defined results: null ids, and null texts or texts without words, stay as they are and drop
nothing; lines of white space are never dropped; a document all of whose other lines are
dropped goes; rows that repeat a document are treated alike; other columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, in_map, stored

SEGMENTS = 16
#: Bits of the map of lines that may have partners; it only spares lines a shuffle, and its size is fixed.
BITS = 1 << 24
_SPACE = " \t\v\f\r"


def _hash(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, str]]:
    """(doc_id, version, number, line) of lines that have words."""
    for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        for no, line in enumerate(text.split("\n")):
            if line.strip(_SPACE):
                yield doc_id, version, no, line


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            rows = [(d, v, n, xxhash.xxh3_128_digest(x.encode())) for d, v, n, x in _lines(batch.slice(a, 1024))]
            hashes = np.frombuffer(b"".join(r[3] for r in rows), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["doc_id", "version", "no", "hi", "lo"])


def _own(line: str) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(line.encode())[:8], "big", signed=True)


def half_keys(line: str) -> list[int]:
    """Keys of which lines within one edit share one: the first and last halves, for either length of a pair."""
    n, out = len(line), []
    for m in (n, n - 1):
        h = m // 2
        out += [_hash(f"a{m}|{line[:h]}".encode()), _hash(f"z{m}|{line[n - h :]}".encode())]
    return out


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            keys, own = [], []
            for line in {x for *_, x in _lines(batch.slice(a, 1024))}:
                keys += half_keys(line)
                own += [_own(line)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64())], names=["half", "hi"])


def segments(line: str) -> Iterator[tuple[int, str]]:
    """(key of all but one segment, that segment), for the line as the shorter and as the longer of a pair."""
    n = len(line)
    for m in (n, n - 1):
        cuts = [k * m // SEGMENTS for k in range(SEGMENTS + 1)]
        for k in range(SEGMENTS):
            a, b = cuts[k], n - (m - cuts[k + 1])
            yield _hash(f"{m}|{k}|{line[:a]}|{line[b:]}".encode()), line[a:b]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = [(k, hi, s) for hi, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k, s in segments(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["rest", "hi", "segment"])


def variants(rest: int, segment: str) -> Iterator[tuple[int, bool]]:
    """Keys of a segment's deletion neighbourhood beside the same rest; True for the whole segment."""
    yield _hash(f"w{rest}|{segment}".encode()), True
    for i in range(len(segment)):
        left = segment[:i] + segment[i + 1 :]
        yield _hash(f"s{rest}|{i}|{left}".encode()), False
        if i == 0 or segment[i] != segment[i - 1]:  # any character of a run gives the same
            yield _hash(f"w{rest}|{left}".encode()), False


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            rows = [(k, hi, w) for rest, hi, s in zip(*(c.to_pylist() for c in part.columns), strict=True) for k, w in variants(rest, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["key", "hi", "whole"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hi, text) of the lines whose hash is in ``wanted`` (hi). A map of bits of fixed size spares most others the shuffle."""
    held = bit_map(wanted, "hi", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                texts = list({x for *_, x in _lines(batch.slice(a, 1024))})
                own = np.fromiter(map(_own, texts), np.int64, len(texts))
                hit = np.flatnonzero(in_map(held, own)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own[hit], pa.int64()), pa.array([texts[i] for i in hit], pa.string())], names=["hi", "text"])

    return docs.mapInArrow(run, "hi long, text string").join(wanted, "hi").dropDuplicates(["hi"])


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key at least two lines have."""
    keys = rows.groupBy(key).agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least < most").select(key)
    return rows.join(keys, key, "left_semi")


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Hashes (hi) of distinct lines within one edit of an earlier one; ``first`` has (hi, at), each line's first place."""
    wanted = stored(_shared(docs.mapInArrow(_halves, "half long, hi long"), "half").select("hi").distinct())
    lines = stored(_texts_of(docs, wanted))
    some = stored(_shared(lines.mapInArrow(_segments, "rest long, hi long, segment string"), "rest"))
    keys = some.mapInArrow(_variants, "key long, hi long, whole boolean").join(first.join(wanted, "hi").select("hi", "at"), "hi")
    keys = stored(_shared(keys, "key").select("key", "at", "hi", "whole"))
    # by the earliest line under each key: whole lines look for variants, variants for whole lines or, at the same place, variants
    place = F.struct("at", "hi")
    least = keys.groupBy("key").agg(F.min(F.when(F.col("whole"), place)).alias("w"), F.min(F.when(~F.col("whole"), place)).alias("v"))
    found = keys.join(least, "key").select("hi", "at", F.explode(F.array("w", "v")).alias("other")).where("other is not null and other.at < at")
    pairs = stored(found.select("hi", F.col("other.hi").alias("earlier")).distinct())
    text = lines.select("hi", "text")
    both = pairs.join(text, "hi").join(text.select(F.col("hi").alias("earlier"), F.col("text").alias("earlier_text")), "earlier")
    return both.where(F.levenshtein("text", "earlier_text", 1) >= 0).select("hi").distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines, gone): number of lines with words, and the numbers of those to drop."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    lines = stored(docs.mapInArrow(_scan, "doc_id long, version long, no int, hi long, lo long"))
    place = F.struct("doc_id", "version", "no")
    first = stored(lines.groupBy("hi", "lo").agg(F.min(place).alias("at")))
    near = near_lines(docs, first)
    marked = first.join(near.withColumn("near", F.lit(True)), "hi", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    gone = F.col("near") | (F.col("at") < place)
    every = lines.join(marked, ["hi", "lo"]).select("doc_id", "version", "no", gone.alias("gone")).distinct()
    return every.groupBy("doc_id", "version").agg(F.count("*").alias("lines"), F.collect_list(F.when(F.col("gone"), F.col("no"))).alias("gone"))


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` without dropped lines, with line_dedup_lines and line_dedup_gone, numbers of lines; documents left empty go."""
    columns = [c for c in docs.columns if not c.startswith("line_dedup_")]
    gone = dropped(docs).select(F.col("doc_id").alias("line_dedup_id"), F.col("version").alias("line_dedup_version"), "lines", F.col("gone").alias("line_dedup_nos"))
    gone = gone.withColumnRenamed("lines", "line_dedup_lines")
    on = (F.col("doc_id") == F.col("line_dedup_id")) & (F.xxhash64("text") == F.col("line_dedup_version"))
    rows = docs.select(*columns).join(gone, on, "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("line_dedup_nos", i)), "\n")
    size = F.coalesce(F.size("line_dedup_nos"), F.lit(0))
    size = F.when(size > 0, size).otherwise(F.lit(0)).cast("long")
    lines = F.coalesce("line_dedup_lines", F.lit(0)).cast("long")
    rows = rows.withColumn("line_dedup_gone", size).withColumn("line_dedup_lines", lines).where("line_dedup_lines = 0 or line_dedup_gone < line_dedup_lines")
    text = F.when(F.col("line_dedup_gone") > 0, left).otherwise(F.col("text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(c) for c in columns], "line_dedup_lines", "line_dedup_gone")
