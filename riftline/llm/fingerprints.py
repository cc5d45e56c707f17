"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest distinct 48-bit hashes of a text's
five-word shingles (fewer words: the whole text is one shingle; no words: an empty sketch).
Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles.

Defined results: a null text counts as empty; two empty sketches resemble each other
fully, an empty and another one not at all; equal texts have equal sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

K = 128
SHINGLE = 5
SPACE = float(2**48)
#: Documents are dealt by ranges of ids, about so many to a range, in at most so many ranges.
RANGE_ROWS, RANGES = 100, 4096


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Add the sketch of column ``text`` as ``out``.

    Only hashes under a bound that k distinct ones are expected to fall below are sorted;
    a text with too many repeats to have k there has all of its hashes sorted.
    """
    w, h, low = f"{out}__w", f"{out}__h", f"{out}__low"
    starts = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))))
    hashed = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col(w), i, F.lit(SHINGLE))), 16))
    bound = (F.lit(SPACE) * F.lit(k + 6 * math.sqrt(k) + 20) / F.greatest(F.size(h), F.lit(1))).cast("long")
    return (
        df.withColumn(w, words(F.lower(text)))
        .withColumn(h, hashed)
        .withColumn(low, F.array_distinct(F.filter(h, lambda x: x < bound)))
        .withColumn(out, F.slice(F.sort_array(F.when(F.size(low) >= k, F.col(low)).otherwise(F.array_distinct(h))), 1, k))
        .drop(w, h, low)
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of the union of two shingle sets; exact where the union has at most k."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact under k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * SPACE) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has too; 1 for an empty a."""
    j = resemblance(a, b, k)
    share = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def printed(a: Column) -> Column:
    """A sketch as text: twelve hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most the id, found by a coarse and a fine step; null ids are in range 0."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda b: b <= doc_id))
    fine = F.size(F.filter(F.element_at(F.array(*map(longs, parts)), F.greatest(coarse, F.lit(1))), lambda b: b <= doc_id))
    return F.when(doc_id.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with its sketch, and the text and sketch of the next by id (after the last: the first).

    Documents are dealt by ranges of ids between approximate quantiles, so that no global
    sort is needed; the first document of each range is also dealt, as a guest, to the range
    before it. Null ids come first; rows that share an id are ordered by text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = min(RANGES, n // RANGE_ROWS) + 1
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] if cuts else []
    dealt = docs.withColumn("range", _range_of(F.col("doc_id"), sorted(set(bounds or []))) if bounds else F.lit(0))
    key = F.struct(F.col("doc_id"), F.col("text"))
    # one row per range: its first document, which is the guest of the range before
    ids = dealt.groupBy("range").agg(F.min("doc_id").alias("first_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    ids = stored(ids.select("range", F.when(F.col("nulls") == 0, F.col("first_id")).alias("first_id")))
    order = Window.orderBy("range")
    turn = ids.select("range", "first_id", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("host"))
    guests = (
        dealt.join(F.broadcast(turn), dealt["doc_id"].eqNullSafe(turn["first_id"]) & (dealt["range"] == turn["range"]))
        .groupBy("host").agg(F.min(key).alias("d")).select(F.col("d.doc_id"), F.col("d.text"), F.col("host").alias("range"), F.lit(True).alias("guest"))
    )
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests).repartition("range")
    rows = with_sketch(rows, "text", "sketch")
    ahead = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_sketch", F.lead("sketch").over(ahead))
        .where(~F.col("guest")).drop("guest", "range")
    )


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each document and of its edited text, with both likenesses.

    Edited: the last half (rounded down) of the code points replaced by as many, or all, of
    the next document's first.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
