"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ten consecutive words of a benchmark item; an item of fewer words is one window.
Of the hashes of the grams within a window, the smallest is its fingerprint, on both sides
alike: texts that share a window share its fingerprint, whatever stands around it. So
every shared span of ten words is found, though of a text only the runs of windows with one
fingerprint are joined with the benchmark's fingerprints, about two in seven places. Runs that meet one
are extended to their windows, and these are compared with the benchmark's word for word.

Windows of each length are fingerprinted alone (grams of half the length, rounded up, and
five words for ten), so short items are found as surely as long ones.

Defined results: a null or empty text has no words and is clean; an item without words has no
windows; items of equal text all count; rows that share an item_id are one item of all their windows; a null
item_id marks words, but is no item of the lists; rows that repeat a doc_id are judged each by
their own text; other columns are ignored. Empty tables give an empty result, an empty benchmark leaves all texts clean.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Words of a window. Items with fewer are one window of all their words.
SPAN = 10
#: Fingerprints of eight bytes that may be broadcast (about 64 MB in memory); more are joined by shuffle.
BROADCAST_PRINTS = 1_000_000
#: What stands between words of a lower-cased text, and of any text.
BETWEEN, BETWEEN_CASED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of letters, digits and whatever is outside of ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _paired(values: str, apart: int, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of each value and the one so many places after it."""
    n = F.greatest(F.size(values) - apart, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + apart), n), lambda a, b: both(a, b))


def _spread(df: DataFrame, column: str, width: int, both: Callable[[Column, Column], Column]) -> DataFrame:
    """Folds each run of ``width`` values into one, by doubling; the last step overlaps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        df = df.withColumn(column, _paired(column, step, both))
        done += step
    return df


def with_winnowed(df: DataFrame, words: str, out: str, span: int = SPAN) -> DataFrame:
    """Add the fingerprints of all windows of ``span`` words, in order: each window's smallest gram hash."""
    gram = (span + 1) // 2
    df = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    df = _spread(df, out, gram, lambda a, b: F.xxhash64(a, b))
    return _spread(df, out, span - gram + 1, lambda a, b: F.least(a, b))


def _runs(prints: str, span: int) -> Column:
    """The runs of windows with one fingerprint, as structs: span, print, and the first and last window's place (from 1)."""
    first = f"{prints}_first"
    starts = F.col(first)
    run = lambda a, i: F.struct(F.lit(span).alias("span"), F.get(prints, a - 1).alias("print"), a.alias("a"), F.coalesce(F.get(starts, i + 1) - 1, F.size(prints)).alias("b"))
    return F.transform(starts, run)


def _starts(prints: str) -> Column:
    """Where a window's fingerprint isn't that of the window before."""
    at = F.when(F.size(prints) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(prints), F.lit(1))))
    return F.filter(at, lambda i: (i == 1) | (F.get(prints, i - 1) != F.get(prints, i - 2)))


def windows(items: DataFrame) -> DataFrame:
    """(item_id, span, print, window) for each window of each item, once; a window is its words with spaces between."""
    items = items.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    spans = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect())  # ten at most
    out = None
    for span in spans:
        own = with_winnowed(items.where(F.size("words") >= SPAN if span == SPAN else F.size("words") == span), "words", "prints", span)
        # of an array that isn't a plain column Spark infers no filter, which it would push below and so fold the hashes twice
        placed = F.transform("prints", lambda p, i: F.struct(p.alias("print"), (i + 1).alias("a")))
        own = own.select("item_id", "words", F.explode(placed).alias("at"))
        own = own.select("item_id", F.lit(span).alias("span"), "at.print", F.array_join(F.slice("words", F.col("at.a"), span), " ").alias("window"))
        out = own if out is None else out.unionByName(own)
    return out.distinct() if out is not None else items.select("item_id", F.lit(SPAN).alias("span"), F.lit(0).cast("long").alias("print"), F.lit("").alias("window"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, a, span, item_id): each place of a text where a window of an item stands, for each such item.

    ``text_key`` tells apart rows that share a doc_id.
    """
    known = stored(windows(items))
    spans = sorted(r[0] for r in known.select("span").distinct().collect())  # ten at most
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    rows = keyed.select("doc_id", "text_key", item_words(F.col("text")).alias("words"))
    for span in spans:
        rows = with_winnowed(rows, "words", f"prints_{span}", span).withColumn(f"prints_{span}_first", _starts(f"prints_{span}"))
    none = F.array().cast("array<struct<span:int,print:long,a:int,b:int>>")
    rows = rows.select("doc_id", "text_key", F.explode(F.concat(none, *(_runs(f"prints_{span}", span) for span in spans))).alias("run")).select("doc_id", "text_key", "run.*")
    met = rows.join(_small(known.select("span", "print").distinct(), BROADCAST_PRINTS), ["span", "print"], "left_semi")
    met = stored(met.select("doc_id", "text_key", "span", "a", "b").distinct())  # equal rows are one
    # the runs of a text come together: no more than it has places
    together = met.groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.collect_list(F.struct("span", "a", "b")).alias("runs"))
    together = F.broadcast(together) if met.count() <= BROADCAST_ROWS else together
    texts = keyed.join(together, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    texts = texts.select("doc_id", "text_key", item_words(F.col("text")).alias("words"), "runs")
    placed = texts.select("doc_id", "text_key", "words", F.explode("runs").alias("run")).select("doc_id", "text_key", "words", "run.span", F.explode(F.sequence("run.a", "run.b")).alias("a"))
    placed = placed.select("doc_id", "text_key", "a", "span", F.array_join(F.slice("words", F.col("a"), F.col("span")), " ").alias("window"))
    return placed.join(_small(known.select("item_id", "span", "window"), BROADCAST_ROWS), ["span", "window"]).select("doc_id", "text_key", "a", "span", "item_id")


def checked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = matches(docs, items).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
    found = found.agg(F.sort_array(F.collect_set(F.struct("a", "span"))).alias("places"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # the words of all places, from left to right: those after the last one counted
    counted = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda s, p: F.struct(
            (s["n"] + F.greatest(p["a"] + p["span"] - 1 - F.greatest(s["until"], p["a"] - 1), F.lit(0))).alias("n"),
            F.greatest(s["until"], p["a"] + p["span"] - 1).alias("until"),
        ),
    )
    found = stored(found.select("hit_id", "hit_key", counted["n"].cast("long").alias("hit"), "items"))
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN_CASED), "")).cast("long")
    own = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), n_words.alias("n_words"))
    out = own.join(_small(found, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
    )
