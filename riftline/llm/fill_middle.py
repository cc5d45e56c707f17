"""Fill-in-middle: each text cut in three at seeded token boundaries, and its middle moved to the end.

Equal texts are cut from one entry of an index of distinct texts. The index groups rows by
their whole content, and holds the text, how many tokens it has and where each ends, as
an Elias-Fano list: a few bits a token, of which any one is found without unpacking the rest. An entry knows its
documents, and each takes the two ends that its own seed chooses.
A text with many copies has several entries, a bounded number of documents to each, so that no task gets all of them.

Tokens are runs of A-Z and a-z, and all other code points one by one.

Defined results: a null text counts as empty; empty texts and those with one of the marks in them
stay as they are (form ``plain``); a null doc_id seeds as an empty one; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_small

SEED = "1"
#: Documents to an entry of the index, about.
COPIES = 200
#: fixed values: marks of prefix, suffix and middle; parts in a hundred that are transformed, and that have the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST = 90, 20

_HEAD = struct.Struct("<QB")


def token_ends(text: str) -> np.ndarray:
    """Code points before the end of each token."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    inside = np.zeros(len(points), bool)  # a letter before a letter ends nothing
    inside[:-1] = letter[:-1] & letter[1:]
    return np.flatnonzero(~inside) + 1


def packed_list(values: np.ndarray) -> bytes:
    """An Elias-Fano list of ascending numbers.

    The low bits of each stand side by side; the high ones say in unary how far each is from the one before.
    """
    n = len(values)
    low = max(0, math.floor(math.log2(max(1, int(values[-1])) / n))) if n else 0
    bits = (values[:, None] >> np.arange(low)[::-1] & 1).astype(np.uint8) if low else np.zeros(0, np.uint8)
    unary = np.zeros((int(values[-1] >> low) + n if n else 0) + 1, np.uint8)
    unary[(values >> low) + np.arange(n)] = 1
    lows = np.packbits(bits.reshape(-1)).tobytes()
    return _HEAD.pack(n, low) + lows + np.packbits(unary, bitorder="little").tobytes()


def listed(packed: bytes, at: int) -> int:
    """The number at a place (from 0) of an Elias-Fano list."""
    n, low = _HEAD.unpack_from(packed)
    if not 0 <= at < n:
        raise IndexError(at)
    lows = _HEAD.size
    highs = lows + (n * low + 7) // 8
    ones = np.cumsum(np.bitwise_count(np.frombuffer(packed, np.uint8, offset=highs)), dtype=np.int64)
    byte = int(np.searchsorted(ones, at, "right"))  # the first byte with more than ``at`` ones up to its end
    left = at - (int(ones[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, 1, highs + byte), bitorder="little"))[left])
    first, last = at * low, at * low + low
    own = int.from_bytes(packed[lows + first // 8 : lows + (last + 7) // 8]) >> (-last % 8) & ((1 << low) - 1)
    return (byte * 8 + bit - at) << low | own


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("ends", T.BinaryType()))
def _boundaries(text: pd.Series) -> pd.DataFrame:
    ends = [token_ends(t) for t in text]
    return pd.DataFrame({"n": [len(e) for e in ends], "ends": [packed_list(e) for e in ends]})


@F.pandas_udf(T.StructType().add("first", T.LongType()).add("second", T.LongType()))
def _selected(ends: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    at = [[listed(e, int(k) - 1) if k else 0 for e, k in zip(ends, place, strict=True)] for place in (first, second)]
    return pd.DataFrame({"first": at[0], "second": at[1]}, dtype="int64")


def _draw(k: int) -> Column:
    """The k-th number, of 32 bits, that a document's seed gives."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def index(keyed: DataFrame) -> DataFrame:
    """The entries of rows (doc_id, key, part, text): for each distinct text in them key, part, text, doc_ids, n tokens and ends, an Elias-Fano list.

    Texts are dealt once, by key and part, and are equal if they are so byte for byte; an entry has about COPIES documents.
    """
    texts = keyed.repartition("key", "part").groupBy("key", "part", "text").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    return texts.withColumn("made", _boundaries("text")).select("key", "part", "text", "docs", "made.n", "made.ends")


def transformed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    many = keyed.groupBy("key").count().where(F.col("count") > COPIES).select("key", F.ceil(F.col("count") / COPIES).alias("parts"))
    # a text's copies are dealt to its entries by their ids
    keyed = joined_small(keyed, many, "key", "left").select("doc_id", "text", "key", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).alias("part"))
    rows = index(keyed).select("text", "n", "ends", F.explode(F.col("docs.doc_id")).alias("doc_id"))
    plain = (F.col("text") == "") | (_draw(3) % 100 >= RATE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(_draw(4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = _draw(1) % (F.col("n") + 1), _draw(2) % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), _selected("ends", F.least(a, b), F.greatest(a, b)).alias("cut"))
    first, middle = F.col("cut.first").cast("int"), (F.col("cut.second") - F.col("cut.first")).cast("int")
    parts = [F.expr("left(text, cast(cut.first as int))"), F.substring("text", first + 1, middle), F.expr("substring(text, cast(cut.second + 1 as int))")]
    prefix, mid, suffix = parts
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), mid))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), mid))
        .otherwise(F.col("text"))
    )
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, first.cast("long")).alias("prefix_chars"), F.when(cut, middle.cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # a text that was cut has none of the marks itself
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transformed``, with SHA-256 of the output and of the text restored from it in the output's place."""
    rows = transformed(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
