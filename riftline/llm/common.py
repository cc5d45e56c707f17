"""Helpers shared by the corpus operators: reading, shared scratch tables, word columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, noted, shared_dir, stored  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: Bytes of a batch of rows that a task hands to Python; by default Spark makes them of 10,000 rows, however long.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Sets the session's bound for Arrow batches, so that a task's memory doesn't grow with the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def joined_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``small`` by broadcast if it has few rows, else by shuffle (where AQE splits hot keys)."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def bit_map(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """A map of ``bits`` bits (a multiple of 64) in which those of the long keys are set. Its size doesn't depend on the rows."""
    word = F.floor(F.pmod(key, F.lit(bits)) / 64).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")
    found = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set: all keys of the map's rows, and by chance others."""
    at = keys.astype(np.int64) % (64 * len(held))
    return (held[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
