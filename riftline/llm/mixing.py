"""Mixing sources to target weights.

Tokens are summed per source (partial sums before the shuffle), targets follow from the
weights by water filling, and every document is taken ``floor(rate)`` times plus once more
with the probability of the fraction, by a hash of its id. DataFrame functions only.

Defined results: a null text has size 0; null is a source of its own, after all others;
sources of size 0 get target 0; repeated rows of an id draw alike; an empty table gives an
empty result; extra columns are ignored by ``plan`` and kept by ``mix``. Columns whose
names start with ``mix_`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: its size and the words the mix wants of it.

    ``sizes`` has ``source`` and ``size``. Windows here run over one row per source.
    A source is capped at ``most`` times its size; sorted by cap per weight, the capped
    ones are a prefix, and the rest share what is left in proportion to their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        per.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - before) / rest)
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy()))
        .select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _planned(rows: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """Add source_size, target and copies to rows that have doc_id and source."""
    per = per.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    return (
        joined_small(rows, per, rows["source"].eqNullSafe(per["mix_source"]))
        .withColumn("mix_rate", rate)
        .withColumn("mix_copies", (F.floor("mix_rate") + (draw(F.col("doc_id"), seed) < F.col("mix_rate") - F.floor("mix_rate")).cast("int")).cast("int"))
    )


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and copies to take. Reads the texts once."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per = stored(targets(sizes, weights, share, most))
    return _planned(sizes, per, seed).select("doc_id", "source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as ``plan`` says, with the columns of ``docs``."""
    columns = [c for c in docs.columns if not c.startswith("mix_")]
    docs = docs.select(*columns)
    per = stored(targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most))
    taken = _planned(docs, per, seed).where("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*columns)
