"""Exact order statistics of any number of rows: values are counted, ordered by ranges, and found by running sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ordered(rows: DataFrame, value: str) -> tuple[DataFrame, int]:
    """Distinct values as ``value`` with ``n`` times each and the ``upto`` rows at or below, and how many rows there are; nulls are left out.

    Each range is summed in a task of its own; what the driver adds up is a number a range.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = stored(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    below, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        below[part], total = total, total + n
    if not below:
        return placed.withColumn("upto", F.col("n")).drop("part"), 0
    before = F.create_map(*(F.lit(x) for pair in below.items() for x in pair))[F.col("part")]
    within = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return placed.withColumn("upto", within + before).drop("part"), total


def at_ranks(rows: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks, from 0, in ascending order."""
    return _found(*ordered(rows, value), ranks)


def _found(counted: DataFrame, total: int, ranks: list[int]) -> dict[int, float]:
    wanted = [min(max(k, 0), total - 1) for k in ranks] if total else []
    hit = F.array_compact(F.array(*(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.lit(k)) for k in set(wanted))))
    found = {r.k: r[0] for r in counted.select("value", F.explode(hit).alias("k")).collect()} if wanted else {}
    return {k: found[w] for k, w in zip(ranks, wanted, strict=True)} if wanted else {}


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, as SQL's ``percentile`` has them; null without rows."""
    counted, total = ordered(rows, value)
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    held = _found(counted, total, sorted({math.floor(x) for x in places} | {math.ceil(x) for x in places}))
    return [float(held[math.floor(x)]) * (1 - (x - math.floor(x))) + float(held[math.ceil(x)]) * (x - math.floor(x)) for x in places]


def top_share_threshold(rows: DataFrame, value: str, share: float = 0.01) -> float | None:
    """The value that ``share`` of the rows lie above, counted from the greatest; null without rows."""
    counted, total = ordered(rows, value)
    if not total:
        return None
    rank = total - 1 - min(math.floor(total * share), total - 1)
    return counted.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).first()[0]
