"""What a run is reported with: classes of quality, tier counts and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiers


def chimeric_class(percent: Column) -> Column:
    return F.when(percent < 1, "normal").when(percent < 5, "elevated").otherwise("high")


def insert_class(median: Column) -> Column:
    return F.when(median.between(200, 600), "normal").otherwise("atypical")


def summary(counts: dict[str, Column]) -> Column:
    """One sentence on the calls of each tier."""
    high = counts["confirmed"] + counts["validated"] + counts["likely"]
    calls = high + counts["strong_candidate"] + counts["candidate"]
    parts = F.concat_ws(", ", *(F.when(counts[t] > 0, F.format_string(f"%d {t}", counts[t])) for t in ("confirmed", "validated", "likely", "candidate")))
    some = F.format_string("%d translocation call%s: %s.", calls, F.when(calls == 1, "").otherwise("s"), parts)
    return F.when(high == 0, "No high-confidence translocations detected.").otherwise(some)


def qc_report(rows: DataFrame, rate: DataFrame, insert: DataFrame) -> DataFrame:
    """One row: the count of every tier, classes of the chimeric rate (``rate``: rate) and the insert size (``insert``: median_v), and the summary."""
    counts = rows.agg(*(F.count_if(F.col("tier") == t).alias(t) for t in tiers.TIERS))
    one = counts.join(rate.select((F.col("rate") * 100).alias("chimeric_pct"))).join(insert.select("median_v"))  # a row each
    return one.select(
        *tiers.TIERS, F.round("chimeric_pct", 6).alias("chimeric_pct"), chimeric_class(F.col("chimeric_pct")).alias("chimeric_assessment"),
        insert_class(F.col("median_v")).alias("insert_assessment"), summary({t: F.col(t) for t in tiers.TIERS}).alias("summary"),
    )
