"""Joins of clusters with counts, intervals, external calls and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from ..storage import stored
from .evidence import PART, dealt, matched


def ends(reads: DataFrame) -> DataFrame:
    """Both ends of each read, as (chrom, pos, partner)."""
    both = F.array(F.struct(F.col("chrom"), F.col("pos"), F.col("mate_chrom").alias("partner")), F.struct(F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"), F.col("chrom").alias("partner")))
    return reads.select(F.explode(both).alias("e")).select("e.*")


def end_bins(reads: DataFrame, size: int = DEFAULTS.annotation_bin) -> DataFrame:
    """Per bin: ends, and distinct partner contigs."""
    return ends(reads).groupBy("chrom", F.floor(F.col("pos") / size).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.countDistinct("partner").alias("partners"))


def chrom_medians(bins: DataFrame) -> DataFrame:
    return bins.groupBy("chrom").agg(F.median("n").alias("median_n"))


def local_coverage(clusters: DataFrame, bins: DataFrame, size: int = DEFAULTS.annotation_bin) -> DataFrame:
    """Adds, for each side, the ratio of its bin's count to the contig's median, and the partner contigs there."""
    rate = bins.join(chrom_medians(bins), "chrom").select("chrom", "bin", (F.col("n") / F.greatest("median_n", F.lit(1))).alias("lcr"), "partners")
    out = clusters
    for s in "ab":
        own = rate.select(F.col("chrom").alias(f"c{s}"), F.col("bin").alias(f"bin_{s}"), F.col("lcr").alias(f"lcr_{s}"), F.col("partners").alias(f"partners_{s}"))
        out = out.withColumn(f"bin_{s}", F.floor(F.col(f"median_{s}") / size).cast("long")).join(own, [f"c{s}", f"bin_{s}"], "left").drop(f"bin_{s}")
    return out.fillna({"lcr_a": 0.0, "lcr_b": 0.0, "partners_a": 0, "partners_b": 0})


def pair_enrichment(density: DataFrame, contigs: int) -> DataFrame:
    """A pair's count against an even share of all pairs."""
    total = F.sum("n").over(Window.partitionBy())
    return density.withColumn("enrichment", F.col("n") / F.greatest(total / max(contigs * (contigs - 1) / 2, 1), F.lit(1.0)))


def merged_intervals(masks: DataFrame, parts: int | None = None) -> DataFrame:
    """Disjoint intervals per track and contig; touching ones are joined.

    Starts are dealt to parts, each merged on its own; what begins in a part may touch what the parts before
    reach, which a row a part tells. ``parts``: see ``evidence.dealt``.
    """
    key = ["track", "chrom"]
    placed = dealt(masks.withColumn("part", F.floor(F.col("start_pos") / PART).cast("long")), [*key, "part"], parts)
    own = Window.partitionBy(*key, "part").orderBy("start_pos")
    before = F.max("end_pos").over(own.rangeBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start_pos") > before), F.col("start_pos"))
    grouped = placed.withColumn("isl", F.max(opens).over(own.rangeBetween(Window.unboundedPreceding, 0)))
    merged = stored(grouped.groupBy(*key, "part", "isl").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("isl"))
    up = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = merged.groupBy(*key, "part").agg(F.max("start_pos").alias("last"), F.max("end_pos").alias("reach")).withColumn("reach", F.max("reach").over(up))
    # where the interval that reaches furthest begins: a part whose last start lies beyond the reach before it opens it
    told = told.withColumn("begun", F.max(F.when(F.col("reach").isNull() | (F.col("last") > F.col("reach")), F.col("last"))).over(up)).drop("last")
    joined = matched(merged, told, [*key, "part"]).withColumn("isl", F.when(F.col("start_pos") <= F.col("reach"), F.col("begun")).otherwise(F.col("start_pos")))
    return joined.groupBy(*key, "isl").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("isl")


def stabbed(clusters: DataFrame, intervals: DataFrame, margin: int = 0, size: int = 100_000) -> DataFrame:
    """(event_id, side, track) for each side's position in an interval, closed at both ends.

    Intervals are dealt to the bins they touch, so that the join has equal keys.
    """
    cut = lambda x: F.floor(x / size).cast("long")
    binned = intervals.withColumn("bin", F.explode(F.sequence(cut(F.col("start_pos") - margin), cut(F.col("end_pos") + margin))))
    side = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"c{s}").alias("chrom"), F.col(f"median_{s}").alias("pos")) for s in "ab"))
    points = clusters.select("event_id", F.explode(side).alias("p")).select("event_id", "p.*").withColumn("bin", cut(F.col("pos")))
    return points.join(binned, ["chrom", "bin"]).where(F.col("pos").between(F.col("start_pos") - margin, F.col("end_pos") + margin)).select("event_id", "side", "track").distinct()


def best_identity(segdups: DataFrame) -> DataFrame:
    """Highest identity of the duplications that touch each 1 kb bin."""
    kb = lambda c: F.floor(F.col(c) / 1000).cast("long")
    return segdups.withColumn("bin", F.explode(F.sequence(kb("start_pos"), kb("end_pos")))).groupBy("chrom", "bin").agg(F.max("pct_identity").alias("max_pct"))


def with_identity(clusters: DataFrame, best: DataFrame) -> DataFrame:
    """Adds segdup_pct_a and segdup_pct_b, the highest identity of the duplications in each side's 1 kb bin; 0 where there are none."""
    out = clusters
    for s in "ab":
        own = best.select(F.col("chrom").alias(f"c{s}"), F.col("bin").alias(f"kb_{s}"), F.col("max_pct").alias(f"segdup_pct_{s}"))
        out = out.withColumn(f"kb_{s}", F.floor(F.col(f"median_{s}") / 1000).cast("long")).join(own, [f"c{s}", f"kb_{s}"], "left").drop(f"kb_{s}")
    return out.fillna({"segdup_pct_a": 0.0, "segdup_pct_b": 0.0})


def banded(left: DataFrame, right: DataFrame, band: int = DEFAULTS.band) -> DataFrame:
    """Pairs with equal contigs whose positions differ by at most ``band`` on both sides.

    ``left`` has ca, cb, median_a, median_b; ``right`` chrom_a, chrom_b, pos_a, pos_b. The
    right side is dealt to the bins around its first position.
    """
    near = right.withColumn("band_bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("pos_a") / band).cast("long") + d)))
    own = left.withColumn("band_bin", F.floor(F.col("median_a") / band).cast("long"))
    on = (own["ca"] == near["chrom_a"]) & (own["cb"] == near["chrom_b"]) & (own["band_bin"] == near["band_bin"])
    close = (F.abs(F.col("median_a") - F.col("pos_a")) <= band) & (F.abs(F.col("median_b") - F.col("pos_b")) <= band)
    return own.join(near, on & close).drop("band_bin")


def external_support(clusters: DataFrame, bnds: DataFrame, band: int = DEFAULTS.band) -> DataFrame:
    """Distinct callers near each cluster, in either order of the call's sides."""
    calls = bnds.where("chrom_a <> chrom_b").select("caller", "chrom_a", "pos_a", "chrom_b", "pos_b")
    both = calls.unionByName(calls.select("caller", F.col("chrom_b").alias("chrom_a"), F.col("pos_b").alias("pos_a"), F.col("chrom_a").alias("chrom_b"), F.col("pos_a").alias("pos_b")))
    return banded(clusters, both, band).groupBy("event_id").agg(F.countDistinct("caller").alias("n_ext"))


def reciprocal(clusters: DataFrame, band: int = DEFAULTS.band) -> DataFrame:
    """(event_id, partner) of clusters of opposite orientation within the band: the first partner by id."""
    opposite = F.translate("orient", "+-", "-+")
    other = clusters.select(F.col("event_id").alias("partner"), F.col("ca").alias("chrom_a"), F.col("cb").alias("chrom_b"), F.col("median_a").alias("pos_a"), F.col("median_b").alias("pos_b"), opposite.alias("wants"))
    return banded(clusters, other, band).where("orient = wants").groupBy("event_id").agg(F.min("partner").alias("partner"))
