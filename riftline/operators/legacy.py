"""The first-generation rules: coverage background, soft flags, penalties, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from . import annotate, background, tiers

# fixed values: what each soft flag takes from the score
PENALTIES = {"centromere_proximity": 30, "telomere_proximity": 30, "blacklist": 50, "segdup": 20, "high_local_coverage": 10, "uneven_support": 5, "acrocentric_parm": 30, "single_orientation": 15, "high_background_p": 0}
#: What a background p above each bound takes, from the greatest down; and what a clip and a read of an absorbed call add.
BACKGROUND = ((0.1, 20), (0.01, 10), (0.001, 5))
CLIP, RECIPROCAL = 2.0, 4.0
TELOMERE = 500_000
CENTROMERE = 1_000_000


def coverage_bins(reads: DataFrame, size: int = DEFAULTS.telemetry_bin, length: int = DEFAULTS.contig_length) -> DataFrame:
    """Ends per bin, positions clamped to the contig."""
    inside = F.least(F.greatest(F.col("pos"), F.lit(0)), F.lit(length - 1))
    return annotate.ends(reads).groupBy("chrom", F.floor(inside / size).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def pair_bins(canon: DataFrame, size: int = DEFAULTS.telemetry_bin) -> DataFrame:
    return canon.groupBy("ca", "cb", *(F.floor(F.col(f"pos_{s}") / size).cast("long").alias(f"bin_{s}") for s in "ab")).agg(F.count("*").alias("n"))


def noise_floor(pairs: DataFrame) -> DataFrame:
    """One row: bin pairs, and the median of their counts plus three median deviations (of at least 1)."""
    mid = pairs.agg(F.median("n").alias("m"))
    spread = F.greatest(F.median(F.abs(F.col("n") - F.col("m"))), F.lit(1.0))
    return pairs.join(F.broadcast(mid)).agg(F.count("*").alias("bin_pairs"), (F.max("m") + 3 * spread).alias("noise_floor"))  # mid is one row


def rate(reads: DataFrame, disc: DataFrame, size: int = DEFAULTS.telemetry_bin) -> DataFrame:
    """One row: reads, those between contigs, occupied bins, and the second for each pair of bins."""
    seen = reads.agg(F.count("*").alias("reads"))
    between = disc.agg(F.count("*").alias("interchrom"))
    bins = annotate.ends(disc).select("chrom", F.floor(F.col("pos") / size)).distinct().agg(F.count("*").alias("bins"))
    return seen.join(between).join(bins).withColumn("rate", F.round(F.col("interchrom") / (F.greatest("bins", F.lit(1)) * F.greatest("bins", F.lit(1))), 9))


def significance(clusters: DataFrame, coverage: DataFrame, pairs: DataFrame, chimeric: float, noise: float, size: int = DEFAULTS.telemetry_bin) -> DataFrame:
    """Adds ``expected``, ``suppressed``, ``p`` and ``background_p`` to clusters.

    Expected are the product of both sides' coverage (``coverage_bins``) and the rate of chimeric pairs, over the
    bins that have any. p is the Poisson tail of the support. A cluster is suppressed, with p 1, where its pair of bins
    (``pair_bins``) has at least the noise floor and the support isn't above twice that count. background_p is p
    adjusted for all clusters.
    """
    cells = coverage.count()
    out = clusters
    for s in "ab":
        out = out.withColumn(f"bin_{s}", F.floor(F.greatest(F.col(f"median_{s}"), F.lit(0)) / size).cast("long"))
        out = out.join(coverage.select(F.col("chrom").alias(f"c{s}"), F.col("bin").alias(f"bin_{s}"), F.col("n").alias(f"coverage_{s}")), [f"c{s}", f"bin_{s}"], "left")
    out = out.join(pairs.withColumnRenamed("n", "noise"), ["ca", "cb", "bin_a", "bin_b"], "left").fillna({"coverage_a": 0, "coverage_b": 0, "noise": 0})
    expected = F.col("coverage_a") * F.col("coverage_b") * F.lit(float(max(chimeric, 0.0))) / F.lit(float(max(1, cells)))
    out = out.withColumn("expected", expected).withColumn("suppressed", (F.col("noise") > 0) & (F.col("noise") >= noise) & (F.col("support") <= 2 * F.col("noise")))
    out = out.withColumn("tail", background.poisson_p(F.col("support").cast("double"), "expected"))
    p = F.when(F.col("suppressed"), 1.0).when(F.col("expected") <= 0, F.when(F.col("support") > 0, 0.0).otherwise(1.0)).otherwise(F.col("tail"))
    out = out.withColumn("p", p).drop("tail", "bin_a", "bin_b", "coverage_a", "coverage_b", "noise")
    return background.bh_adjusted(out, "p", "background_p")


def flagged(clusters: DataFrame, masks: DataFrame, length: int = DEFAULTS.contig_length, parts: int | None = None) -> DataFrame:
    """Adds ``flags``, an array of soft flags in the order of ``PENALTIES``.

    Acrocentric arms are the masks' track acrocentric_p_arm. Two flags need columns that clusters may have: single_orientation
    (whether all reads have one strand) and background_p. ``parts``: tasks for the masks, see ``evidence.dealt``.
    """
    merged = annotate.merged_intervals(masks, parts)
    near = annotate.stabbed(clusters, merged.where("track = 'centromere'"), CENTROMERE, CENTROMERE).select("event_id", F.lit("centromere_proximity").alias("flag"))
    names = F.when(F.col("track") == "segdup", "segdup").when(F.col("track") == "encode_blacklist", "blacklist").when(F.col("track") == "acrocentric_p_arm", "acrocentric_parm")
    inside = annotate.stabbed(clusters, merged.where("track in ('segdup', 'encode_blacklist', 'acrocentric_p_arm')")).select("event_id", names.alias("flag"))
    hit = near.unionByName(inside).groupBy("event_id").agg(F.collect_set("flag").alias("hit"))
    partners = annotate.reciprocal(clusters).join(clusters.select(F.col("event_id").alias("partner"), F.col("support").alias("partner_support")), "partner")
    c = clusters.join(hit, "event_id", "left").join(partners.select("event_id", "partner_support"), "event_id", "left")
    has = lambda flag: F.coalesce(F.array_contains("hit", flag), F.lit(False))
    end = lambda s: (F.col(f"median_{s}") <= TELOMERE) | (F.col(f"median_{s}") >= length - TELOMERE)
    uneven = F.greatest("support", "partner_support") > 3 * F.least("support", "partner_support")
    held = {
        "centromere_proximity": has("centromere_proximity"), "telomere_proximity": end("a") | end("b"), "blacklist": has("blacklist"), "segdup": has("segdup"),
        "high_local_coverage": F.col("support") > 100, "uneven_support": F.col("partner_support").isNotNull() & uneven,
        "acrocentric_parm": has("acrocentric_parm"), "single_orientation": F.col("single_orientation") if "single_orientation" in clusters.columns else F.lit(False),
        "high_background_p": F.col("background_p") > BACKGROUND[-1][0] if "background_p" in clusters.columns else F.lit(False),
    }
    return c.withColumn("flags", F.array_compact(F.array(*(F.when(held[f], f) for f in PENALTIES)))).drop("hit", "partner_support")


def hard_filter() -> Column:
    return F.when(F.col("support") < 2, "low_support").when(F.coalesce("median_mapq", F.lit(0)) < 10, "low_mapq")


def penalised(clip: Column | None = None, reciprocal: Column | None = None, background_p: Column | None = None) -> Column:
    """The linear score with clips and the reads of an absorbed call, less the penalties of the flags and of a high background."""
    taken = sum((F.when(F.array_contains("flags", f), p).otherwise(0) for f, p in PENALTIES.items()), F.lit(0))
    out = tiers.v1_score() - taken
    for more, weight in ((clip, CLIP), (reciprocal, RECIPROCAL)):
        out = out if more is None else out + weight * F.coalesce(more, F.lit(0))
    if background_p is None:
        return out
    step = F.lit(0)
    for bound, p in reversed(BACKGROUND):
        step = F.when(background_p > bound, p).otherwise(step)
    return out - step


def tier(clip: Column | None = None, score: Column | None = None) -> Column:
    """The tier of a cluster with ``flags``; ``clip``: its clips, a third kind of evidence; ``score``: see ``penalised``."""
    c = F.col
    severe, single = F.array_contains("flags", "blacklist"), F.array_contains("flags", "single_orientation")
    starts = (c("starts_a") >= 2) & (c("starts_b") >= 2)
    kinds = sum(((F.coalesce(x, F.lit(0)) > 0).cast("int") for x in (c("sr"), c("pr"), F.lit(0) if clip is None else clip)), F.lit(0))
    score = penalised() if score is None else score
    return (
        F.when(hard_filter().isNotNull(), "filtered")
        .when((c("sr") >= 3) & (c("pr") >= 5) & (c("median_mapq") >= 30) & starts & ~severe & ~single, "confirmed")
        .when((kinds >= 2) & (c("support") >= 8) & (c("median_mapq") >= 25) & ~severe, "validated")
        .when((c("support") >= 5) & (c("median_mapq") >= 20) & (score > 15), "likely").otherwise("candidate")
    )
