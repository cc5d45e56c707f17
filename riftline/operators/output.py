"""Result rows as VCF, BEDPE and summary text, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bnd_alt, chrom_rank
from ..storage import stored
from .evidence import CLUSTER
from .tiers import TIERS


def vcf_rows(calls: DataFrame) -> DataFrame:
    """Two mate rows for each call, at 1-based positions."""
    c = F.col
    mate = lambda here, there, orient, own, other: F.struct(c(here[0]).alias("chrom"), (c(here[1]) + 1).alias("pos"), F.concat(c("event_id"), F.lit(own)).alias("id"), bnd_alt(c(there[0]), c(there[1]) + 1, orient).alias("alt"), F.concat(c("event_id"), F.lit(other)).alias("mate_id"))
    a, b = ("ca", "median_a"), ("cb", "median_b")
    both = F.array(mate(a, b, c("orient"), "_1", "_2"), mate(b, a, F.reverse("orient"), "_2", "_1"))
    return calls.select(F.explode(both).alias("r"), "support").select("r.*", F.format_string("SVTYPE=BND;MATEID=%s;SUPPORT=%d", "r.mate_id", "support").alias("info"))


def bedpe_rows(calls: DataFrame) -> DataFrame:
    """Thirteen BEDPE columns, 0-based half-open, of calls with cluster_id, tier, score and background_p."""
    c = F.col
    strand = lambda k: F.when(c("orient").rlike("^[+-]{2}$"), F.substring("orient", k, 1)).otherwise("+")  # noqa: E731  an orientation that is none counts as ++
    return calls.select(
        c("ca").alias("chrom1"), c("median_a").alias("start1"), (c("median_a") + 1).alias("end1"), c("cb").alias("chrom2"), c("median_b").alias("start2"), (c("median_b") + 1).alias("end2"),
        F.regexp_replace("cluster_id", "^CLU", "TRA").alias("name"), F.format_string("%.4f", "score").alias("score"), strand(1).alias("strand1"), strand(2).alias("strand2"),
        "tier", "support", F.format_string("%.6e", "background_p").alias("bg_pval"),
    )


# fixed values: the header's lines, and the tiers that pass
HEADER = (
    "##fileformat=VCFv4.2",
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=MATEID,Number=1,Type=String,Description="ID of mate breakend">',
    '##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="CI around POS">',
    '##INFO=<ID=SUPPORT,Number=1,Type=Integer,Description="Total supporting reads">',
    '##INFO=<ID=DISCORDANT,Number=1,Type=Integer,Description="Discordant pair support">',
    '##INFO=<ID=SPLIT,Number=1,Type=Integer,Description="Split read support">',
    '##INFO=<ID=CLIPPED,Number=1,Type=Integer,Description="Clipped read support">',
    '##INFO=<ID=BG_PVAL,Number=1,Type=Float,Description="Background model p-value">',
    '##INFO=<ID=TIER,Number=1,Type=String,Description="Call tier">',
    '##INFO=<ID=SCORE,Number=1,Type=Float,Description="Raw score">',
)
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
PASSING = ("confirmed", "validated", "likely")


def vcf_filter(flags: Column) -> Column:
    """PASS for the tiers that pass; for others their flags, or a dot without any."""
    return F.when(F.col("tier").isin(*PASSING), "PASS").when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, F.array_join(flags, ";")).otherwise(".")


def vcf_lines(calls: DataFrame) -> DataFrame:
    """(chrom, pos, value): the two mate lines of each call, with its tier, score, background_p, sr, pr, clips (0 where missing), filter flags and own side's interval.

    Intervals (ci_lo_a and so on) are written relative to the position.
    """
    c = F.col
    clips = c("clips") if "clips" in calls.columns else F.lit(0)
    flags = c("flags") if "flags" in calls.columns else F.array().cast("array<string>")

    def line(here: str, there: str, orient: Column, own: str, other: str) -> Column:
        pos, mate = c(f"median_{here}"), c(f"median_{there}")
        info = F.concat(
            F.lit("SVTYPE=BND;MATEID="), c("event_id"), F.lit(other), F.format_string(";CIPOS=%d,%d", c(f"ci_lo_{here}") - pos, c(f"ci_hi_{here}") - pos),
            F.format_string(";SUPPORT=%d;DISCORDANT=%d;SPLIT=%d;CLIPPED=%d;BG_PVAL=%.6e", c("support"), c("pr"), c("sr"), clips, c("background_p")), F.format_string(";TIER=%s;SCORE=%.4f", c("tier"), c("score")),
        )
        fields = [c(f"c{here}"), (pos + 1).cast("string"), F.concat(c("event_id"), F.lit(own)), F.lit("N"), bnd_alt(c(f"c{there}"), mate + 1, orient), F.lit("."), vcf_filter(flags), info]
        return F.struct(c(f"c{here}").alias("chrom"), (pos + 1).alias("pos"), F.concat_ws("\t", *fields).alias("value"))

    both = F.array(line("a", "b", c("orient"), "_1", "_2"), line("b", "a", F.reverse("orient"), "_2", "_1"))
    return calls.select(F.explode(both).alias("r")).select("r.*")


def write_vcf(calls: DataFrame, path: str, contigs: DataFrame | None = None, reference: str | None = None) -> None:
    """One sorted VCF file; calls are the selected few. ``contigs`` (chrom, length) are listed in the header."""
    spark = calls.sparkSession
    lines = [*HEADER[:1], *([f"##reference={reference}"] if reference else []), *HEADER[1:]]
    head = spark.createDataFrame([(0, 0, i, line) for i, line in enumerate(lines)] + [(2, 0, 0, COLUMNS)], "step int, k int, pos long, value string")
    if contigs is not None:
        head = head.unionByName(contigs.select(F.lit(1).alias("step"), chrom_rank(F.col("chrom")).alias("k"), F.lit(0).cast("long").alias("pos"), F.format_string("##contig=<ID=%s,length=%d>", "chrom", "length").alias("value")))
    body = vcf_lines(calls).select(F.lit(3).alias("step"), chrom_rank(F.col("chrom")).alias("k"), "pos", "value")
    head.unionByName(body).orderBy("step", "k", "pos", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_bedpe(calls: DataFrame, path: str) -> None:
    bedpe_rows(calls).orderBy(chrom_rank(F.col("chrom1")), "start1", chrom_rank(F.col("chrom2")), "start2").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def write_json(calls: DataFrame, path: str) -> None:
    calls.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_summary(calls: DataFrame, path: str) -> None:
    """One JSON object: how many calls there are in all, and of every tier, zeros included."""
    counts = calls.agg(F.count("*").alias("total"), *(F.count_if(F.col("tier") == t).alias(t) for t in TIERS))
    counts.select(F.to_json(F.struct("total", F.struct(*TIERS).alias("by_tier"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_all(calls: DataFrame, folder: str, contigs: DataFrame | None = None) -> None:
    """All results of a run: calls that aren't filtered as VCF, BEDPE and JSON; the summary counts all."""
    calls = stored(calls)
    passing = calls.where("tier <> 'filtered'")
    write_vcf(passing, f"{folder}/translocations.vcf", contigs)
    write_bedpe(passing, f"{folder}/translocations.bedpe")
    write_json(passing, f"{folder}/translocations.json")
    write_summary(calls, f"{folder}/summary.json")


def write_evidence(reads: DataFrame, selected: DataFrame, path: str) -> None:
    """The reads of each selected call (event_id, cluster_id) as JSON, a folder a cluster. ``reads`` have the columns of a cluster's key."""
    own = reads.withColumn("event_id", F.concat_ws("_", *CLUSTER)).join(selected.select("event_id", "cluster_id"), "event_id")
    own.repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").json(path)


def write_matrix(density: DataFrame, contigs: list[str], path: str) -> None:
    """A symmetric table of the reads between contigs (ca, cb, n) as tab-separated text, contigs in their order, zeros included."""
    both = density.select("ca", "cb", "n").union(density.where("ca <> cb").select("cb", "ca", "n"))
    wide = both.groupBy(F.col("ca").alias("chrom")).pivot("cb", contigs).agg(F.sum("n"))
    names = density.sparkSession.createDataFrame([(i, c) for i, c in enumerate(contigs)], "k int, chrom string")
    table = names.join(wide, "chrom", "left").fillna(0, contigs).orderBy("k")
    table.select("chrom", *contigs).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
