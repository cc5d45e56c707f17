"""Text sources: BED intervals, breakend VCF, SAM, truth events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bnd_mate


def bed(spark: SparkSession, path: str, track: str) -> DataFrame:
    """Intervals of a BED file; comments, track lines and rows without two numbers are left out."""
    p = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track|browser|$)"))
    return rows.select(F.lit(track).alias("track"), F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).try_cast("long").alias("start_pos"), F.get(p, F.lit(2)).try_cast("long").alias("end_pos"), F.get(p, F.lit(4)).try_cast("double").alias("pct_identity")).where("start_pos is not null and end_pos is not null")


def bnd_vcf(spark: SparkSession, path: str, caller: str) -> DataFrame:
    """Interchromosomal breakends of a VCF, plain or gzipped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.get(p, F.lit(0)).alias("chrom_a"), F.get(p, F.lit(1)).try_cast("long").alias("pos_a"), bnd_mate(F.get(p, F.lit(4))).alias("mate"), F.get(p, F.lit(7)).alias("info"))
    return rows.where("mate is not null and pos_a is not null and mate.chrom <> chrom_a").select(F.lit(caller).alias("caller"), "chrom_a", "pos_a", F.col("mate.chrom").alias("chrom_b"), F.col("mate.pos").alias("pos_b"), "info")


def sam(spark: SparkSession, path: str, min_mapq: int = 10) -> DataFrame:
    """Mapped records of SAM text: qname, flag, chrom, pos, mapq."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(p) >= 11))
    rows = rows.select(p[0].alias("qname"), p[1].try_cast("int").alias("flag"), p[2].alias("chrom"), p[3].try_cast("long").alias("pos"), p[4].try_cast("int").alias("mapq"))
    return rows.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("mapq") >= min_mapq))


def truth(spark: SparkSession, path: str) -> DataFrame:
    schema = "events array<struct<chrom_a:string,pos_a:long,chrom_b:string,pos_b:long,label:string,match_window:long>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("events").alias("event_no", "e")).select("event_no", "e.*")
