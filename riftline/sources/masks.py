"""The mask set: tables of a genome browser as they are downloaded, and a folder of BED tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# fixed values: per kind of table the fewest columns of a row, and which column names the interval
TABLES = {"centromere": (4, None), "gap": (8, 7), "segdup": (27, None), "simple_repeat": (4, 16)}
#: The tracks of a mask set and their files.
TRACKS = {
    "centromere": "centromeres.bed", "telomere": "telomeres.bed", "encode_blacklist": "encode_blacklist_v2.bed", "segdup": "segdups.bed",
    "simple_repeat": "simple_repeats.bed", "gap": "gaps.bed", "acrocentric_p_arm": "acrocentric_p_arms.bed",
}


def browser_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Intervals (track, chrom, start_pos, end_pos, name, pct_identity) of a tab-separated table, plain or gzipped.

    A row has its contig and bounds in columns 1 to 3, behind a bin number. Duplications are named by their other copy, and
    have its identity in percent, 0 where the share isn't a number. Rows with too few columns or without bounds are left out.
    """
    least, name = TABLES[kind]
    p = F.split("value", "\t")
    get = lambda i: F.get(p, F.lit(i))
    named = F.coalesce(get(name), F.lit(kind)) if name else F.lit(kind)
    identity = F.lit(None).cast("double")
    if kind == "segdup":
        named = F.concat(get(7), F.lit(":"), get(8), F.lit("-"), get(9))
        identity = F.coalesce(F.round(get(26).try_cast("double") * 100, 1), F.lit(0.0))
    rows = spark.read.text(path).where(F.size(p) >= least)
    rows = rows.select(F.lit(kind).alias("track"), get(1).alias("chrom"), get(2).try_cast("long").alias("start_pos"), get(3).try_cast("long").alias("end_pos"), named.alias("name"), identity.alias("pct_identity"))
    return rows.where("start_pos is not null and end_pos is not null")


def mask_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The intervals of all tracks of a folder, and a row (track, warning) for each track whose file is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there, missing = [], []
    for track, name in TRACKS.items():
        path = hadoop(f"{folder}/{name}")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if found:
            there.append(files.bed(spark, f"{folder}/{name}", track))
        else:
            missing.append((track, f"no file {name}"))
    rows = spark.createDataFrame([], "track string, chrom string, start_pos long, end_pos long, pct_identity double")
    for track in there:
        rows = rows.unionByName(track)
    return rows, spark.createDataFrame(missing, "track string, warning string")
