"""Which alignment records are evidence: contigs, flags, split partners, clips, insert sizes, regions.

Records have flag, chrom, pos, mapq, mate_chrom, tlen, cigar and sa (the SA tag, null without one); for evidence rows
also qname, mate_pos and seq. Contigs are the same with and without ``chr`` in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..settings import DEFAULTS
from .evidence import dealt

# fixed values: contigs that count as primary, and flag bits
PRIMARY = (*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY")
PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x2, 0x4, 0x8, 0x10, 0x20
SECONDARY, DUPLICATE, SUPPLEMENTARY, BAD = 0x100, 0x400, 0x800, 0xF00


def has(*bits: int) -> Column:
    """Whether the flag has any of these bits."""
    return F.coalesce(F.col("flag"), F.lit(0)).bitwiseAND(sum(bits)) != 0


def named(column: str) -> Column:
    """A contig column with ``chr`` in front, whatever the file calls it."""
    return scalar.normalized_chrom(F.col(column))


def primary(records: DataFrame, contigs: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Mapped records on a primary contig, both contig columns with ``chr`` in front."""
    out = records.where(~has(UNMAPPED) & named("chrom").isin(*contigs)).withColumn("chrom", named("chrom"))
    return out.withColumn("mate_chrom", named("mate_chrom")) if "mate_chrom" in records.columns else out


def is_discordant(min_mapq: int = DEFAULTS.min_mapq, contigs: tuple[str, ...] = PRIMARY) -> Column:
    """A good record whose mate is mapped to another primary contig; null columns make it false."""
    other = named("mate_chrom").isin(*contigs) & (named("mate_chrom") != named("chrom"))
    return F.coalesce(~has(BAD) & (F.col("mapq") >= min_mapq) & ~has(MATE_UNMAPPED) & other, F.lit(False))


def is_split(min_mapq: int = DEFAULTS.min_mapq) -> Column:
    """A primary alignment with an SA tag."""
    return F.coalesce((F.col("mapq") >= min_mapq) & ~has(SECONDARY, DUPLICATE, SUPPLEMENTARY) & F.col("sa").isNotNull(), F.lit(False))


def is_clipped(least: int = DEFAULTS.min_clip_length) -> Column:
    """A record with a terminal soft clip of at least ``least`` bases."""
    return F.coalesce(scalar.clip_side_length(F.col("cigar"))["len"] >= least, F.lit(False))


def partners(splits: DataFrame, min_mapq: int = DEFAULTS.min_mapq, least: int = DEFAULTS.min_split_aligned, contigs: tuple[str, ...] = PRIMARY) -> DataFrame:
    """A row per SA entry on another contig, with ``reason``: why it is no evidence, null if it is.

    Both alignments must span ``least`` bases and three tenths of the read: the record by the bases of
    the read, the entry by the bases of the reference.
    """
    rows = splits.withColumn("s", F.explode(scalar.parsed_sa(F.col("sa"))))
    rows = rows.withColumns({"near": _near(), "needed": _needed(least), "sa_chrom": scalar.normalized_chrom(F.col("s.chrom"))}).where(F.col("sa_chrom") != named("chrom"))
    rows = rows.withColumn("far", scalar.aligned_length(F.col("s.cigar")))
    return rows.withColumn("reason", _entry_reason(F.col("s.mapq"), F.col("sa_chrom"), F.col("near"), F.col("far"), F.col("needed"), min_mapq, contigs))


def _near() -> Column:
    """Bases of the read that the record aligns."""
    return scalar.cigar_bases(F.col("cigar"), "MI=X")


def _needed(least: int) -> Column:
    """Bases that each alignment of a split read must span: some, and three tenths of the read."""
    return F.greatest(F.lit(least).cast("long"), F.floor(scalar.cigar_bases(F.col("cigar"), "MIS=X") * F.lit(0.3)))


def _entry_reason(mapq: Column, chrom: Column, near: Column, far: Column, needed: Column, min_mapq: int, contigs: tuple[str, ...]) -> Column:
    short = F.format_string("aligned_too_short(pri=%d,sa=%d,min=%d)", near, far, needed)
    return F.when(~chrom.isin(*contigs), "non_primary_chrom").when(mapq < min_mapq, F.format_string("sa_mapq_low(%d)", mapq)).when((near < needed) | (far < needed), short)


#: The kinds of evidence that a record may give.
KINDS = ("discordant", "split", "clip")


def judged(records: DataFrame, settings=DEFAULTS, contigs: tuple[str, ...] = PRIMARY, kinds: tuple[str, ...] = KINDS, parts: int | None = None) -> DataFrame:
    """All rows of evidence of some ``kinds`` that raw records give, with ``reason``: why one isn't counted, null if it is.

    A record gives a row if it is discordant, one for each SA entry on another contig if it is split, and one if it is
    clipped, whatever else it is. Discordant and split rows count once for a read's name, contig and mate contig (in
    this order, so that both mates count): the first by position and entry, then by what else they hold, so that reruns
    agree. Split positions of the mate are the tag's, 1-based.
    ``parts``: see ``evidence.dealt``.
    """
    rows = primary(records, contigs)
    gives = {"discordant": is_discordant(settings.min_mapq, contigs), "split": is_split(settings.min_mapq), "clip": is_clipped(settings.min_clip_length)}
    entry = "struct<chrom:string,pos:bigint,strand:string,cigar:string,mapq:int,nm:int>"
    alone = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("entry"), F.lit(None).cast(entry).alias("s")))
    listed = {k: alone(k) for k in KINDS} | {"split": F.transform(scalar.parsed_sa(F.col("sa")), lambda s, i: F.struct(F.lit("split").alias("kind"), i.alias("entry"), s.alias("s")))}
    nothing = F.slice(alone("clip"), 1, 0)
    rows = rows.withColumn("e", F.explode(F.concat(*(F.when(gives[k], listed[k]).otherwise(nothing) for k in kinds)))).select("*", "e.*")
    # what only one kind needs is found for its rows alone
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    rows = rows.withColumns({
        "mate_chrom": F.coalesce(of("split", scalar.normalized_chrom(F.col("s.chrom"))), of("discordant", F.col("mate_chrom"))), "clip": of("clip", scalar.clip_side_length(F.col("cigar"))),
        "near": of("split", _near()), "needed": of("split", _needed(settings.min_split_aligned)), "far": of("split", scalar.aligned_length(F.col("s.cigar"))),
    }).where((F.col("kind") != "split") | (F.col("mate_chrom") != F.col("chrom")))
    side, length = F.col("clip.side"), F.col("clip.len")
    seq = F.when(side == "left", F.substring("seq", F.lit(1), length)).otherwise(F.substring(F.col("seq"), F.length("seq") - length + 1, length))
    reason = _entry_reason(F.col("s.mapq"), F.col("mate_chrom"), F.col("near"), F.col("far"), F.col("needed"), settings.min_mapq, contigs)
    rows = rows.select(
        scalar.name_hash(F.col("qname")).alias("read_name_hash"), "chrom", "pos", "mapq", "flag", has(REVERSE).alias("is_reverse"), F.col("kind").alias("evidence_type"), "mate_chrom",
        F.coalesce(F.col("s.pos"), of("discordant", F.col("mate_pos"))).alias("mate_pos"), F.col("s.mapq").alias("mate_mapq"),
        F.coalesce(of("split", F.col("s.strand") == "-"), of("discordant", has(MATE_REVERSE))).alias("mate_is_reverse"), of("discordant", F.abs("tlen").cast("long")).alias("insert_size"),
        side.alias("clip_side"), length.alias("clip_len"), of("clip", seq).alias("clip_seq"), of("split", reason).alias("reason"), "entry",
    )
    if kinds == ("clip",):
        return rows.drop("entry")
    # of the rows that nothing else speaks against, the first counts; clips have no mate and all count
    name = ["read_name_hash", "chrom", "mate_chrom", "evidence_type"]
    order = [F.col("reason").isNotNull(), "pos", "entry", "mate_pos", "mapq", "flag", "mate_mapq", "insert_size", "mate_is_reverse"]  # all that such rows may differ in
    own = Window.partitionBy(*name).orderBy(*order)
    again = (F.row_number().over(own) > 1) & (F.col("evidence_type") != "clip")
    return dealt(rows, name, parts).withColumn("again", again).withColumn("reason", F.coalesce("reason", F.when(F.col("again"), "dedup"))).drop("again", "entry")


def evidence_rows(records: DataFrame, settings=DEFAULTS, contigs: tuple[str, ...] = PRIMARY, kinds: tuple[str, ...] = KINDS, parts: int | None = None) -> DataFrame:
    """The rows of ``judged`` that count: discordant, split and clip evidence, or some of these ``kinds``, in one table."""
    return judged(records, settings, contigs, kinds, parts).where("reason is null").drop("reason")


def insert_sizes(records: DataFrame) -> DataFrame:
    """Good proper pairs on one contig with a positive template length; all of them, none sampled."""
    return records.where(has(PROPER) & ~has(UNMAPPED, MATE_UNMAPPED, BAD) & (named("chrom") == named("mate_chrom")) & (F.col("tlen") > 0))


def anomalous_contigs(reads: DataFrame, disc: DataFrame, share: float = 0.05) -> DataFrame:
    """Contigs of which more than ``share`` of the reads are discordant."""
    per = lambda rows, name: rows.groupBy("chrom").agg(F.count("*").alias(name))
    return per(reads, "reads").join(per(disc, "discordant"), "chrom").where(F.col("discordant") / F.col("reads") > share)


def in_regions(reads: DataFrame, regions: list[str], margin: int = 2_000_000) -> DataFrame:
    """Reads within ``margin`` of one of a few places, each written contig:position; others are left out."""
    near = F.lit(False)
    for region in regions:
        place = scalar.parsed_region(F.lit(region))
        near = near | F.coalesce((named("chrom") == place["chrom"]) & F.col("pos").between(place["pos"] - margin, place["pos"] + margin), F.lit(False))
    return reads.where(near)
