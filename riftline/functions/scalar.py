"""Column functions: names, tags, CIGARs, orientations, breakend notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_chrom(name: Column, prefix: bool = True) -> Column:
    """Contig name without or with ``chr``; MT is M."""
    bare = F.when(F.lower(F.substring(name, 1, 3)) == "chr", F.substring(name, F.lit(4), F.length(name))).otherwise(name)
    bare = F.when(F.upper(bare) == "MT", F.lit("M")).otherwise(bare)
    return F.concat(F.lit("chr"), bare) if prefix else bare


def parsed_sa(tag: Column) -> Column:
    """SA tag to array<struct<chrom,pos,strand,cigar,mapq,nm>>; entries that lack a part or a number are left out."""
    def entry(p: Column) -> Column:
        get = lambda i: F.get(p, F.lit(i))
        return F.struct(get(0).alias("chrom"), get(1).try_cast("long").alias("pos"), get(2).alias("strand"), get(3).alias("cigar"), get(4).try_cast("int").alias("mapq"), get(5).try_cast("int").alias("nm"))

    parts = F.transform(F.split(tag, ";"), lambda x: F.split(x, ","))  # once an entry, not once a part
    return F.filter(F.transform(parts, entry), lambda e: e["pos"].isNotNull() & e["mapq"].isNotNull() & e["nm"].isNotNull())


def cigar_bases(cigar: Column, ops: str) -> Column:
    """The sum of the lengths of a CIGAR's operations among ``ops``."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), lambda x: x.cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def aligned_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR consumes: the sum of its M, D, N, = and X lengths."""
    return cigar_bases(cigar, "MDN=X")


def clip_side_length(cigar: Column) -> Column:
    """struct<side,len> of the longer terminal soft clip, the left one on a tie; null without clips."""
    left = F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    right = F.when(cigar.endswith("S"), F.coalesce(F.regexp_extract(cigar, r"(\d+)S$", 1).try_cast("int"), F.lit(0))).otherwise(0)
    return F.when((left > 0) | (right > 0), F.struct(F.when(left >= right, "left").otherwise("right").alias("side"), F.greatest(left, right).alias("len")))


def name_hash(name: Column) -> Column:
    return F.substring(F.md5(name.cast("binary")), 1, 12)


def name_number(hashed: Column) -> Column:
    """The number that a name's hash writes in hexadecimal; 0 if it is none."""
    return F.when(hashed.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(hashed, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def parsed_region(text: Column) -> Column:
    """struct<chrom,pos> of contig:position; null if it isn't that."""
    p = F.split(text, ":")
    pos = F.get(p, F.lit(1)).try_cast("long")
    return F.when((F.size(p) == 2) & pos.isNotNull(), F.struct(normalized_chrom(F.get(p, F.lit(0))).alias("chrom"), pos.alias("pos")))


def orientation(reverse: Column, mate_reverse: Column) -> Column:
    return F.concat(F.when(reverse, "-").otherwise("+"), F.when(mate_reverse, "-").otherwise("+"))


def bnd_mate(alt: Column) -> Column:
    """struct<chrom,pos> of a breakend's mate; null for other alleles."""
    pattern = r"[\[\]]([^:\[\]]+):(\d+)[\[\]]"
    return F.when(alt.rlike(pattern), F.struct(F.regexp_extract(alt, pattern, 1).alias("chrom"), F.regexp_extract(alt, pattern, 2).cast("long").alias("pos")))


def bnd_alt(chrom: Column, pos: Column, orient: Column, base: str = "N") -> Column:
    """A breakend allele for 1-based ``pos`` of the mate."""
    place = F.concat(chrom, F.lit(":"), pos.cast("string"))
    shape = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return (
        F.when(orient == "++", shape(base, "[", place, "[")).when(orient == "+-", shape(base, "]", place, "]"))
        .when(orient == "-+", shape("]", place, "]", base)).otherwise(shape("[", place, "[", base))
    )


def chrom_rank(chrom: Column) -> Column:
    """1-22, X, Y, M, then the rest."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = bare.try_cast("int")
    return F.when(number.between(1, 22), number).when(bare == "X", 23).when(bare == "Y", 24).when(bare == "M", 25).otherwise(999)


def worst_p(a: Column, b: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(1.0)), F.coalesce(b, F.lit(1.0)))
