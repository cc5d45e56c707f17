"""Evidence rows from raw records: names with and without chr, reasons, repeats, odd records."""

from riftline.operators import evidence, reads
from riftline.sources import alignments

SCHEMA = alignments.SCHEMA


def record(qname="r", flag=0, chrom="chr1", pos=100, mapq=60, cigar="100M", mate_chrom="chr2", mate_pos=500, tlen=0, seq=None, sa=None):
    return (qname, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, tlen, seq, sa)


def judged(spark, *rows):
    return sorted((r.evidence_type, r.chrom, r.pos, r.mate_chrom, r.mate_pos, r.reason) for r in reads.judged(spark.createDataFrame(list(rows), SCHEMA)).collect())


def test_names_with_and_without_chr_are_one(spark):
    plain = [record(chrom="1", mate_chrom="2", sa="2,700,-,50M,60,0;chr1,9,+,90M,60,0;"), record("s", chrom="X", mate_chrom="chrX")]
    named = [record(chrom="chr1", mate_chrom="chr2", sa="chr2,700,-,50M,60,0;1,9,+,90M,60,0;"), record("s", chrom="chrX", mate_chrom="X")]
    want = [("discordant", "chr1", 100, "chr2", 500, None), ("split", "chr1", 100, "chr2", 700, None)]
    assert judged(spark, *plain) == judged(spark, *named) == want
    assert reads.primary(spark.createDataFrame(plain + named, SCHEMA)).count() == 4
    both = spark.createDataFrame([plain[0], named[0]], SCHEMA)
    assert reads.evidence_rows(both).count() == 2  # the same read twice


def test_reasons_and_repeats(spark):
    rows = [
        record("a", pos=300), record("a", pos=100), record("a", pos=200, mate_chrom="chr3"),  # one read to two contigs
        record("b", sa="chrUn,1,+,90M,60,0;chr5,1,+,90M,19,0;chr5,2,+,29M,60,0;chr5,3,+,90M,60,0;chr5,4,+,90M,60,0;chr5,x,+,90M,60,0;", mate_chrom=None),
        record("c", flag=0x400, sa="chr5,3,+,90M,60,0;"), record("d", flag=0x800), record("e", mapq=19), record("f", flag=8), record("g", flag=4), record("h", chrom="chrM"),
    ]
    assert judged(spark, *rows) == [
        ("discordant", "chr1", 100, "chr2", 500, None), ("discordant", "chr1", 200, "chr3", 500, None), ("discordant", "chr1", 300, "chr2", 500, "dedup"),
        ("split", "chr1", 100, "chr5", 1, "sa_mapq_low(19)"), ("split", "chr1", 100, "chr5", 2, "aligned_too_short(pri=100,sa=29,min=30)"),
        ("split", "chr1", 100, "chr5", 3, None), ("split", "chr1", 100, "chr5", 4, "dedup"), ("split", "chr1", 100, "chrUn", 1, "non_primary_chrom"),
    ]


def test_repeats_that_are_level_give_one_row_however_they_come(spark):
    level = [record("a", tlen=700), record("a", tlen=-300), record("b", mate_chrom=None, sa="chr5,3,-,90M,60,0;"), record("b", mate_chrom=None, sa="chr5,3,+,90M,60,0;")]
    for rows in (level, level[::-1]):
        got = reads.evidence_rows(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
        assert sorted((r.evidence_type, r.insert_size, r.mate_is_reverse) for r in got) == [("discordant", 300, False), ("split", None, False)]


def test_clips_count_whatever_else_a_record_is(spark):
    rows = [
        record("a", flag=0x410, mapq=0, cigar="25S50M20S", mate_chrom=None, seq="A" * 25 + "C" * 50 + "G" * 20), record("a", mapq=0, cigar="5S50M30S", mate_chrom="chr1", seq="A" * 5 + "C" * 50 + "G" * 30),
        record("b", mapq=0, cigar="19S50M", mate_chrom=None), record("c", mapq=0, cigar=None, mate_chrom=None), record("d", mapq=0, cigar="40S9M", mate_chrom=None, seq=None), record("d", mapq=0, cigar="40S9M", mate_chrom=None),
    ]
    got = sorted(((r.clip_side, r.clip_len, r.clip_seq, r.is_reverse) for r in reads.evidence_rows(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([("left", 25, "A" * 25, True), ("right", 30, "G" * 30, False), ("left", 40, None, False), ("left", 40, None, False)], key=str)


def test_clusters_from_raw_records(spark):
    rows = [record(f"d{i}", pos=1_000_000 + i, mate_pos=2_000_000 + i, mate_chrom="2", chrom="1") for i in range(4)]
    rows += [record(f"s{i}", pos=1_000_010 + i, mate_chrom=None, sa=f"chr2,{2_000_010 + i},+,60M,60,0;", cigar="60M60S") for i in range(3)]
    found = reads.evidence_rows(spark.createDataFrame(rows, SCHEMA))
    c = evidence.clusters(evidence.clustered(evidence.cascade(evidence.canonical(found.where("evidence_type <> 'clip'"))))).collect()
    assert [(r.ca, r.cb, r.support, r.sr, r.pr) for r in c] == [("chr1", "chr2", 7, 3, 4)]
    assert found.where("evidence_type = 'clip'").count() == 3
    assert reads.judged(spark.createDataFrame([], SCHEMA)).count() == 0
