"""A BAM file that the test writes: read whole, by ranges, by contig, with and without its index."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from riftline.sources import alignments

CONTIGS = [("1", 5_000_000), ("chr2", 3_000_000), ("X", 1_000_000), ("GL000", 5000), ("MT", 16569)]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def encoded(r):
    qname, flag, ref, pos, mapq, cigar, mate, mate_pos, tlen, seq, sa = r
    ops = [(int(n), alignments.CIGAR.index(o)) for n, o in cigar]
    packed = bytes(alignments.BASES.index(a) << 4 | alignments.BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=True))
    tags = b"NMC\x03XBBs" + struct.pack("<I2h", 2, 1, -2) + b"XAAx" + (b"SAZ" + sa.encode() + b"\0" if sa else b"") + b"XFf" + struct.pack("<f", 1.5)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos, tlen)
    body += qname.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + b"\x1e" * len(seq) + tags
    return struct.pack("<I", len(body)) + body


def written(path, records, size, order="coordinate", contigs=CONTIGS):
    """Writes the file and its index; blocks hold ``size`` bytes, so records go over their ends."""
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    data = b"BAM\x01" + struct.pack("<I", len(text)) + text + struct.pack("<I", len(contigs))
    for name, length in contigs:
        data += struct.pack("<I", len(name) + 1) + name.encode() + b"\0" + struct.pack("<I", length)
    starts, body = [], bytearray(data)
    for r in records:
        starts.append(len(body))
        body += encoded(r)
    ends = [*starts[1:], len(body)][: len(starts)]
    addresses, out = [], bytearray()
    for a in range(0, len(body), size):
        addresses.append(len(out))
        out += block(bytes(body[a : a + size]))
    addresses.append(len(out))
    out += block(b"")
    place = lambda x: addresses[x // size] << 16 | x % size
    path.write_bytes(out)
    index = b"BAI\x01" + struct.pack("<I", len(contigs))
    for i in range(len(contigs)):
        own = [(place(a), place(b), r[3]) for a, b, r in zip(starts, ends, records, strict=True) if r[2] == i]
        linear = {}
        for a, _, pos in own:
            linear.setdefault(pos >> 14, a)
        chunks = [(4681, own[0][0], own[len(own) // 2][0]), (4682, own[len(own) // 2][0], own[-1][1])] if len(own) > 1 else [(4681, a, b) for a, b, _ in own]
        index += struct.pack("<I", len(chunks) + 1) + b"".join(struct.pack("<IIQQ", n, 1, a, b) for n, a, b in chunks) + struct.pack("<IIQQQQ", 37450, 2, 0, 0, 1, 1)
        index += struct.pack("<I", max(linear, default=-1) + 1) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(max(linear, default=-1) + 1))
    path.with_name(path.name + ".bai").write_bytes(index)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    rows = []
    for i in range(2000):
        ref = rng.choices(range(4), (6, 3, 2, 1))[0]
        mate = rng.randrange(-1, 5)
        n = rng.randrange(0, 150)
        cigar = [(str(rng.randrange(1, 90)), o) for o in rng.choice(["M", "SM", "MS", "MIMDM", "HMN", "=X"])]
        sa = rng.choice([None, "2,500,-,40M,30,0;", "chr2,10,+,30S40M,60,1;X,7,-,50M,9,2;"])
        rows.append((f"read{i}:{rng.randrange(10**9)}", rng.randrange(4096), ref, rng.randrange(CONTIGS[ref][1]), rng.randrange(61), cigar, mate, rng.randrange(CONTIGS[mate][1]) if mate >= 0 else -1, rng.randrange(-500, 500), "".join(rng.choices("ACGTN", k=n)), sa))
    rows.sort(key=lambda r: (r[2], r[3]))
    return rows + [(f"none{i}", 4, -1, -1, 0, [], -1, -1, 0, "ACG", None) for i in range(30)]


def expected(rows, sequence=False):
    name = lambda r: None if r < 0 else "chr" + {"1": "1", "chr2": "2", "X": "X", "GL000": "GL000", "MT": "M"}[CONTIGS[r][0]]
    place = lambda x: x if x >= 0 else None
    return sorted(str((r[0], r[1], name(r[2]), place(r[3]), r[4], "".join(n + o for n, o in r[5]) or None, name(r[6]), place(r[7]), r[8], (r[9] or None) if sequence else None, r[10])) for r in rows)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("size", [700, 60_000])
def test_same_records_however_the_file_is_cut(spark, made, tmp_path, size):
    written(tmp_path / "a.bam", made, size)
    written(tmp_path / "bare.bam", made, size)
    (tmp_path / "bare.bam.bai").unlink()
    for name in ("a.bam", "bare.bam"):
        for split in (500, 9000, 1 << 25):
            df = alignments.records(spark, str(tmp_path / name), splitBytes=split, sequence="true")
            assert got(df) == expected(made, True), (name, split)
    assert alignments.records(spark, str(tmp_path / "bare.bam"), splitBytes=9000).rdd.getNumPartitions() > 5
    both = alignments.records(spark, f"{tmp_path / 'a.bam'},{tmp_path / 'bare.bam'}")
    assert got(both) == expected(made * 2)


def test_contigs_are_left_unread(spark, made, tmp_path):
    written(tmp_path / "a.bam", made, 2000)
    path = str(tmp_path / "a.bam")
    df = alignments.records(spark, path)
    own = alignments.records(spark, path, contigs="chr1")
    assert own.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == 5
    assert got(own) == expected([r for r in made if r[2] == 0])
    assert got(alignments.records(spark, path, contigs="1,chrX,chr9")) == expected([r for r in made if r[2] in (0, 2)])
    assert got(df.where(F.col("chrom").isin("chr2", "chrX") & (F.col("mapq") > 30))) == expected([r for r in made if r[2] in (1, 2) and r[4] > 30])
    assert got(df) == expected(made)
    (tmp_path / "a.bam.bai").unlink()
    assert got(alignments.records(spark, path, contigs="MT,2", splitBytes=9000)) == expected([r for r in made if r[2] in (1, 4)])


def test_header_and_preflight(spark, made, tmp_path):
    path = tmp_path / "a.bam"
    assert "not found" in alignments.preflight(str(path))
    written(path, made[:5], 2000)
    rows = alignments.header(spark, str(path)).orderBy("number").collect()
    assert [(r.name, r.chrom, r.length, r.is_primary) for r in rows] == [("1", "chr1", 5_000_000, True), ("chr2", "chr2", 3_000_000, True), ("X", "chrX", 1_000_000, True), ("GL000", "chrGL000", 5000, False), ("MT", "chrM", 16569, False)]
    assert alignments.preflight(str(path)) is None
    written(path, [], 2000)
    assert alignments.records(spark, str(path)).count() == 0 and alignments.preflight(str(path)) is None
    written(path, [], 2000, order="queryname")
    assert "queryname" in alignments.preflight(str(path))
    written(path, [], 2000, contigs=[])
    assert "@SQ" in alignments.preflight(str(path))
    path.write_bytes(b"no bam")
    assert alignments.preflight(str(path)).startswith("BAM preflight failed")
    path.with_name("a.bam.bai").unlink()
    assert "index not found" in alignments.preflight(str(path))
