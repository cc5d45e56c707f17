"""BAM files as a Spark data source.

Files are read in ranges of compressed bytes, an input partition each. Where there is an index (.bai beside the file),
ranges are cut per contig, at places that the index names, and contigs that aren't asked for are left unread; what has
no contig is a range of its own. Without an index, ranges are of equal size, and each task finds the first record that
starts in its range by checking that a chain of records fits.

Contig names get ``chr`` in front, whatever the file calls them; ``header`` has both names. Positions are 0-based.
Paths are local ones, or any that pyarrow's file systems know.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, seq string, sa string"
#: Compressed bytes to a range, about.
SPLIT = 32 << 20
ROWS = 8192
#: Blocks in which a chain of records is looked for.
LOOK = 4

# fixed values of the format: CIGAR operations, bases, sizes of tag values, the index's bin that holds no records
CIGAR = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
META_BIN = 37450
PRIMARY = {*map(str, range(1, 23)), "X", "Y"}
_CORE = struct.Struct("<iiBBHHHiiii")


def bare(name: str) -> str:
    """A contig's name without ``chr``; MT is M."""
    short = name[3:] if name[:3].lower() == "chr" else name
    return "M" if short.upper() == "MT" else short


def _open(path: str):
    found, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return found.open_input_file(inner)


def _exists(path: str) -> bool:
    found, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return found.get_file_info(inner).type == fs.FileType.File


def _block_size(head: bytes) -> int | None:
    """Bytes of the compressed block that begins with ``head``; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def _blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(address, content) of the compressed blocks from an address on."""
    end = file.size()
    while at < end:
        file.seek(at)
        raw = file.read(1 << 16)
        size = _block_size(raw)
        if size is None:
            raise ValueError(f"no compressed block at byte {at}")
        raw = raw if len(raw) >= size else raw + file.read(size - len(raw))
        yield at, zlib.decompressobj(31).decompress(raw[:size])
        at += size


class _Records:
    """The records from one place in the file to another. A place is a block's address times 65,536 plus bytes of its content."""

    def __init__(self, file, first: int):
        self.blocks, self.held, self.at = _blocks(file, first >> 16), b"", first & 0xFFFF
        self.marks: list[tuple[int, int]] = []  # where in ``held`` a block begins, and its address

    def _need(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            address, content = next(self.blocks, (None, b""))
            if address is None:
                return False
            if self.marks and self.at:
                self.held = self.held[self.at :]
                self.marks = [(m - self.at, a) for m, a in self.marks]
                self.at = 0
            self.marks.append((len(self.held), address))
            self.held += content
        return True

    def place(self) -> int:
        while len(self.marks) > 1 and self.marks[1][0] <= self.at:
            self.marks.pop(0)
        return self.marks[0][1] << 16 | (self.at - self.marks[0][0])

    def until(self, last: int | None) -> Iterator[bytes]:
        while self._need(4):
            if last is not None and self.place() >= last:
                return
            size = int.from_bytes(self.held[self.at : self.at + 4], "little")
            if not self._need(4 + size):
                raise ValueError("the file ends within a record")
            self.at += 4 + size
            yield self.held[self.at - size : self.at]


def _header(file) -> tuple[str, list[tuple[str, int]], int]:
    """The header's text, its contigs with their lengths, and the place of the first record."""
    r = _Records(file, 0)

    def take(n: int) -> bytes:
        if not r._need(n):
            raise ValueError("the file ends within its header")
        r.at += n
        return r.held[r.at - n : r.at]

    number = lambda: int.from_bytes(take(4), "little")
    if take(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    text = take(number()).rstrip(b"\0").decode()
    contigs = [(take(number())[:-1].decode(), number()) for _ in range(number())]
    r._need(1)
    return text, contigs, r.place()


def _index(data: bytes) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per contig of a .bai its chunks of records, as (first, end) places, and the places of its linear index."""
    at = 8

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    out = []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        chunks = []
        for _ in range(take("<i")[0]):
            number, n = take("<Ii")
            own = [take("<QQ") for _ in range(n)]
            chunks += own if number != META_BIN else []
        out.append((sorted(chunks), [x for x in take(f"<{take('<i')[0]}Q") if x]))
    return out


def _first_block(file, at: int) -> int | None:
    """The first compressed block at or after a byte: one that the next one follows."""
    size = file.size()

    def begins(place: int) -> int | None:
        file.seek(place)
        return _block_size(file.read(64))

    while at < size:
        file.seek(at)
        window = file.read(1 << 17)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            n = begins(at + i)
            if n and (at + i + n >= size or begins(at + i + n)):
                return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(window) - 3)
    return None


def _first_record(file, start: int, contigs: list[tuple[str, int]]) -> int | None:
    """The place of the first record that begins in a block at or after a byte."""
    at = _first_block(file, start)
    while at is not None:
        ahead = list(itertools.islice(_blocks(file, at), LOOK))
        data = b"".join(content for _, content in ahead)
        for u in range(len(ahead[0][1])):
            if _chain(data, u, contigs):
                return at << 16 | u
        at = ahead[1][0] if len(ahead) > 1 else None
    return None


def _chain(data: bytes, at: int, contigs: list[tuple[str, int]]) -> bool:
    """Whether records follow one another from here on, as far as the data goes."""
    for n in range(8):
        if at + 4 + _CORE.size > len(data):
            return n > 0
        size = int.from_bytes(data[at : at + 4], "little")
        ref, pos, name, _, _, cigar, _, seq, mate, mate_pos, _ = _CORE.unpack_from(data, at + 4)
        fits = name > 0 and seq >= 0 and _CORE.size + name + 4 * cigar + (seq + 1) // 2 + seq <= size
        inside = all(-1 <= r < len(contigs) and -1 <= x <= (contigs[r][1] if r >= 0 else 1 << 31) for r, x in ((ref, pos), (mate, mate_pos)))
        first = at + 4 + _CORE.size
        if not fits or not inside or (first + name <= len(data) and (data[first + name - 1] or not data[first : first + name - 1].isascii() or 0 in data[first : first + name - 1])):
            return False
        at += 4 + size
    return True


def _tags(data: bytes, at: int) -> str | None:
    """The SA tag among a record's tags."""
    while at + 3 <= len(data):
        kind, name = chr(data[at + 2]), data[at : at + 2]
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if name == b"SA":
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + TAG_BYTES[chr(data[at])] * int.from_bytes(data[at + 1 : at + 5], "little")
        else:
            at += TAG_BYTES[kind]
    return None


def _decoded(data: bytes, names: list[str], sequence: bool) -> tuple:
    ref, pos, length, mapq, _, n, flag, seq, mate, mate_pos, tlen = _CORE.unpack_from(data)
    at = _CORE.size + length
    ops = struct.unpack_from(f"<{n}I", data, at)
    at += 4 * n
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in data[at : at + (seq + 1) // 2])[:seq] if sequence and seq else None
    cigar = "".join(f"{op >> 4}{CIGAR[op & 15]}" for op in ops) or None
    sa = _tags(data, at + (seq + 1) // 2 + seq)
    contig = lambda r: names[r] if r >= 0 else None
    place = lambda x: x if x >= 0 else None
    return data[_CORE.size : _CORE.size + length - 1].decode(), flag, contig(ref), place(pos), mapq, cigar, contig(mate), place(mate_pos), tlen, bases, sa


@dataclass
class Range(InputPartition):
    """Records of a file from a place on, or from the first after a byte; of one contig, or of none (-1), or all (None)."""

    path: str
    first: int | None
    after: int | None
    last: int | None
    contig: int | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.split, self.sequence = int(options.get("splitBytes", SPLIT)), options.get("sequence", "false").lower() == "true"
        self.wanted = {bare(c.strip()) for c in options["contigs"].split(",")} if "contigs" in options else None

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for r in self._ranges(path)]

    def _ranges(self, path: str) -> Iterator[Range]:
        with _open(path) as file:
            _, contigs, first = _header(file)
            end = file.size()
        index = next((p for p in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai") if _exists(p)), None)
        if index is None:
            starts = range(0, max(end, 1), self.split)
            for a in starts:
                yield Range(path, first if a == 0 else None, a, min(a + self.split, end) << 16, None)
            return
        with _open(index) as file:
            listed = _index(file.read())
        for number, (chunks, places) in enumerate(listed):
            if not chunks or self.wanted is not None and bare(contigs[number][0]) not in self.wanted:
                continue
            begin, until = chunks[0][0], max(b for _, b in chunks)
            cuts = [begin]
            for x in sorted({*places, *(a for a, _ in chunks)}):
                if begin < x < until and (x >> 16) - (cuts[-1] >> 16) >= self.split:
                    cuts.append(x)
            for a, b in zip(cuts, [*cuts[1:], until], strict=True):
                yield Range(path, a, None, b, number)
        if self.wanted is None:
            yield Range(path, max((b for chunks, _ in listed for _, b in chunks), default=first), None, None, -1)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _open(partition.path) as file:
            _, contigs, _ = _header(file)
            names = [f"chr{bare(name)}" for name, _ in contigs]
            first = partition.first if partition.first is not None else _first_record(file, partition.after, contigs)
            if first is None or partition.last is not None and first >= partition.last:
                return
            numbers = None if self.wanted is None else {i for i, (name, _) in enumerate(contigs) if bare(name) in self.wanted}
            rows = []
            for data in _Records(file, first).until(partition.last):
                ref = int.from_bytes(data[:4], "little", signed=True)
                if ref != partition.contig if partition.contig is not None else numbers is not None and ref not in numbers:
                    continue
                rows.append(_decoded(data, names, self.sequence))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, whole, long = pa.string(), pa.int32(), pa.int64()
    kinds = (text, whole, text, long, whole, text, text, long, long, text, text)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class AlignmentSource(DataSource):
    """``spark.read.format("alignments")``; options: path (several with commas), contigs, splitBytes, sequence (false: ``seq`` is null)."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def records(spark: SparkSession, path: str, **options) -> DataFrame:
    """All records of BAM files, or those of some contigs (option ``contigs``, names with or without ``chr``).

    Contigs are an option and not taken from filters: Spark 4.1 keeps a Python source's ranges for later queries
    on the same DataFrame, filtered or not, and would give them the first one's contigs only.
    """
    spark.dataSource.register(AlignmentSource)
    return spark.read.format("alignments").options(path=path, **options).load()


def header(spark: SparkSession, path: str) -> DataFrame:
    """A row for each contig: number, name in the file, chrom (that of the records), length and whether it is of the primary assembly."""
    with _open(path) as file:
        _, contigs, _ = _header(file)
    rows = [(i, name, f"chr{bare(name)}", length, bare(name) in PRIMARY) for i, (name, length) in enumerate(contigs)]
    return spark.createDataFrame(rows, "number int, name string, chrom string, length long, is_primary boolean")


def preflight(path: str) -> str | None:
    """Why a file can't be scanned by contig; None if it can."""
    try:
        if not _exists(path):
            return f"BAM file not found: {path}"
        tried = [f"{path}.bai", f"{path.removesuffix('.bam')}.bai"]
        if not any(map(_exists, tried)):
            return f"BAM index not found. Expected one of: {', '.join(tried)}"
        with _open(path) as file:
            text, contigs, _ = _header(file)
        if not contigs:
            return "BAM header has no @SQ entries"
        order = next((f[3:] for line in text.splitlines() if line.startswith("@HD") for f in line.split("\t") if f.startswith("SO:")), "unknown")
        return None if order in ("coordinate", "unknown") else f"BAM is not coordinate-sorted (SO={order})."
    except (OSError, ValueError, zlib.error) as e:
        return f"BAM preflight failed: {e}"
