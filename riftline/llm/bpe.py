"""BPE encoding and decoding over a table of distinct words.

Texts are split by the vocabulary's own pattern into words, block by block of the scan: a
block keeps its distinct words once and each text as places in that list. The blocks'
words are dealt and sorted by word into one distinct-word table, where each is encoded
once; its ids go back to the blocks that have it, and are joined there by place. Decoding
joins the ids of the distinct words with the id-to-piece table, which the vocabulary bounds
and which is therefore broadcast; the pieces go to the blocks with the ids, and are joined
to texts by the same places.

The places are made by a second pass over the texts instead of being written beside the
words. Both passes must deal the same rows to the same blocks, which holds for tables; a
checksum of a block's words is part of the join key, and a block without its words raises.

Defined results: a null text counts as empty and has no ids; a special token's string in a
text is that token, as the tokenizers library has it; repeated rows give repeated results;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text to a block, and of places to a row.
BLOCK = 32_000_000
ROW = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def piece_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary (tokenizers' JSON text)."""
    spec = json.loads(vocabulary)
    # fixed values: byte-level vocabularies write printable Latin-1 bytes as themselves, and the others, in order, from U+0100
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}
    ids = {i: piece for piece, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [bytes(byte[c] for c in ids[i]) if i in ids and all(c in byte for c in ids[i]) else ids.get(i, "").encode() for i in range(max(ids) + 1)]


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2 to the 32nd, by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


class _Blocks:
    """Cuts a partition's texts into blocks; gives a block's words, or its texts as places of words."""

    def __init__(self, pattern: str, special: list[str], give_words: bool, block: int, row: int):
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.special = set(special)
        self.give_words, self.block_chars, self.most_row_chars = give_words, block, row
        self.part = self.no = 0
        self._open()

    def _open(self) -> None:
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.rows: list[tuple[list[int], list[int], bytes]] = []
        self.chars = 0
        self._row()

    def _row(self) -> None:
        self.ids, self.lengths, self.places, self.row_chars = [], [], [], 0

    def _split(self, text: str) -> list[str]:
        if not self.cut or not any(s in text for s in self.special):
            return self.find(text)
        return [w for part in self.cut(text) for w in ([part] if part in self.special else self.find(part))]

    def add(self, doc_id, text: str | None) -> Iterator[pa.RecordBatch]:
        at = np.fromiter(map(self.words.__getitem__, self._split(text or "")), np.uint32)
        size = len(text or "")
        self.chars += size
        if not self.give_words:
            self.ids.append(doc_id)
            self.lengths.append(len(at))
            self.places.append(at)
            self.row_chars += size
            if self.row_chars >= self.most_row_chars:
                self._pack()
        if self.chars >= self.block_chars:
            yield from self.close()

    def _pack(self) -> None:
        if self.ids:
            self.rows.append((self.ids, self.lengths, packed(np.concatenate(self.places))))
            self._row()

    def close(self) -> Iterator[pa.RecordBatch]:
        self._pack()
        words = list(self.words)
        # 22 bits for the partition, 10 for the block in it, 31 of the words' checksum
        check = zlib.crc32("".join(words).encode(), zlib.crc32(str(len(words)).encode()))
        key = self.part << 41 | self.no << 31 | check >> 1
        if self.give_words:
            for a in range(0, len(words), 8192):
                part = words[a : a + 8192]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(a, a + n), pa.int32()), pa.array(part, pa.string())], names=["block", "place", "word"])
        else:
            for ids, lengths, packed in self.rows:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([packed], pa.binary())], names=["block", "doc_ids", "lengths", "places"])
        self.no += 1
        self._open()


def _blocks(docs: DataFrame, special: list[str], give_words: bool, block: int, row: int) -> DataFrame:
    pattern = _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(pattern, special, give_words, block, row)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                blocks.part = part.column(2)[0].as_py()
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield from blocks.add(doc_id, text)
        yield from blocks.close()

    schema = "block long, place int, word string" if give_words else "block long, doc_ids array<long>, lengths array<int>, places binary"
    return docs.select("doc_id", "text", F.spark_partition_id()).mapInArrow(run, schema)


#: Rows of the word table that a task holds before it hands them on.
HELD = 500_000


def _gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start at ``first`` and are ``n`` long, one after the other."""
    return flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _encoded(words: DataFrame, vocabulary: str, most: int) -> DataFrame:
    """Rows (block, place, word), sorted by word, as a table of distinct words and the places that use them.

    Hands on, in this order and again for each ``most`` places: a row with the words' sizes in ids, a row with all their
    ids, and for each block a row of its places and of the words there, as numbers of these words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        held, count = [], 0
        last: tuple[str | None, list[int]] = (None, [])

        def row(block=None, places=None, words=None, sizes=None, ids=None) -> pa.RecordBatch:
            binary = [pa.array([x], pa.binary()) for x in (places, words, sizes)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *binary, pa.array([ids], pa.list_(pa.int32()))], names=["block", "places", "words", "sizes", "ids"])

        def handed_on() -> Iterator[pa.RecordBatch]:
            block, place, word, size, ids = (np.concatenate([h[k] for h in held]) for k in range(5))
            word = word + np.repeat(np.cumsum([0, *(len(h[3]) for h in held[:-1])]), [len(h[0]) for h in held])
            held.clear()
            yield row(sizes=packed(size))
            yield row(ids=ids)
            order = np.argsort(block, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[a:b]
                yield row(block[at[0]], packed(place[at]), packed(word[at]))

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids = [e.ids for e in tokenizer.encode_batch_fast(distinct[distinct[0] == last[0] :], add_special_tokens=False)]
            ids = [last[1], *ids] if distinct[0] == last[0] else ids
            last = (distinct[-1], ids[-1])
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), coded.indices.to_numpy(), np.array([len(x) for x in ids], np.int64), np.fromiter((i for x in ids for i in x), np.int32)))
            count += batch.num_rows
            if count >= most:
                yield from handed_on()
                count = 0
        if held:
            yield from handed_on()

    return words.mapInArrow(run, "block long, places binary, words binary, sizes binary, ids array<int>")


def _with_pieces(table: DataFrame, pieces: list[bytes]) -> DataFrame:
    """Joins the ids of the distinct words with their pieces; per block: places, sizes in ids, ids, sizes in bytes and bytes of the words there.

    The ids are joined once a distinct word, however many blocks have it. A broadcast join keeps the order of its
    rows, so that words come before the places that use them; words without all their ids raise.
    """
    # a row for each id of the vocabulary
    known = table.sparkSession.createDataFrame(pa.table([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["id", "piece"]))
    joined = table.select("block", "places", "words", "sizes", F.explode_outer("ids").alias("id")).join(F.broadcast(known), "id", "left").select("block", "places", "words", "sizes", "id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, ids, pieces, tables = np.zeros(0, np.int64), [], [], None

        def made() -> tuple[np.ndarray, ...]:
            """The words' ids, and their bytes, each with where a word starts and its size."""
            own, text = np.concatenate(ids), np.frombuffer(b"".join(pieces), np.uint8)
            if len(own) != size.sum():
                raise RuntimeError("the ids of words have come out of order")
            ends = np.r_[0, np.cumsum(size)]
            width = np.diff(np.r_[0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))][ends])
            return own, ends[:-1], text, np.cumsum(width) - width, width

        for batch in batches:
            entry, head, id = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in (0, 3, 4))
            cuts = np.flatnonzero(np.r_[True, ~id[1:] | ~id[:-1], True]) if batch.num_rows else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if head[a]:
                    size, ids, pieces, tables = unpacked(batch.column(3)[a].as_py()).astype(np.int64), [], [], None
                elif id[a]:
                    ids.append(batch.column(4).slice(a, b - a).to_numpy())
                    pieces += batch.column(5).slice(a, b - a).to_pylist()
                elif entry[a]:
                    own, start, text, begin, width = tables = tables or made()
                    word = unpacked(batch.column(2)[a].as_py())
                    n, m = size[word], width[word]
                    out = [packed(n), packed(_gathered(own, start[word], n)), packed(m), zstandard.compress(_gathered(text, begin[word], m).tobytes(), 3)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), batch.column(1).slice(a, 1), *(pa.array([x], pa.binary()) for x in out)], names=["block", "places", "sizes", "tokens", "widths", "pieces"])

    return joined.mapInArrow(run, "block long, places binary, sizes binary, tokens binary, widths binary, pieces binary")


class _Block:
    """A block's words by place: their ids, and their bytes."""

    def __init__(self, rows: list[dict[str, bytes]]):
        place, self.size, tokens, self.width = (np.concatenate([unpacked(r[c]) for r in rows] or [np.zeros(0, np.uint32)]).astype(np.int64) for c in ("places", "sizes", "tokens", "widths"))
        text = np.frombuffer(b"".join(zstandard.decompress(r["pieces"]) for r in rows), np.uint8)
        order = np.argsort(place)
        first, begin = ((np.cumsum(x) - x)[order] for x in (self.size, self.width))
        self.size, self.width = self.size[order], self.width[order]
        self.tokens, self.text = _gathered(tokens, first, self.size), _gathered(text, begin, self.width)
        self.first, self.begin = np.cumsum(self.size) - self.size, np.cumsum(self.width) - self.width

    def texts(self, ids: list[int | None], lengths: list[int], packed_places: bytes) -> pa.RecordBatch:
        """Joins words to texts by place: their ids, and the bytes of these ids' pieces."""
        places, lengths = unpacked(packed_places), np.array(lengths, np.int64)
        if len(places) and int(places.max()) >= len(self.size):
            raise RuntimeError("a block's words are not those of its texts: the input changed between two passes; store it as a table first")
        n, m = self.size[places], self.width[places]
        tokens = _gathered(self.tokens, self.first[places], n)
        text = _gathered(self.text, self.begin[places], m).tobytes()
        ends = np.cumsum(lengths)
        until, to = (np.r_[0, np.cumsum(x)][np.r_[0, ends]] for x in (n, m))
        decoded = [text[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        listed = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(tokens, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a partition sorted by block, in which a block's words come before its texts; one row of places at a time."""
    key, words, block = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if row["block"] != key:
                key, words, block = row["block"], [], None
            if row["doc_ids"] is None:
                words.append(row)
            else:
                block, words = block or _Block(words), []
                yield block.texts(row["doc_ids"], row["lengths"], row["places"])


def encode_decode(docs: DataFrame, path: str | None = None, block: int = BLOCK, row: int = ROW, held: int = HELD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids array<int>, and decoded, the text of those ids."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
    words = _blocks(docs, special, True, block, row).repartition("word").sortWithinPartitions("word")
    back = _with_pieces(_encoded(words, vocabulary, held), piece_bytes(vocabulary))
    rows = back.unionByName(_blocks(docs, special, False, block, row), allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("doc_ids").isNotNull())
    return dealt.mapInArrow(_assembled, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    return encode_decode(docs, path, **sizes).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
