"""Word and shingle hashes of a batch of texts, vectorized over the bytes of the batch.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z lower-cased.
A text's shingles are its runs of five words, or all its words if there are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at once; a longer text makes a larger step of its own.
STEP = 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(_FOLD.astype(np.uint64) + np.uint64(1))
_PLACE = mixed(np.arange(101, 101 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        size = max(n, 2 * STEP)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _power[name] = np.multiply.accumulate(step)
    return _power["up"], _power["down"]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text (and the end) the place of its first word.

    ``data`` has the texts' bytes, ``at`` their offsets in it, the first 0.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    up, down = _powers(len(data))
    word = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, at)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    w, first = word_hashes(data, at)
    runs = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
    for k in range(WIDTH if len(runs) else 0):
        runs += w[k : k + len(runs)] * _PLACE[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            x = np.sort(runs[a : b - WIDTH + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(mixed((w[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of an Arrow string array, as (first row, end row, bytes, offsets), of about STEP bytes each; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP)))
        b = min(b, len(texts))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
