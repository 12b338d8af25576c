"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte values for hashing, with A-Z lowered; 1 is added so that a zero byte counts.
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_BASE, _M1, _M2 = 0x9E3779B97F4A7C55, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes looked at in one go; a longer text is read in parts that end at white space.
WINDOW = 1 << 20

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(256, n, 2 * len(_powers))
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, _BASE, np.uint64))])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: each bit of the result depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(_M1)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(_M2)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and where each text begins and the last ends. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _parts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, end) of parts of at most WINDOW bytes; a part ends with its text, at white space, or with its only word."""
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        while b - a > WINDOW:
            back = np.flatnonzero(_SPACE[data[a : a + WINDOW]])
            if len(back):
                cut = a + int(back[-1]) + 1
            else:
                cut = a + WINDOW
                while cut < b and not _SPACE[data[cut]]:
                    cut += 1
            yield i, cut
            a = cut
        yield i, b


def word_spans(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole parts: (first byte, bytes, word starts, word ends, number of words in each part's text id pair)."""
    parts = list(_parts(data, at))
    begin, k = 0, 0
    while k < len(parts):
        j, end = k, begin
        while j < len(parts) and (j == k or parts[j][1] - begin <= WINDOW):
            end = parts[j][1]
            j += 1
        d = data[begin:end]
        edges = np.array([begin, *(p[1] for p in parts[k : j - 1])], np.int64) - begin
        inner = edges[(edges > 0) & (edges < len(d))]
        word = ~_SPACE[d]
        before = np.zeros(len(d), bool)
        before[1:] = word[:-1]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(d), bool)
        after[:-1] = word[1:]
        after[inner - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        texts = np.array([p[0] for p in parts[k:j]], np.int64)
        counts = np.diff(np.append(np.searchsorted(starts, edges), len(starts)))
        yield begin, d, starts, ends, np.stack([texts, counts])
        begin, k = end, j


def span_hashes(d: np.ndarray, starts: np.ndarray, lens: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans have at least one byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = (_BYTE_LOW if lower else _BYTE)[d[np.repeat(starts, lens) + inside]] * _power(int(lens.max()))[inside]
    return mix(np.add.reduceat(values, first) ^ (lens.astype(np.uint64) * np.uint64(_M2)))


def word_hashes(texts: pa.Array | pa.ChunkedArray, lower: bool = True, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words, and where each text's words begin (one entry more than texts).

    Words are runs of bytes other than white space; with ``lower``, A-Z count as a-z. With ``prefix``, a third
    array has the hashes of the words' first ``prefix`` bytes.
    """
    data, at = buffers(texts)
    n, hashes, heads, counts = len(at) - 1, [], [], np.zeros(len(at) - 1, np.int64)
    for _, d, starts, ends, per in word_spans(data, at):
        hashes.append(span_hashes(d, starts, ends - starts, lower))
        if prefix:
            heads.append(span_hashes(d, starts, np.minimum(ends - starts, prefix), lower))
        np.add.at(counts, per[0], per[1])
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]) if n else np.zeros(1, np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return (flat, offsets, np.concatenate(heads) if heads else np.zeros(0, np.uint64)) if prefix else (flat, offsets)


_SHINGLE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words (at most 8), and where each text's begin.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    counts = np.diff(at)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])
    out = np.empty(int(out_at[-1]), np.uint64)
    m = len(words) - width + 1
    if m > 0:
        h = words[:m] * _SHINGLE[0]
        for j in range(1, width):
            h += words[j : j + m] * _SHINGLE[j]
        h = mix(h)
        long = np.flatnonzero(counts >= width)
        n = per[long]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(out_at[long], n) + inside] = h[np.repeat(at[long], n) + inside]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[at[i] : at[i + 1]]
        total = np.uint64(len(w))
        for j, x in enumerate(w):
            total = np.uint64((int(total) + int(x) * int(_SHINGLE[j])) & (2**64 - 1))
        out[out_at[i]] = mix(np.array([total], np.uint64))[0]
    return out, out_at
