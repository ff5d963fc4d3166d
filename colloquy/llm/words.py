"""Word and shingle hashes of whole Arrow batches, computed on the UTF-8 bytes with numpy.

Memory is bounded by :data:`PIECE` bytes of text at a time; only the hashes of a document (8 bytes a word) are held
whole.  Hashes are the same in every process: they depend on fixed constants alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.
PIECE = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes that separate words: ASCII white space; or everything in ASCII but a-z, A-Z and digits.
SPACE = _class([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _class(b for b in range(0x80) if not chr(b).isalnum())

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0], k = 1, 1
        with np.errstate(over="ignore"):
            while k < size:
                have[k : 2 * k] = have[:k] * U(pow(base, k, 1 << 64))
                k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text each; a longer text is a run of its own."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _spans(data: np.ndarray, edges: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~separators[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    starts, ends = _spans(data, offsets, separators)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    k = 0
    while k < len(starts):  # in pieces, so that a very long text needs no long arrays of 64-bit numbers
        low = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = int(ends[last - 1])
        with np.errstate(over="ignore"):
            total = np.empty(high - low + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(table[data[low:high]] * powers(_BASE, high - low), out=total[1:])
            s, e = starts[k:last] - low, ends[k:last] - low
            hashes[k:last] = mix((total[e] - total[s]) * powers(_INVERSE, high - low + 1)[s] + (e - s).astype(np.uint64))
        k = last
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of each text's first word, one more at the end)."""
    starts, ends, firsts = word_spans(data, offsets, separators)
    return span_hashes(data, starts, ends, lower), firsts


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` word hashes (ends of texts are not respected)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, PIECE):
        part = hashes[low : min(n, low + PIECE) + width - 1]
        with np.errstate(over="ignore"):
            total = np.empty(len(part) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(part * powers(_BASE, len(part)), out=total[1:])
            m = len(part) - width + 1
            out[low : low + m] = mix((total[width:] - total[:m]) * powers(_INVERSE, m) + U(width))
    return out
