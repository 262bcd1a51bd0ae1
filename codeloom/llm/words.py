"""Words of whole texts as 64-bit hashes, in numpy, straight from Arrow's buffers.

Texts are cut at ASCII white space. The hash of a word depends on its bytes only, so runs of different white space between
the same words don't matter. All arithmetic is modulo 2**64. Texts go through in pieces of bounded size, each cut at white
space, so that a very long text costs 8 bytes a word and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For tokens of letters and digits: all other ASCII characters separate.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = _table(11)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """P**i and P**-i modulo 2**64 for i below a length that grows on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(16, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, x, U)])) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _piece(data: np.ndarray, lower: bool, apart: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece, whose words are whole. first: only so many bytes of a word count, if over 0."""
    inside = ~apart[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if first:
        end = np.minimum(end, start + first)
    up, down = _BYTES.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F)), start


def _pieces(data: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about _PIECE bytes that end at one of breaks (ends of texts) or at white space."""
    at = 0
    while at < len(data):
        if len(data) - at <= _PIECE:
            end = len(data)
        else:
            k = np.searchsorted(breaks, at + _PIECE, "right") - 1
            end = int(breaks[k]) if k >= 0 and breaks[k] > at else 0
            if not end:
                last = at
                while not end:  # a text longer than a piece: the next white space after it
                    last = min(last + _PIECE, len(data))
                    found = np.flatnonzero(_SPACE[data[last : last + _PIECE]])
                    stop = breaks[np.searchsorted(breaks, last, "left")]
                    end = int(min(last + found[0], stop)) if len(found) else int(stop) if stop <= last + _PIECE else 0
        yield at, end
        at = end


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, without copying; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def hashed(column: pa.Array, lower: bool = False, marks: bool = False, stem: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text's number, word hashes, bounds of the texts among them), for groups of whole texts of about a piece.

    lower: A-Z count as a-z. marks: words are runs of ASCII letters and digits and of all that is not ASCII. stem: only so
    many first bytes of a word count, if over 0.
    """
    data, at = texts_of(column)
    apart = _MARKS if marks else _SPACE
    n = len(at) - 1
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, "right")) - 1)
        part, ends = data[at[first] : at[last]], at[first : last + 1] - at[first]
        hashes, begun = [], []
        for a, b in _pieces(part, ends):
            h, s = _split(part[a:b], ends[(ends > a) & (ends < b)] - a, lower, apart, stem)
            hashes.append(h)
            begun.append(s + a)
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        s = np.concatenate(begun) if begun else np.zeros(0, np.int64)
        yield first, h, np.searchsorted(s, ends, "left")
        first = last


def located(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Like hashed(), in parts of a piece at most: (text's number, hashes, first bytes, ends, bounds of the texts, bytes).

    A text longer than a piece comes in several parts, one after another.
    """
    data, at = texts_of(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, "right")) - 1)
        part, ends = data[at[first] : at[last]], at[first : last + 1] - at[first]
        for a, b in _pieces(part, ends) if len(part) else ((0, 0),):
            inner = ends[(ends > a) & (ends < b)] - a
            own = part[a:b]
            gaps = np.zeros(0, np.int64)
            if len(inner):
                gaps = inner[~_SPACE[own[inner - 1]] & ~_SPACE[own[inner]]]
                own = np.insert(own, gaps, 32)
            h, s = _piece(own, False, _SPACE)
            stop = np.flatnonzero(np.diff(~_SPACE[own], prepend=False, append=False))[1::2]
            begin = ends[:-1] - a if last - first > 1 else np.zeros(1, np.int64)
            yield first, h, s, stop, np.append(np.searchsorted(s, begin + np.searchsorted(gaps, begin, "left"), "left"), len(h)), own
        first = last


def _split(data: np.ndarray, inner: np.ndarray, lower: bool, apart: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """Like _piece, where a word also ends at the end of a text."""
    if not len(inner) or not np.any(touching := ~apart[data[inner - 1]] & ~apart[data[inner]]):
        return _piece(data, lower, apart, stem)
    h, s = _piece(np.insert(data, inner[touching], 32), lower, apart, stem)
    return h, s - np.searchsorted(inner[touching] + np.arange(int(touching.sum())), s, "left")


def prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans(): prefix sums of a run of word hashes and the powers to shift them with."""
    up, down = _WORDS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total, down


def spans(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [start, end)."""
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    up, _ = _WORDS.get(k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * up[j + 1]
    return mix(out)
