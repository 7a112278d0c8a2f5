"""Words and word hashes of Arrow text columns, vectorised over bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as all of these are ASCII, it makes no
difference that UTF-8 bytes rather than characters are looked at. Hashes are 64-bit: a polynomial over
random byte values gives word hashes, a second one over mixed word hashes gives those of word sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts looked at in one go (a longer text alone), and bytes that are hashed at once.
CHUNK, PIECE = 1_000_000, 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(2)
def _byte_values(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)
    if fold:
        t[65:91] = t[97:123]
    return t


@functools.lru_cache(2)
def _is_word() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to PIECE of _P and of its inverse modulo 2 ** 64."""
    out = []
    for p in (_P, pow(_P, -1, 1 << 64)):
        a = np.full(PIECE + 1, p, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return b, offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most size bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts data[offs[i]:offs[i + 1]]: word hashes, word starts, word ends, and the n + 1 word offsets of texts.

    Bytes are hashed PIECE at a time, so that beside the result (16 bytes a word, 24 beyond 2 GB) little is held however
    long a text is; a word that a piece cuts is put together from its parts.
    """
    n, place = len(data), np.int32 if len(data) < 1 << 31 else np.int64
    power, inverse = _powers()
    values, is_word = _byte_values(fold), _is_word()
    cuts = np.unique(offs[(offs > 0) & (offs < n)])
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, place)], [np.zeros(0, place)]
    begun: tuple[int, int, int] | None = None  # start, hash so far and length of a word that the last piece cut
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        m = hi - lo
        w = is_word[data[lo:hi]]
        here = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "right")] - lo  # texts begin after the first byte
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        inner = here[here < m]
        first[inner] = w[inner]
        last[here - 1] = w[here - 1]
        first[0] = w[0] and begun is None
        goes_on = bool(w[-1] and hi < n and is_word[data[hi]] and not (len(here) and here[-1] == m))
        last[-1] = w[-1] and not goes_on
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.empty(m + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[lo:hi]] * power[:m], out=sums[1:])
        if begun is not None:
            start, value, length = begun
            to = int(b[0]) if len(b) else m
            value = (value + int(sums[to]) * pow(_P, length, 1 << 64)) & _MASK
            begun = (start, value, length + m)
            if len(b):
                hashes.append(mix(np.array([value], np.uint64))), starts.append(np.array([start], place)), ends.append(np.array([lo + to], place))
                b, begun = b[1:], None
        if goes_on and begun is None:
            s = int(a[-1])
            begun = (lo + s, (int(sums[m]) - int(sums[s])) * int(inverse[s]) & _MASK, m - s)
            a = a[:-1]
        hashes.append(mix((sums[b] - sums[a]) * inverse[a])), starts.append((a + lo).astype(place)), ends.append((b + lo).astype(place))
    h, starts, ends = (np.concatenate(x) for x in (hashes, starts, ends))
    return h, starts, ends, np.searchsorted(starts, offs)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on (without regard to where texts end); len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + m]
    return mix(out + np.uint64(k))


def pack(a: np.ndarray) -> bytes:
    """A sorted uint64 array as first value and differences, in as few bytes each as the largest needs."""
    if not len(a):
        return b""
    d = np.diff(a)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + a[:1].tobytes() + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not len(b):
        return np.zeros(0, np.uint64)
    width, raw = b[0], np.frombuffer(b, np.uint8, offset=9)
    n = len(raw) // width
    d = np.zeros((n + 1, 8), np.uint8)
    d[1:, :width] = raw.reshape(n, width)
    d = d.reshape(-1).view(np.uint64)
    d[0] = np.frombuffer(b, np.uint64, 1, 1)[0]
    return np.cumsum(d, dtype=np.uint64)


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)
