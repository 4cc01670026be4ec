"""Vectorised byte, word and shingle fingerprints over whole Arrow batches (numpy inside tasks).

All sums and products wrap modulo 2**64. A stretch of bytes b[i:j] has the polynomial fingerprint
sum(v[b[t]] * B**(t - i)), taken from one running sum over the batch: B is odd, so B**-i exists.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xD1342543DE82EF95)
_ODD_BASES = {0: BASE, 1: BASE_2}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407 + 2 * which))


_VALUES = {which: _byte_values(which) for which in (0, 1)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1)."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Running:
    """Running polynomial sums of a byte buffer: fingerprints of any stretches in two lookups."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _ODD_BASES[which]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[which][data] * powers(base, len(data)), out=self.sums[1:])
        self.back = powers(inverse(base), len(data) + 1)

    def of(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]

    def windows(self, width: int) -> np.ndarray:
        """Fingerprints of every stretch of `width` bytes, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[width:] - self.sums[:n]) * self.back[:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets) of a pyarrow string or binary array; null: empty."""
    import pyarrow as pa

    kind = pa.large_binary()
    array = column.cast(pa.large_string()).cast(kind) if not pa.types.is_binary(column.type) else column.cast(kind)
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARKS = _SPACE.copy()  # ASCII other than letters and digits
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, marks: bool = False, prefix: int = 0):
    """Words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased: (64-bit fingerprints, first word of each text).

    The second array has one entry more than there are texts; text i has words first[i]:first[i + 1].
    With `marks`, ASCII marks separate words too. With `prefix`, a third array has the fingerprints of the
    words' first `prefix` bytes.
    """
    n = len(data)
    n_texts = len(offsets) - 1
    if n == 0:
        none = np.zeros(0, dtype=np.uint64)
        return (none, np.zeros(n_texts + 1, dtype=np.int64)) + ((none,) if prefix else ())
    inside = ~(_MARKS if marks else _SPACE)[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # words end where a text ends
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(ends) + 1
    sums = Running(_LOWER[data])
    hashes = mix(sums.of(start, stop) + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    if not prefix:
        return hashes, first
    return hashes, first, mix(sums.of(start, np.minimum(stop, start + prefix)) + np.uint64(1 << 32))


def by_owner(owner: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers (a radix sort while they fit in 16 bits)."""
    small = not len(owner) or owner.max() < 1 << 16
    return np.argsort(owner.astype(np.uint16) if small else owner, kind="stable")


def by_owner_and_value(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    return order[by_owner(owner[order])]


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5):
    """Distinct `width`-word shingles per text, ascending: (shingle hashes, offsets, shingle counts).

    A text with fewer words, but at least one, has its whole word sequence as its only shingle.
    """
    n_texts = len(first) - 1
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(n.sum())
    owner = np.repeat(np.arange(n_texts), n)
    ends = np.cumsum(n)
    local = np.arange(total) - np.repeat(ends - n, n)
    start = np.repeat(first[:-1], n) + local
    length = np.minimum(np.repeat(counts, n), width)
    values = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        use = length > k
        word = hashes[np.minimum(start + k, max(len(hashes) - 1, 0))] if len(hashes) else values
        values = np.where(use, values * BASE + word, values)
    values = mix(values + length.astype(np.uint64))
    order = by_owner_and_value(owner, values)
    owner, values = owner[order], values[order]
    keep = np.ones(total, dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[keep], values[keep]
    per_text = np.bincount(owner, minlength=n_texts)
    return values, np.concatenate(([0], np.cumsum(per_text))), per_text
