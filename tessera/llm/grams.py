"""Hashing of word windows and the packed exchange of window hashes.

Shipping one row per window would cost several times the input.  Tasks instead
hash the windows of a batch of documents with numpy and ship one packed blob
per batch and bucket: 7 bytes of each hash, and delta-coded positions.  The
bucket (hash modulo the number of partitions) adds its bits to the 56 stored
ones, so 56 + log2(partitions) of a hash's 64 bits are compared, never more than 64.
Where that is too few, a second hash from independent word hashes and another
base goes along.

A batch is closed at ``BATCH_WINDOWS`` windows, or at ``BLOB_ENTRIES`` per bucket
if that is more, so that blobs stay large against their headers; what a task
holds is bounded by that and its longest document.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BATCH_WINDOWS = 500_000
BLOB_ENTRIES = 200
CACHE_WORDS = 1 << 17
NO_ID = np.iinfo(np.int64).max  # a null id sorts after every id

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's fixed multipliers
_ODD = 0x9E3779B97F4A7C15  # odd base of the rolling hash: 2^64 / golden ratio
SECOND_ODD = 0xD1342543DE82EF95  # an odd multiplier of published 64-bit congruential generators


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class WordDigests(dict):
    """word (bytes) -> 128-bit hash as two independent 64-bit ones; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        """One row per word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8").reshape(-1, 2)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of all windows of ``width`` word hashes.

    With prefix sums S(i) = sum of w(j) * B^j for j < i, the window at i has
    (S(i + width) - S(i)) * B^-i; B is odd, so its inverse exists.
    """

    def __init__(self, width: int, base: int = _ODD):
        self.width, self.odd = width, base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(self.odd, -1, 1 << 64)
            base = np.full(size, self.odd, dtype=np.uint64)
            back = np.full(size, inverse, dtype=np.uint64)
            base[0] = back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)

    def hashes(self, w: np.ndarray) -> np.ndarray:
        n = len(w)
        if n < self.width:
            return np.empty(0, dtype=np.uint64)
        self._powers(n + 1)
        s = np.empty(n + 1, dtype=np.uint64)
        s[0] = 0
        np.cumsum(w * self.up[:n], out=s[1:])
        k = n - self.width + 1
        return mix((s[self.width:] - s[:k]) * self.down[:k])


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers below 2^64: byte planes, compressed (high planes are mostly zero)."""
    a = np.ascontiguousarray(a, dtype="<u8")
    top = int(a.max()) if len(a) else 0
    planes = max(1, (top.bit_length() + 7) // 8)
    raw = a.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + zlib.compress(raw, 1)


def unpack_ints(b: bytes) -> np.ndarray:
    planes = b[0]
    raw = np.frombuffer(zlib.decompress(b[1:]), dtype=np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :planes] = raw.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_signed(a: np.ndarray) -> bytes:
    """Integers in an order that makes neighbours close: zigzag deltas, in wrapping arithmetic."""
    a = a.astype(np.int64)
    d = np.diff(a, prepend=np.int64(0))
    return pack_ints(((d << np.int64(1)) ^ (d >> np.int64(63))).view(np.uint64))


def unpack_signed(b: bytes) -> np.ndarray:
    z = unpack_ints(b)
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    return np.cumsum(d)


def pack_hashes(h: np.ndarray) -> bytes:
    """The upper 7 bytes of each hash."""
    return (h >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack_hashes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :7] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_short(h: np.ndarray) -> bytes:
    """The upper 3 bytes of each hash."""
    return (h >> np.uint64(40)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def unpack_short(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8).reshape(-1, 3)
    out = np.zeros((len(raw), 4), dtype=np.uint8)
    out[:, :3] = raw
    return out.reshape(-1).view("<u4")


def repeats(h: np.ndarray, second: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Indexes (rising) of the entries whose two hashes another entry with a smaller ``own`` has."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    order = np.argsort(h, kind="stable")
    new = group_starts(h[order])
    x = second[order]
    if (~new[1:] & (x[1:] != x[:-1])).any():  # one hash of different windows
        order = np.lexsort((second, h))
        new = group_starts(h[order], second[order])
    start = np.flatnonzero(new)
    mine = own[order]
    least = np.repeat(np.minimum.reduceat(mine, start), np.diff(np.append(start, len(h))))
    return np.sort(order[mine > least])


def join_parts(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], dtype="<u8").tobytes()
    return head + b"".join(parts)


def split_parts(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, dtype="<u8", count=1)[0])
    sizes = np.frombuffer(b, dtype="<u8", count=n, offset=8)
    ends = np.cumsum(sizes).astype(np.int64) + 8 * (n + 1)
    return [b[int(e - s):int(e)] for e, s in zip(ends, sizes)]


def pack_entries(doc: np.ndarray, pos: np.ndarray) -> list[bytes]:
    """Entries sorted by (doc, pos): documents once with their counts, position deltas within a document."""
    docs, first, counts = np.unique(doc, return_index=True, return_counts=True)
    step = np.diff(pos.astype(np.int64), prepend=0)
    step[first] = pos[first]
    return [pack_ints(np.diff(docs.astype(np.int64), prepend=0)), pack_ints(counts), pack_ints(step)]


def unpack_entries(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct docs, counts, positions)."""
    docs = np.cumsum(unpack_ints(parts[0]).astype(np.int64))
    counts = unpack_ints(parts[1]).astype(np.int64)
    step = unpack_ints(parts[2]).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    before = total[first] - step[first]
    return docs, counts, total - np.repeat(before, counts)


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its hashes in their order)."""
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for i in range(buckets):
        if cuts[i] < cuts[i + 1]:
            yield i, order[cuts[i]:cuts[i + 1]]


def batch_limit(buckets: int) -> int:
    return max(BATCH_WINDOWS, BLOB_ENTRIES * buckets)


def releasing(run):
    """Wraps a batch function: freed memory goes back to the system when its task ends.

    Python workers stay between stages, and would keep their largest size beside the next one's JVM.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)
    return wrapped


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of an Arrow column as bytes, a few at a time."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).cast(pa.binary()).to_pylist()


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins, in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new
