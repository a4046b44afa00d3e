"""Vectorised text kernels over Arrow string arrays (numpy, no per-word Python).

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; since those are ASCII, splitting UTF-8 bytes
equals splitting code points.  Hashes are 64-bit and depend on content alone, never on process or position.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MAX_POWERS = 1 << 22
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that one kernel call holds at a time; a longer document is a call of its own.
SLICE_BYTES = 2 << 20
#: The same where several stages share a worker: a call holds some 60 times its text, and what it frees stays with the
#: process. A quarter of the text takes as long.
STAGE_BYTES = 1 << 19


def give_back() -> None:
    """What this worker has freed goes back to the system; the C library would keep it while the worker waits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def tidied(run: Callable, then: Callable = give_back) -> Callable:
    """A task over batches that ends with ``then``, when nothing of it is held any more."""

    def whole(batches):
        yield from run(batches)
        then()

    return whole


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STAGE_BYTES + 1024)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= _MAX_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ U64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets, from 0; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if not wide and not pa.types.is_string(arr.type):
        arr, wide = arr.cast(pa.large_string()), True
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offs, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


def slices(table: pa.Table | pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.Table | pa.RecordBatch]:
    """Consecutive parts of about ``limit`` bytes of ``column``; whole rows always."""
    n = table.num_rows
    if not n:
        return
    col = table.column(column)
    sizes = np.asarray(pc.binary_length(col).fill_null(0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield table.slice(at, to - at)
        at = to


class Words:
    """Words of a batch: byte ranges ``start``/``end``, and ``off``, the first word of each document (n + 1)."""

    __slots__ = ("_prefix", "buf", "end", "hash", "off", "start", "text_off")

    def __init__(self, arr: pa.Array, lower: bool = False, hashed: bool = True):
        buf, off = text_bytes(arr)
        if lower:
            buf = LOWER[buf]
        self.buf, self.text_off = buf, off
        n = len(buf)
        inside = ~SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~inside[:-1] | edge[1:n]
            after[:-1] = ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.off = np.searchsorted(self.start, off)
        self._prefix = None
        self.hash = self.range_hash(self.start, self.end) if hashed else None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges by their content."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, U64)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, U64)
            np.cumsum((self.buf.astype(U64) + U64(1)) * _power_table(_BASE, n), out=self._prefix[1:])
        h = (self._prefix[end] - self._prefix[start]) * _power_table(_BASE_INV, n)[start]
        return mix(h ^ (end - start).astype(U64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        """The document (index in the batch) of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def windows(words: Words, size: int, seed: int = 0, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a document: (hash, document, first word).

    With ``short_whole``, a document of 1 to size - 1 words gives its whole sequence as one window.
    """
    h, n = words.hash, len(words.hash)
    mult = pow(0xC2B2AE3D27D4EB4F ^ (seed << 33), 1, 1 << 64) | 1
    doc = words.doc()
    if n >= size:
        acc = h[: n - size + 1].copy()
        for j in range(1, size):
            acc *= U64(mult)
            acc += h[j : n - size + 1 + j]
        ok = np.arange(n - size + 1) + size <= words.off[1:][doc[: n - size + 1]]
        first = np.flatnonzero(ok)
        out, owner = mix(acc[first], size + seed), doc[first]
    else:
        first, out, owner = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    if short_whole:
        counts = words.counts
        extra = np.flatnonzero((counts > 0) & (counts < size))
        if len(extra):
            vals = []
            for d in extra:
                acc1 = np.zeros(1, U64)
                for x in h[words.off[d] : words.off[d + 1]]:
                    acc1 = acc1 * U64(mult) + x
                vals.append(mix(acc1, 1000 + int(counts[d]) + seed)[0])
            out = np.concatenate([out, np.array(vals, U64)])
            owner = np.concatenate([owner, extra])
            first = np.concatenate([first, words.off[extra]])
            order = np.argsort(owner, kind="stable")
            out, owner, first = out[order], owner[order], first[order]
    return out, owner, first


def distinct_sets(h: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, one after another, and their n_docs + 1 offsets."""
    parts, off = [], np.zeros(n_docs + 1, np.int64)
    cuts = np.searchsorted(owner, np.arange(n_docs + 1))
    for d in range(n_docs):
        s = np.unique(h[cuts[d] : cuts[d + 1]])
        off[d + 1] = len(s)
        parts.append(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(off)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit values as compressed differences."""
    delta = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32)
    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class Lookup:
    """Membership of 64-bit keys in a set: a bitmap on the low bits first, then binary search."""

    def __init__(self, keys: np.ndarray):
        keys = np.sort(keys)
        self.keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.bits = max(10, min(24, int(np.ceil(np.log2(max(len(self.keys), 1)))) + 4))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of known keys, and their places among the sorted keys."""
        at = np.flatnonzero(self.map[self._slot(h)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, h[at])
        place[place == len(self.keys)] = 0
        good = self.keys[place] == h[at]
        return at[good], place[good]
