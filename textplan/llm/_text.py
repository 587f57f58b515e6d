"""Whole-batch text kernels: words, hashes and windows as numpy arrays, with no loop over words.

All kernels see a batch of texts as one UTF-8 buffer and the offsets of the
texts in it. Words and shingles are hashed eight bytes, or one word, at a time
through a bit mixer. Grams that only deal out candidates have polynomials
modulo 2**64, so that a gram of any length costs two operations; equal ones
are compared afterwards by their content or a 128-bit digest of it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_BASE = 0x9E6C63D0876A9A47 | 1
_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}

#: Bytes of words: all but white space; and letters, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, 1 << 16), U(base), dtype=U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums that make the hash of any window of these 64-bit values cheap."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _power("up", len(values)), out=out[1:])
    return out


def sliding_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of k values; equal windows hash alike wherever they are."""
    n = len(sums) - 1 - k + 1
    return mix((sums[k:] - sums[:-k]) * _power("down", n) + U(k * 0xA24BAED4963EE407 % 2**64)) if n > 0 else np.zeros(0, dtype=U)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null: none) and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task shares an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text; a longer text is a slice of its own. Freed memory is given back at the end."""
    for b in batches:
        if not b.num_rows:
            continue
        _, at = flat(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
    give_back()


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range: eight bytes at a time go through the mixer, all ranges at once; ranges of over 64 bytes one by one."""
    left = end - start
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(left.astype(U) * U(0xA24BAED4963EE407))
    live, depth = np.flatnonzero(left <= 64), 0
    while len(live):
        rest = (left[live] - depth).clip(0, 8).astype(U)
        chunk = eight[start[live] + depth] & (U(2**64 - 1) >> (U(64) - U(8) * rest.clip(1, 8)))
        out[live] = mix(out[live] ^ chunk)
        depth += 8
        live = live[left[live] > depth]
    long = np.flatnonzero(left > 64)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def shingle_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, each taken through the mixer in turn."""
    n = max(len(values) - k + 1, 0)
    h = mix(values[:n] + U(k))
    for i in range(1, k):
        h = mix(h ^ values[i : n + i])
    return h


def digest_128(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of ranges of values, as two columns."""
    raw = memoryview(np.ascontiguousarray(values).view(np.uint8).data if len(values) else b"")
    start, end = start * values.itemsize, end * values.itemsize
    found = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.array(memoryview(found).cast("q") if found else [], dtype=np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


class Words:
    """The words of a batch: byte range, text and hash of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        inside = np.zeros(len(buf) + 1, dtype=bool)
        inside[:-1] = kind[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[:-1][np.diff(offsets) > 0]
        first[cut] = inside[cut]
        self.start = np.flatnonzero(first)
        last = inside[:-1].copy()
        last &= ~inside[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        #: Words of text i: of[i] up to of[i + 1].
        self.of = np.searchsorted(self.start, offsets, side="left")
        self.hash = hash_ranges(_LOWER[buf] if lower else buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives to these (already lower-cased) words."""
    at = np.cumsum([0, *map(len, words)])
    return hash_ranges(np.frombuffer(b"".join(words), dtype=np.uint8), at[:-1], at[1:])


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def runs_of_windows(values: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` values that lie in one text, gathered into runs that share an anchor.

    The anchor of a window is the smallest hash of its k-grams, so it depends
    on what the window holds alone, and equal windows anywhere have equal anchors.
    Returns for each run: first window, number of windows, anchor, and whether
    the anchor is in it more than once (else no two of its windows are equal).
    """
    none = np.zeros(0, dtype=np.int64)
    if len(values) < width:
        return none, none, none.astype(U), none.astype(bool)
    sums = prefix(values)
    grams, w = sliding_hash(sums, k), width - k + 1
    low = sliding_min(grams, w)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    valid = np.arange(len(low)) + width <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    last = np.flatnonzero(stop)
    anchor = low[start]
    in_first = (np.lib.stride_tricks.sliding_window_view(grams, w)[start] == anchor[:, None]).sum(1)
    entering = np.r_[0, np.cumsum(low == grams[w - 1 :])]
    twice = in_first + entering[last + 1] - entering[start + 1] > 1
    return start, last - start + 1, anchor, twice


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
