"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of Arrow string columns.  Words are maximal runs of
bytes other than 0x20 and 0x09-0x0D; all separators are ASCII, so byte runs and code point runs
are the same words.  Texts are cut into segments at separators, so the working memory follows
``SEGMENT`` and not the longest text.

A word's hash joins two polynomials of its bytes, modulo two primes.  Two words of n bytes collide with
probability (n / 2**31)**2 at most, whatever their letters; modulo a power of two there are pairs of
words that collide for every base.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word makes a longer segment.
SEGMENT = 1 << 18
#: Products below 2**40 that are summed without a remainder.
SUM = 1 << 23
#: Bytes of text handed to a kernel at a time.
CHUNK = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Primes and the polynomials' bases.
_FIELDS = ((2147483647, 1664525809), (2147483629, 1013904223))

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_PLAIN = (np.arange(256) + 1).astype(np.uint64)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidied(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives back its free memory: Spark uses workers again, and what they
    keep counts beside the executor's heap."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


class _Powers:
    """Powers of the hash bases and of their inverses modulo their primes, grown on demand."""

    known: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def of(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not cls.known or n > len(cls.known[0][0]):
            n = max(n, SEGMENT + 1)
            cls.known = [(_powers(base, n, prime), _powers(pow(base, -1, prime), n, prime)) for prime, base in _FIELDS]
        return cls.known


def _prefix(values: np.ndarray, up: np.ndarray, prime: np.uint64) -> np.ndarray:
    """Sums of ``values * up`` before each place; of long inputs modulo ``prime``, so that none overflows."""
    out = np.zeros(len(values) + 1, np.uint64)
    for a in range(0, len(values), SUM):
        b = min(a + SUM, len(values))
        np.cumsum(values[a:b] * up[a:b], out=out[a + 1 : b + 1])
        if a:
            out[a + 1 : b + 1] += out[a] % prime
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` alone."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed * 0xD1B54A32D192ED03 & _MASK)
    return mix(x) | np.uint64(1)


@dataclass
class Words:
    """Words of several texts: ``hash``, byte ``start`` and ``end`` in ``data`` for each word, and for
    text i the words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text (a longer text is a range of its own)."""
    lengths = np.diff(text_buffers(column)[1])
    at = 0
    while at < len(lengths):
        size = np.cumsum(lengths[at : at + 100_000])
        n = max(1, int(np.searchsorted(size, most, "right")))
        yield at, at + n
        at += n


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        to = min(at + SEGMENT, len(data))
        while to < len(data):
            gap = np.flatnonzero(~_WORD_BYTE[data[to : to + SEGMENT]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + SEGMENT, len(data))
        yield at, to
        at = to


def words(column: pa.Array, fold: bool = False) -> Words:
    """Hashes all words of a string column.  ``fold`` lower-cases A-Z first."""
    data, offsets = text_buffers(column)
    value = _FOLDED if fold else _PLAIN
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in _cuts(data):
        seg = data[a:b]
        inside = _WORD_BYTE[seg]
        edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before = np.empty(len(seg), bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.empty(len(seg), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        bytes_, code = value[seg], np.zeros(len(start), np.uint64)
        for (prime, _), (up, down) in zip(_FIELDS, _Powers.of(len(seg) + 1), strict=True):
            p = np.uint64(prime)
            total = _prefix(bytes_, up[: len(seg)], p)
            code = code << np.uint64(32) | (total[end] % p + p - total[start] % p) % p * down[start] % p
        parts.append((start + a, end + a, mix(code)))
    start, end, code = (np.concatenate(x) if parts else np.empty(0, t) for x, t in zip(zip(*parts) if parts else ((), (), ()), (np.int64, np.int64, np.uint64), strict=True))
    return Words(data, offsets, start, end, code, np.searchsorted(start, offsets))


def windows(w: Words, k: int = 5, seed: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words, text after text, and the offsets of the texts in them.
    With ``short``, a text of 1 to k-1 words has one window: all its words."""
    n = len(w.hash)
    by = constants(k + 1, seed)
    counts = w.counts
    some = np.where(counts >= k, counts - k + 1, (counts > 0) & short).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(some)])
    if not first[-1]:
        return np.empty(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], some)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    whole = np.repeat(counts, some) >= k
    out = np.zeros(first[-1], np.uint64)
    if whole.all():
        for j in range(k):
            out += padded[at + j] * by[j]
    else:
        left = np.repeat(w.first[1:], some) - at
        for j in range(k):
            out += np.where(left > j, padded[at + j] * by[j], by[k : k + 1] * np.uint64(j + 1))
    assert at[-1] < n
    return mix(out), first


def sets(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, and the offsets of the texts in them."""
    out, sizes = np.empty(len(code), np.uint64), np.zeros(len(first), np.int64)
    at = 0
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a == 1:
            out[at] = code[a]
            at += 1
        elif b > a:
            x = np.sort(code[a:b])
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
            out[at : at + len(x)] = x
            at += len(x)
        sizes[i + 1] = at
    return out[:at], sizes


def set_keys(values: np.ndarray, first: np.ndarray, seed: int = 77) -> list[bytes]:
    """A 128-bit key of each set that depends on its members alone."""
    sums = []
    for s in (seed, seed + 1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ constants(1, s)[0]), dtype=np.uint64)])
        sums.append(mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64)))
    both = np.ascontiguousarray(np.stack(sums, axis=1))
    return [both[i].tobytes() for i in range(len(both))]
