"""Content-defined splitting with a gear hash."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .scalars import round_pow2

READ = 16 << 20
_WORD = (1 << 64) - 1


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 random words from a fixed seed."""
    return np.random.Generator(np.random.PCG64(1)).integers(0, 2**64, 256, dtype=np.uint64)


def masks(window: int) -> tuple[int, int]:
    """Strict below the window, loose above it."""
    return (2 * window - 1) << 36, (window // 2 - 1) << 36


def windowed(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 64 bytes up to each place, by doubling."""
    h = gear()[data]
    for k in (1, 2, 4, 8, 16, 32):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def split(data: bytes, block: int, read: int = READ) -> list[int]:
    """The lengths of data's chunks, which add up to it.

    With w the block size as a power of two: a chunk's first w/4 bytes aren't hashed; up to w it ends after a byte whose hash meets the
    strict mask, from there to 8w after one that meets the loose mask, and at 8w in any case. Beyond w it also ends where a read of
    `read` bytes does. The hash runs on over cuts and skipped bytes, so that just after a skip it still holds bytes from before."""
    w = max(round_pow2(block), 16)
    n, least, most = len(data), w // 4, 8 * w
    strict, loose = masks(w)
    if n <= least:
        return [n] if n else []
    own = np.frombuffer(data, np.uint8)
    h = windowed(own)
    at_strict = np.flatnonzero(h & np.uint64(strict) == 0).tolist()
    at_loose = np.flatnonzero(h & np.uint64(loose) == 0).tolist()
    words = gear().tolist()
    reach = 37 + w.bit_length()  # so many bytes after a skip, the masks' highest bit still holds one from before
    out, start, last = [], 0, 0
    while start < n:
        first = start + least
        if first >= n:
            out.append(n - start)
            break
        middle, end = min(start + w, n), min(start + most, n)
        end = min(end, (middle // read + 1) * read)
        cut, value = None, last
        plain = min(first + reach, end)
        for i in range(first, plain):
            value = ((value << 1) + words[data[i]]) & _WORD
            if value & (strict if i < middle else loose) == 0:
                cut = i
                break
        if cut is None and plain < end:
            k = bisect_left(at_strict, plain)
            if plain < middle and k < len(at_strict) and at_strict[k] < middle:
                cut = at_strict[k]
            else:
                k = bisect_left(at_loose, max(plain, middle))
                cut = at_loose[k] if k < len(at_loose) and at_loose[k] < end else None
            if cut is not None:
                value = int(h[cut])
        if cut is None:
            cut = end - 1
            if cut >= first + reach:
                value = int(h[cut])
        last = value
        out.append(cut + 1 - start)
        start = cut + 1
    return out


def split_slowly(data: bytes, block: int, read: int = READ) -> list[int]:
    """As split(), a byte at a time."""
    w = max(round_pow2(block), 16)
    strict, loose = masks(w)
    words = gear().tolist()
    out, start, value, i = [], 0, 0, 0
    while start < len(data):
        i = start + w // 4
        done = False
        while i < len(data) and not done:
            value = ((value << 1) + words[data[i]]) & _WORD
            i += 1
            size = i - start
            done = value & (strict if size <= w else loose) == 0 or size == 8 * w or (size > w and i % read == 0)
        out.append(min(i, len(data)) - start)
        start += out[-1]
    return out


def even(data: bytes, block: int) -> list[int]:
    """The lengths of pieces of `block` bytes, the last one shorter."""
    return [min(block, len(data) - at) for at in range(0, len(data), block)]


Splitter = Callable[[bytes, int], list[int]]
#: What an archive may be split by, under the names that its configuration has.
SPLITTERS: dict[str, Splitter] = {"gear": split, "even": even}
