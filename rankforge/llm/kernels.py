"""Array kernels on Arrow text columns: whole batches at a time, in slices of bounded size.

Words are the runs of bytes other than 0x20 and 0x09-0x0D. A slice holds whole texts of about
`SLICE` bytes in all, or one longer text, so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
TEXTS = 65_535  # of a slice, at most: an owner fits 16 bits
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Some whole texts: `data` holds their bytes, text i is data[bounds[i]:bounds[i + 1]]."""
    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array for each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last), first + TEXTS)
        yield Slice(first, raw[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


def words(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and `edges`: words of text i are edges[i]:edges[i + 1]."""
    space = _SPACE[piece.data]
    cut = np.zeros(len(space) + 1, dtype=bool)
    cut[piece.bounds] = True
    before = np.concatenate(([True], space[:-1])) if len(space) else space
    after = np.concatenate((space[1:], [True])) if len(space) else space
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, piece.bounds)


def folded(piece: Slice) -> Slice:
    """A-Z in lower case, other bytes as they are."""
    capital = (piece.data >= 65) & (piece.data <= 90)
    return Slice(piece.first, piece.data + (capital.astype(np.uint8) << 5), piece.bounds)


def word_hashes(piece: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = power_tables(len(piece.data) + 1)
    total = np.empty(len(piece.data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((piece.data.astype(np.uint64) + np.uint64(1)) * up[:len(piece.data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position; the last `width - 1` positions are left out.

    Built from halves, so a wide window costs few passes.
    """
    if width == 1:
        return hashes
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    half = width // 2
    left = window_hashes(hashes, half)
    right = left if width - half == half else window_hashes(hashes, width - half)
    return mixed(left[:n] * np.uint64(0xD6E8FEB86659FD93) + right[half:half + n] + np.uint64(width))


def windows_inside(edges: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the window positions 0..total-width lie inside one text."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    inside = np.ones(total + 1, dtype=np.int8)
    counts = np.diff(edges)
    ends = edges[1:][counts >= width]  # no step leads back beyond the start of these
    for step in range(1, width):
        inside[ends - step] = 0
    short = np.flatnonzero(counts < width)
    for i in short:  # every position of a short text
        inside[edges[i]:edges[i + 1]] = 0
    return inside[:n].astype(bool)


def runs(piece: Slice, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and `edges` of the maximal runs of `member` bytes inside the texts, as `words` gives them."""
    cut = np.zeros(len(member) + 1, dtype=bool)
    cut[piece.bounds] = True
    before, after = np.zeros(len(member), dtype=bool), np.zeros(len(member), dtype=bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    starts = np.flatnonzero(member & (~before | cut[:-1]))
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, piece.bounds)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all (start, length) stretches, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
