"""Vectorised helpers over Arrow string columns.

A text column arrives in a task as one UTF-8 buffer with offsets.  Word and
line boundaries, hashes and per-document sums are computed on that buffer with
numpy, a bounded number of bytes at a time, so no per-word Python objects are
made.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text handled at once; one longer text is handled on its own.
CHUNK_BYTES = 1 << 17

#: Rows of a batch that are brought into plain form at once.
SLICE_ROWS = 512

#: Hashes of byte ranges are polynomials modulo this prime, at a base drawn once.
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_BASE = int(np.random.default_rng(20240607).integers(1 << 60, _PRIME))
#: Ranges of at most this many bytes are hashed in one sum, which then stays below 2**64.
_SPAN = 1 << 24
_BYTE = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: The bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Everything but ASCII letters, digits and non-ASCII bytes separates terms.
NOT_TERM = np.ones(256, bool)
NOT_TERM[0x80:] = False
NOT_TERM[0x30:0x3A] = NOT_TERM[0x41:0x5B] = NOT_TERM[0x61:0x7B] = False

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it: the halves' products fit into 64 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid, small = ah * bl + al * bh, al * bl
    out = ((ah * bh) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half)
    return _fold(out + (small & _P) + (small >> np.uint64(61)))


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _product(out[:more], np.full(more, pow(base, have, _PRIME), np.uint64))
        have += more
    return out


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Upper and lower bits of the base's powers, and the powers of its inverse."""
    if not _tables or len(_tables[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up = _powers_of(_BASE, size)
        _tables[:] = [up >> np.uint64(31), up & np.uint64((1 << 31) - 1), _powers_of(pow(_BASE, -1, _PRIME), size)]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some consecutive texts of a batch: their bytes and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._sums: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets, self.first)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The index of the text that holds each byte position."""
        return np.searchsorted(self.offsets[1:], positions, side="right")

    def pieces(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of the maximal runs without separators; none crosses texts."""
        inside = ~separator[self.data]
        brk = np.zeros(len(self.data) + 1, bool)
        brk[self.offsets] = True
        before, after = brk[:-1].copy(), brk[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        return starts, ends, self.text_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of the lines; n newlines make n + 1 lines."""
        nl = np.flatnonzero(self.data == 10)
        of = self.text_of(nl)
        counts = np.bincount(of, minlength=self.n) + 1
        text = np.repeat(np.arange(self.n), counts)
        head = np.cumsum(counts) - counts
        starts = np.empty(len(text), np.int64)
        ends = np.empty(len(text), np.int64)
        first = np.zeros(len(text), bool)
        first[head] = True
        starts[first] = self.offsets[:-1]
        starts[~first] = nl + 1
        last = np.zeros(len(text), bool)
        last[head + counts - 1] = True
        ends[last] = self.offsets[1:]
        ends[~last] = nl
        return starts, ends, text

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, from prefix sums of a polynomial modulo a prime; lengths count."""
        size = (ends - starts).astype(np.uint64)
        return mix(self._residues(starts, ends) + size * np.uint64(0xD6E8FEB86659FD93))

    def _residues(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        upper, lower, down = _power_tables(len(self.data))
        if self._sums is None:
            n = len(self.data)
            value = self.data.astype(np.uint64) + np.uint64(1)
            self._sums = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
            # Sums wrap around at 2**64, but a range's own part is below that and so its difference is right.
            np.cumsum(value * upper[:n], out=self._sums[0][1:])
            np.cumsum(value * lower[:n], out=self._sums[1][1:])
        if len(starts) and int((ends - starts).max()) > _SPAN:
            return np.array([self._long_residue(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        high, low = self._sums[0][ends] - self._sums[0][starts], self._sums[1][ends] - self._sums[1][starts]
        both = (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (low & _P) + (low >> np.uint64(61))
        return _product(_fold(both), down[starts])

    def _long_residue(self, a: int, b: int) -> int:
        out = 0
        for at in range(a, b, _SPAN):
            part = self._residues(np.array([at]), np.array([min(b, at + _SPAN)]))[0]
            out = (out + int(part) * pow(_BASE, at - a, _PRIME)) % _PRIME
        return out

    def string(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts, as many at once as have `limit` bytes together, one at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for row in range(0, len(column), SLICE_ROWS):
        # A slice at a time, so that a batch is never copied whole.
        part = pc.fill_null(column.slice(row, SLICE_ROWS).cast(pa.large_string()), "")
        _, off, buf = part.buffers()
        offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
            b = min(b, len(part))
            yield Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], row + a)
            a = b


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xC6A4A7935BD1E995)
    x += b
    x ^= x >> np.uint64(29)
    return x


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` bytes, put together from runs whose lengths are powers of two."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, size, out, have = _BYTE[data], 1, None, 0
    while True:
        if width & size:
            out = run[:n] if out is None else _joined(out, run[have : have + n])
            have += size
        if 2 * size > width:
            return mix(out)
        run, size = _joined(run[:-size], run[size:]), 2 * size


def windows(hashes: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start index of each run of `width` hashes that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xC6A4A7935BD1E995) + hashes[j : j + n]
    at = np.flatnonzero(of[:n] == of[width - 1 :])
    return mix(out[at]), at


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of ranges of these sizes, one range after the other."""
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - stop + size, size)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def squeezed(*columns: np.ndarray) -> bytes:
    """Numbers as compressed bytes, plane by plane; the first column, in order, as differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])]
    return len(first).to_bytes(8, "little") + zstandard.compress(b"".join(planes), 1)


def unsqueezed(x: bytes, kinds: tuple = (np.uint64,)) -> list[np.ndarray]:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(zstandard.decompress(x[8:]), np.uint8).reshape(len(kinds), 8, n)
    out = [np.ascontiguousarray(planes[i].T).view(k).ravel() for i, k in enumerate(kinds)]
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out
