"""Suffix sorting of one shard by recursive induction over disk-backed queues.

Induced sorting visits suffixes in order and derives from each the place of the
suffix one symbol longer.  The pending suffixes wait in a priority queue whose
keys are symbols and whose entries of one key leave in the order they came;
the queue spills its entries to a temporary file beyond a memory limit, so a
shard's queue is not bound by memory.  All entries of the least key leave as
one block and induce as arrays; alphabets nearly as large as their text (deep
recursion) are handled entry by entry.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np


class DiskQueue:
    """Priority queue of (symbol, position): symbols leave in order, positions of one symbol first in, first out."""

    def __init__(self, memory_bytes: int, descending: bool = False):
        self.sign = -1 if descending else 1
        self.limit, self.held = memory_bytes, 0
        self.blocks: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}
        self.heap: list[int] = []
        self.known: set[int] = set()
        self.file = None

    def announce(self, symbol: int) -> None:
        if symbol not in self.known:
            self.known.add(symbol)
            heapq.heappush(self.heap, self.sign * symbol)

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, block in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
            self.announce(symbol)
            self.blocks.setdefault(symbol, []).append(block)
        self.held += positions.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, blocks in self.blocks.items():
            block = np.concatenate(blocks)
            self.spilled.setdefault(symbol, []).append((self.file.tell(), len(block)))
            self.file.write(block.tobytes())
        self.blocks.clear()
        self.held = 0

    def next_symbol(self) -> int | None:
        if not self.heap:
            return None
        symbol = self.sign * heapq.heappop(self.heap)
        self.known.discard(symbol)
        return symbol

    def take(self, symbol: int) -> np.ndarray:
        parts = []
        for at, n in self.spilled.pop(symbol, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * n), np.int64))
        for block in self.blocks.pop(symbol, ()):
            parts.append(block)
            self.held -= block.nbytes
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _by_symbol(text: np.ndarray, positions: np.ndarray) -> dict[int, np.ndarray]:
    symbols = text[positions]
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    heads = symbols[np.concatenate([[0], cuts])] if len(symbols) else symbols
    return dict(zip(heads.tolist(), np.split(positions, cuts), strict=True)) if len(symbols) else {}


def _induce_blocks(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    n = len(text)
    start = _by_symbol(text, seeds)
    falling: dict[int, np.ndarray] = {}
    queue = DiskQueue(memory)
    queue.push(text[n - 1 :], np.array([n - 1]))
    for symbol in start:
        queue.announce(symbol)
    while (c := queue.next_symbol()) is not None:
        parts, block = [], queue.take(c)
        while len(block):
            parts.append(block)
            before = block[block > 0] - 1
            before = before[~rising[before]]
            symbol = text[before]
            own = symbol == c
            queue.push(symbol[~own], before[~own])
            block = before[own]
        if parts:
            falling[c] = np.concatenate(parts)
        if c in start:
            before = start[c][start[c] > 0] - 1
            queue.push(text[before], before)
    queue.close()

    out: list[np.ndarray] = []
    queue = DiskQueue(memory, descending=True)
    for symbol in falling:
        queue.announce(symbol)
    while (c := queue.next_symbol()) is not None:
        parts, block = [], queue.take(c)
        while len(block):
            parts.append(block)
            before = block[block > 0] - 1
            before = before[rising[before]]
            symbol = text[before]
            own = symbol == c
            queue.push(symbol[~own], before[~own])
            block = before[own]
        if c in falling:
            block = falling[c][::-1]
            parts.append(block)
            before = block[block > 0] - 1
            before = before[rising[before]]
            queue.push(text[before], before)
        out += parts
    queue.close()
    return np.concatenate(out)[::-1]


def _induce_entries(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    t, up = text.tolist(), rising.tolist()
    start: dict[int, list[int]] = {}
    for i in seeds.tolist():
        start.setdefault(t[i], []).append(i)
    waiting: dict[int, list[int]] = {t[-1]: [len(t) - 1]}
    heap = list({*start, t[-1]})
    heapq.heapify(heap)
    known = set(heap)
    falling: dict[int, list[int]] = {}

    def push(i: int, sign: int) -> None:
        s = t[i]
        if s not in known:
            known.add(s)
            heapq.heappush(heap, sign * s)
        waiting.setdefault(s, []).append(i)

    while heap:
        c = heapq.heappop(heap)
        items = waiting.setdefault(c, [])
        for i in items:  # grows while it is read: equal symbols induce into the same list
            if i and not up[i - 1]:
                push(i - 1, 1)
        falling[c] = items
        for i in start.get(c, ()):
            if i:
                push(i - 1, 1)
    waiting = {}
    heap = [-s for s in falling]
    heapq.heapify(heap)
    known = set(falling)
    out: list[int] = []
    while heap:
        c = -heapq.heappop(heap)
        items = waiting.setdefault(c, [])
        for i in items:
            if i and up[i - 1]:
                push(i - 1, -1)
        out += items
        for i in reversed(falling.get(c, ())):
            out.append(i)
            if i and up[i - 1]:
                push(i - 1, -1)
    return np.array(out[::-1], np.int64)


def _induce(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    if len(text) > 16 * (int(text.max()) + 1):
        return _induce_blocks(text, rising, seeds, memory)
    return _induce_entries(text, rising, seeds)


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text of names, by ranking ever longer prefixes: whole-array sorts only."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        step *= 2


def suffix_array(text: np.ndarray, memory: int = 64 << 20, inductions: int = 99) -> np.ndarray:
    """Positions of all suffixes of `text` (non-negative integers) in lexicographic order; an end precedes any symbol.

    The stretches between seeds are named and the text of names is sorted by
    recursion, `inductions` levels deep at most; a text of names that is left
    after that has nearly as many names as places and is ranked by doubling.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    differs = np.flatnonzero(text[1:] != text[:-1])
    at = np.searchsorted(differs, np.arange(n))
    rising = np.zeros(n, bool)
    inner = at < len(differs)
    step = differs[at[inner]]
    rising[inner] = text[step + 1] > text[step]
    seeds = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(seeds) < 2:
        return _induce(text, rising, seeds, memory)
    first = _induce(text, rising, seeds, memory)
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    order = first[is_seed[first]]
    # Name the stretches from one seed to the next; equal neighbours in order share a name.
    index = np.searchsorted(seeds, order)
    ends = np.append(seeds[1:], n)[index]
    a, b = order[:-1], order[1:]
    size_a, size_b = ends[:-1] - a, ends[1:] - b
    same = (size_a == size_b) & (ends[:-1] < n) & (ends[1:] < n)
    live, depth = np.flatnonzero(same), 0
    while len(live):
        ok = text[a[live] + depth] == text[b[live] + depth]
        same[live[~ok]] = False
        live = live[ok]
        live = live[size_a[live] > depth]
        depth += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(seeds):
        reduced = np.empty(len(seeds), np.int64)
        reduced[index] = names
        order = seeds[suffix_array(reduced, memory, inductions - 1) if inductions > 1 else _by_doubling(reduced)]
    return _induce(text, rising, order, memory)


def neighbours_share(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of `order` has `length` bytes in common with the one before it."""
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else ():
        live = live[words[order[live] + at] == words[order[live - 1] + at]]
    if length < 8:
        for at in range(length):
            live = live[data[order[live] + at] == data[order[live - 1] + at]]
    out[live] = True
    return out
