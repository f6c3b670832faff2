"""Suffix and common-prefix arrays of many strings by induced sorting, with queues that spill to disk."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Ends a string; below every byte.  A zero byte of the text is written as one that UTF-8 does not use.
END, ZERO, PAD = 0, 0xC0, 0xFF
#: Entries that one step takes from a queue.
STEP = 1 << 20


class Queues:
    """One first-in-first-out queue of (position, common prefix) for each symbol.

    Induction pushes into a symbol's bucket in the order of the sources' ranks, so the priority
    order (symbol, rank) is the order of arrival in each symbol's queue.  Beyond ``memory`` entries held, all that is
    held goes to an unnamed file of the task, which the system removes with the task.
    """

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.file = memory, 0, None
        self.parts: list[list] = [[] for _ in range(256)]

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((positions, common))
        self.held += len(positions)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(part[0].tobytes() + part[1].tobytes())
                    parts[i] = (at, len(part[0]), part[0].dtype)
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has arrived so far, in order and in steps; small arrivals are taken together."""
        arrived, self.parts[symbol] = self.parts[symbol], []
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in arrived:
            if isinstance(part[0], np.ndarray):
                self.held -= len(part[0])
            else:
                at, n, kind = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(2 * n), np.int16)
            taken.append(part)
            size += len(part[0])
            if size >= STEP:
                yield from self._steps(taken)
                taken, size = [], 0
        if taken:
            yield from self._steps(taken)

    def pop_back(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has arrived, the last steps first; inside a step in order."""
        arrived, self.parts[symbol] = self.parts[symbol], []
        while arrived:
            size = 0
            for first in range(len(arrived) - 1, -1, -1):
                part = arrived[first]
                size += len(part[0]) if isinstance(part[0], np.ndarray) else part[1]
                if size >= STEP:
                    break
            self.parts[symbol], arrived = arrived[first:], arrived[:first]
            yield from reversed(list(self.pop(symbol)))

    @staticmethod
    def _steps(parts):
        positions, common = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts))
        for start in range(0, len(positions), STEP):
            yield positions[start : start + STEP], common[start : start + STEP]


def joined(strings: list[bytes]) -> np.ndarray:
    """The strings one after the other, each with its end."""
    text = np.frombuffer(b"\0".join([*(s.replace(b"\0", b"\xc0") for s in strings), b""]), np.uint8)
    return text if len(text) else np.zeros(1, np.uint8)


def _eight(text: np.ndarray) -> np.ndarray:
    """Views of eight bytes at every place."""
    padded = np.concatenate([text, np.full(16, PAD, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(text) + 8, 8), (1, 1))


def _words(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64)


def common_prefix(eight: np.ndarray, one: np.ndarray, other: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at ``one`` and ``other`` share, up to ``depth``, compared eight at once."""
    found = np.full(len(one), depth, np.int16)
    live = np.arange(len(one))
    limit = len(eight) - 1
    for step in range(0, depth, 8):
        apart = _words(eight, np.minimum(one[live] + step, limit)) ^ _words(eight, np.minimum(other[live] + step, limit))
        ended = apart != 0
        if ended.any():
            bits = np.frexp(apart[ended].astype(np.float64))[1]  # 2**53 and more may round up by one bit
            bits = np.where((apart[ended] >> (np.minimum(bits, 64) - 1).astype(np.uint64)) == 0, bits - 1, bits)
            found[live[ended]] = np.minimum(depth, step + (64 - bits) // 8)
            live = live[~ended]
        if not len(live):
            break
    return found


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S), False where it is larger (L).  The last place is S."""
    n = len(text)
    smaller = np.empty(n, bool)
    differs = np.empty(n, bool)
    smaller[:-1], differs[:-1] = text[:-1] < text[1:], text[:-1] != text[1:]
    smaller[-1], differs[-1] = True, True
    # Of equal neighbours the next place that differs decides; an end counts as S by itself.
    smaller[text == END], differs[text == END] = True, True
    nearest = np.where(differs, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return smaller[nearest]


def sorted_seeds(text: np.ndarray, eight: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """The seeds (leftmost S places) in the order of their suffixes, to ``depth`` bytes at least.

    A seed's substring up to the next seed, that one's first byte included, becomes a name; longer
    substrings are cut into names of eight bytes.  Names that are not unique yet are refined by the
    names that follow, twice as many in each recursion; an end follows itself.
    """
    following = np.append(seeds[1:], len(text))
    cuts = np.maximum(0, (following - seeds - 1) // 8)
    cuts[text[seeds] == END] = 0
    within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    points = np.sort(np.concatenate([seeds, np.repeat(seeds, cuts) + 8 * (within + 1)]))
    points = points[np.concatenate([[True], points[1:] != points[:-1]])]
    after = np.append(np.arange(1, len(points)), len(points) - 1)
    ends = text[points] == END
    after[ends] = np.flatnonzero(ends)
    key = _words(eight, points)
    # Behind the first byte of the next seed all bits are set, and a substring sorts after longer ones that begin alike.
    next_point = np.append(points[1:], points[-1])
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    length = np.where(is_seed[next_point], next_point - points + 1, 8)
    length[ends] = 1
    length = np.minimum(length, 8)
    key |= np.where(length < 8, (np.uint64(1) << (64 - 8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(0))
    rank, distinct = _ranks(key)
    covered = 1
    while distinct < len(points) and covered < depth:
        rank, distinct = _ranks(rank * (distinct + 1) + rank[after])
        after, covered = after[after], covered * 2
    mine = rank[np.searchsorted(points, seeds)]
    return seeds[np.argsort(mine, kind="stable")]


class _Carry:
    """For each symbol, the least common prefix of the sources scanned since its last push; -1 before the first."""

    def __init__(self) -> None:
        self.least = np.full(256, -1, np.int16)

    def routed(self, common: np.ndarray, index: np.ndarray, symbols: np.ndarray, depth: int):
        """(symbol, entries, common prefixes with the entry pushed before) of the scanned entries in ``index``."""
        out = []
        if len(index):
            order = np.argsort(symbols, kind="stable")
            at, symbol = index[order], symbols[order]
            first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            start = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
            padded = np.append(common, np.int16(0))
            least = np.minimum.reduceat(padded, np.column_stack([start, at + 1]).ravel())[::2]
            least[first] = np.minimum(least[first], self.least[symbol[first]])
            value = np.minimum(least + 1, depth).astype(np.int16)
            begins = np.append(np.flatnonzero(first), len(at))
            behind = np.append(np.minimum.accumulate(common[::-1])[::-1], np.int16(32000))
            whole = common.min()
            self.least = np.minimum(self.least, whole)
            for k in range(len(begins) - 1):
                part = slice(begins[k], begins[k + 1])
                out.append((int(symbol[begins[k]]), at[part], value[part]))
                self.least[symbol[begins[k]]] = behind[at[begins[k + 1] - 1] + 1]
        elif len(common):
            self.least = np.minimum(self.least, common.min())
        return out


def suffix_array(strings: list[bytes], depth: int, memory: int, found: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Hand ``found`` the suffixes of all strings in falling order, in batches (positions, common prefixes).

    Suffixes that agree in ``depth`` bytes may come in any order; a common prefix is that with the suffix
    before, up to ``depth``.  Returns the joined text that positions refer to.  Seeds are sorted by their names; a scan
    up through the buckets induces the L suffixes from them, a scan down the S suffixes from those.  Queue entries carry the
    common prefix with the entry before, which is one more than the least one among the sources between;
    only where the L and the S part of a bucket meet two suffixes are compared directly.
    """
    text = joined(strings)
    eight, small = _eight(text), types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = np.union1d(seeds, np.flatnonzero(text == END))
    seeds = sorted_seeds(text, eight, seeds, depth)
    seed_symbol = text[seeds]
    seed_common = np.concatenate([[0], common_prefix(eight, seeds[:-1], seeds[1:], depth)]).astype(np.int16)
    seed_common[np.concatenate([[True], seed_symbol[1:] != seed_symbol[:-1]])] = 0
    seed_common[seed_symbol == END] = 0
    bounds = np.searchsorted(seed_symbol, np.arange(257))
    meeting = lambda a, b: common_prefix(eight, np.array([a]), np.array([b]), depth)[0]

    # Up: L suffixes of each bucket, then its seeds.
    waiting, large, carry = Queues(memory), Queues(memory), _Carry()

    def scan(positions, common, symbol, goes, ends):
        """Push what lies before each place if it is of the type that is induced: ``goes`` compares it with the symbol."""
        before = text[positions - 1]
        go = goes(before, symbol) & (positions > 0)
        if not ends:
            go &= before != END
        index = np.flatnonzero(go)
        for target, at, value in carry.routed(common, index, before[index], depth):
            waiting.push(target, positions[at] - 1, value)

    for symbol in range(256):
        last = None
        while waiting.parts[symbol]:
            for positions, common in waiting.pop(symbol):
                large.push(symbol, positions, common)
                scan(positions, common, symbol, np.greater_equal, True)
                last = positions[-1]
        for start in range(bounds[symbol], bounds[symbol + 1], STEP):
            part = slice(start, min(start + STEP, bounds[symbol + 1]))
            common = seed_common[part].copy()
            if start == bounds[symbol] and last is not None:
                common[0] = meeting(last, seeds[start])
            scan(seeds[part], common, symbol, np.greater, True)

    # Down: S suffixes of each bucket, then its L suffixes; all of them, in falling order, are the result.
    waiting, carry = Queues(memory), _Carry()
    for symbol in range(255, END, -1):
        last = None
        while waiting.parts[symbol]:
            for positions, common in waiting.pop(symbol):
                found(positions, common)
                scan(positions, common, symbol, np.less_equal, False)
                last = positions[-1]
        following = None
        for positions, common in large.pop_back(symbol):
            falling = np.concatenate([[0], common[:0:-1]]).astype(np.int16)
            if following is not None:
                falling[0] = following
            elif last is not None:
                falling[0] = meeting(last, positions[-1])
            following = common[0]
            found(positions[::-1], falling)
            scan(positions[::-1], falling, symbol, np.less, False)
    return text
