"""Two-stage suffix sorting of short pieces of text, for windows of a fixed length.

A suffix that is smaller than its successor is sorted directly. Every other suffix i is
larger than suffix i + 1, so one scan over the sorted buckets in ascending order of their
first symbol meets i + 1 before i's own bucket and puts i in its place.
"""

from __future__ import annotations

import numpy as np

# Symbols are bytes plus one; 0 ends a piece. Seven of them fit a 64-bit word.
_BITS, _WORD = 9, 7
_STEP = np.uint64(0x9E3779B97F4A7C15)


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces as symbols, each ended by 0, and where each begins."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes - 1] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    return symbols, begins


def words_of(symbols: np.ndarray, window: int) -> np.ndarray:
    """For each place the next seven symbols as one ordered number; beyond the end there is 0."""
    padded = np.concatenate((symbols, np.zeros(window + 2 * _WORD, np.uint16))).astype(np.uint64)
    packed = np.zeros(len(padded) - _WORD + 1, np.uint64)
    for j in range(_WORD):
        packed |= padded[j : len(packed) + j] << np.uint64(_BITS * (_WORD - 1 - j))
    return packed


class Ranges:
    """64-bit hashes of any range of symbols; beyond the end there are zeros."""

    def __init__(self, symbols: np.ndarray, most: int):
        padded = np.concatenate((symbols, np.zeros(2 * most, np.uint16))).astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(padded * np.multiply.accumulate(np.full(len(padded), _STEP)))))
        self.scale = np.multiply.accumulate(np.full(len(padded), np.uint64(pow(int(_STEP), -1, 2**64))))

    def hashes(self, places: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[places + size] - self.sums[places]) * self.scale[places]

    def shared(self, x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
        """How many symbols each pair of places shares, up to ``window``."""
        found = np.zeros(len(x), np.int64)
        step = 1 << (window.bit_length() - 1)
        while step:
            more = self.hashes(x + found, step) == self.hashes(y + found, step)
            found += np.where(more & (found + step <= window), step, 0)
            step >>= 1
        return found


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one counts as such."""
    change = np.append(np.diff(symbols.astype(np.int32)), 1)
    places = np.where(change != 0, np.arange(len(symbols)), len(symbols))
    following = np.minimum.accumulate(places[::-1])[::-1]
    return change[following] > 0


def sorted_directly(places: np.ndarray, packed: np.ndarray, ranges: Ranges, window: int) -> np.ndarray:
    """``places`` in the order of their next ``window`` symbols.

    Equal windows are sorted once. In a round every group of tied places skips what all of
    it shares and is split by the seven symbols that follow.
    """
    _, first, copies = np.unique(ranges.hashes(places, window), return_index=True, return_inverse=True)
    own = places[first]
    rank = np.zeros(len(own), np.int64)
    active, depth = np.arange(len(own)), np.zeros(len(own), np.int64)
    while len(active):
        word = packed[own[active] + depth]
        order = np.lexsort((word, rank[active]))
        active, word, tied = active[order], word[order], rank[active][order]
        old = np.concatenate(([True], tied[1:] != tied[:-1]))
        new = old | np.concatenate(([True], word[1:] != word[:-1]))
        at = np.arange(len(active))
        # A group keeps the rank of its first member; further ones are counted from there.
        rank[active] = tied + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        active = active[~(new & np.append(new[1:], True))]
        if len(active):
            tied = rank[active]
            starts = np.flatnonzero(np.concatenate(([True], tied[1:] != tied[:-1])))
            sizes = np.diff(np.append(starts, len(active)))
            leader = np.repeat(own[active[starts]], sizes)
            depth = np.repeat(np.minimum.reduceat(ranges.shared(own[active], leader, window), starts), sizes)
    return places[np.argsort(rank[copies], kind="stable")]


def suffix_array(symbols: np.ndarray, window: int, ranges: Ranges | None = None) -> np.ndarray:
    """All places, ordered by at least their next ``window`` symbols."""
    small = smaller_than_next(symbols)
    direct = sorted_directly(np.flatnonzero(small), words_of(symbols, window), ranges or Ranges(symbols, window), window)
    first = symbols[direct]
    waiting: dict[int, list[np.ndarray]] = {}
    result = []

    def induce(scanned: np.ndarray, symbol: int) -> np.ndarray:
        """Hand the larger predecessors on to their buckets; give back those within this one."""
        before = scanned[scanned > 0] - 1
        initial = symbols[before]
        later, of = before[initial > symbol], initial[initial > symbol]
        if len(later):
            order = np.argsort(of, kind="stable")
            later, of = later[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(later, cuts):
                waiting.setdefault(int(symbols[part[0]]), []).append(part)
        return before[initial == symbol]

    for symbol in np.unique(symbols):
        level = np.concatenate(waiting.pop(int(symbol), [np.zeros(0, np.int64)]))
        # A run of one symbol: what precedes a larger suffix in this bucket follows it, level by level.
        while len(level):
            result.append(level)
            level = induce(level, symbol)
        own = direct[np.searchsorted(first, symbol, "left") : np.searchsorted(first, symbol, "right")]
        result.append(own)
        induce(own, symbol)
    return np.concatenate(result) if result else np.zeros(0, np.int64)


def common_prefixes(x: np.ndarray, y: np.ndarray, symbols: np.ndarray, window: int) -> np.ndarray:
    """How many symbols each pair of places shares, up to ``window``, compared one by one."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((symbols, np.zeros(window, np.uint16))), window)
    found = np.full(len(x), window)
    for i in range(0, len(x), 4096):
        differ = rows[x[i : i + 4096]] != rows[y[i : i + 4096]]
        some = differ.any(1)
        found[i : i + 4096][some] = differ[some].argmax(1)
    return found


def repeated_windows(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows that occur at another place of the pieces."""
    symbols, begins = joined(pieces)
    ranges = Ranges(symbols, window)
    order = suffix_array(symbols, window, ranges)
    # Neighbours whose windows have different hashes share less than a window.
    hashes = ranges.hashes(order, window)
    near = np.flatnonzero(hashes[1:] == hashes[:-1])
    long = near[common_prefixes(order[near], order[near + 1], symbols, window) >= window]
    found = np.zeros(len(symbols), bool)
    found[order[long]] = found[order[long + 1]] = True
    # A window that reaches beyond its piece holds its end mark, and so do all windows equal to it.
    return [np.flatnonzero(found[b : b + max(0, len(p) - window + 1)]) for b, p in zip(begins, pieces)]
