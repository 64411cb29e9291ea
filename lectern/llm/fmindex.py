"""A compressed full-text index (FM-index) over one shard of texts, and matching statistics of many texts at once.

The Burrows-Wheeler transform of the shard is kept in a wavelet tree of bit vectors, with counts every 64 bits. Of the
suffix array every ``SAMPLED``-th place is kept; others are found by walking. Beside it lie the lengths that neighbouring
suffixes share, up to a cap, in one or two bytes each, by which a match is shortened from its end.
"""

from __future__ import annotations

import numpy as np


SAMPLED = 16
_BLOCK = 32


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of the suffixes of ``codes`` in order, by prefix doubling; the numbers that hold a suffix's first characters, and
    how many those are.

    After the first sort only suffixes that still tie take part in the further ones.
    """
    size = len(codes)
    bits = max(1, int(codes.max(initial=1)).bit_length())
    packed = 64 // bits
    key = np.zeros(size, dtype=np.uint64)
    for k in range(packed):
        key <<= np.uint64(bits)
        key[: size - k] |= codes[k:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    # A suffix's rank is the place of the first suffix that ties with it.
    start = np.flatnonzero(fresh)
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, size)))
    known = packed
    while True:
        place = rank[order]
        tied = np.flatnonzero((np.append(place[1:], -1) == place) | (np.concatenate([[-1], place[:-1]]) == place))
        if not len(tied):
            break
        suffix = order[tied]
        ahead = suffix + known
        following = np.where(ahead < size, rank[np.minimum(ahead, size - 1)] + 1, 0)
        again = np.lexsort((following, place[tied]))
        suffix, following, group = suffix[again], following[again], place[tied][again]
        order[tied] = suffix
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        start = np.flatnonzero(fresh)
        rank[suffix] = np.repeat(tied[start], np.diff(np.append(start, len(tied))))
        known *= 2
    return order, key, bits


def shared_lengths(order: np.ndarray, key: np.ndarray, bits: int, cap: int) -> np.ndarray:
    """How many characters each suffix shares with the one before it in order, at most ``cap``; -1 at either end."""
    packed, size = 64 // bits, len(order)
    far = np.zeros(size - 1, np.int64)
    live = np.arange(size - 1)
    while len(live):
        p, q = order[live] + far[live], order[live + 1] + far[live]
        inside = (np.maximum(p, q) < size) & (far[live] < cap)
        live, p, q = live[inside], p[inside], q[inside]
        differ = key[p] ^ key[q]
        same = np.full(len(live), packed)
        for k in range(packed - 1, -1, -1):
            same[(differ >> np.uint64((packed - 1 - k) * bits)) != 0] = k
        # The last of these to be written is the first character that differs.
        far[live] += same
        live = live[same == packed]
    return np.concatenate([[-1], np.minimum(far, cap), [-1]]).astype(np.int16 if cap > 100 else np.int8)


class WaveletTree:
    """Ranks over a sequence of small numbers: one bit vector a level, zeros before ones (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.size = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before each ``place``."""
        begin = np.zeros(len(place), dtype=np.int64)
        end = place.astype(np.int64, copy=True)
        for depth in range(self.bits):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            ones_begin, ones_end = self._ones(depth, begin), self._ones(depth, end)
            begin = np.where(one, self.zeros[depth] + ones_begin, begin - ones_begin)
            end = np.where(one, self.zeros[depth] + ones_end, end - ones_end)
        return end - begin

    def symbols(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each ``place``, and how often it stands before."""
        symbol, begin, end = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), place.astype(np.int64, copy=True)
        for depth in range(self.bits):
            one = (self.words[depth][end >> 6] >> (end & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones_begin, ones_end = self._ones(depth, begin), self._ones(depth, end)
            begin = np.where(one, self.zeros[depth] + ones_begin, begin - ones_begin)
            end = np.where(one, self.zeros[depth] + ones_end, end - ones_end)
            symbol = symbol << 1 | one
        return symbol, end - begin

    def _ones(self, depth: int, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = self.words[depth][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[depth][word] + np.bitwise_count(below)


class FMIndex:
    """``codes`` are the concatenated texts, each ended by a 0, in numbers from 0 without gaps. Matches are followed up to
    ``cap`` characters."""

    def __init__(self, codes: np.ndarray, cap: int) -> None:
        # A last symbol below all others makes the walk from a suffix to the one before it exact.
        codes = np.append(codes + 1, 0)
        order, key, bits = sorted_suffixes(codes)
        alphabet = int(codes.max(initial=0)) + 1
        self.size, self.cap = len(codes), cap
        self.tree = WaveletTree(codes[order - 1], max(1, (alphabet - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet))])
        self.marks = WaveletTree((order % SAMPLED == 0).astype(np.int64), 1)
        self.samples = order[order % SAMPLED == 0].astype(np.int32)
        self.shared = shared_lengths(order, key, bits, cap)
        # Least values of blocks, of blocks of blocks and so on, each level in rows of a block.
        self.lowest = []
        level = self.shared
        while True:
            self.lowest.append(np.append(level, np.full(-len(level) % _BLOCK, -1, level.dtype)).reshape(-1, _BLOCK))
            level = self.lowest[-1].min(axis=1)
            if len(level) == 1:
                break

    def places(self, row: np.ndarray) -> np.ndarray:
        """Where in ``codes`` the suffix of each row begins."""
        out, steps = np.full(len(row), -1, np.int64), 0
        live, row = np.arange(len(row)), row.copy()
        while len(live):
            marked, number = self.marks.symbols(row)
            at = marked == 1
            out[live[at]] = self.samples[number[at]] + steps
            live, row = live[~at], row[~at]
            symbol, number = self.tree.symbols(row)
            row = self.before[symbol] + number
            steps += 1
        return out

    def widened(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first ``length`` characters with those of ``[low, high)``."""
        return self._bound(low, length, -1), self._bound(high, length, 1)

    def _bound(self, place: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
        """From ``place`` on in the direction of ``step``, the first that shares less than ``length`` with the one before it."""
        place = place.copy()
        far = np.flatnonzero(self.shared[place] >= length)
        need, column = length[far], np.arange(_BLOCK)

        def first(low: np.ndarray) -> np.ndarray:
            return low.argmax(axis=1) if step > 0 else _BLOCK - 1 - low[:, ::-1].argmax(axis=1)

        # Up, until a block further on in the same row holds a lower value; then down to the first of them.
        live, at, found = np.arange(len(far)), place[far], []
        for rows in self.lowest:
            row, inside = at // _BLOCK, (at % _BLOCK)[:, None]
            low = (rows[row] < need[live][:, None]) & (column > inside if step > 0 else column < inside)
            has = low.any(axis=1)
            found.append((live[has], (row * _BLOCK + first(low))[has]))
            live, at = live[~has], row[~has]
            if not len(live):
                break
        own, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for level in range(len(found) - 1, -1, -1):
            own, node = np.concatenate([own, found[level][0]]), np.concatenate([node, found[level][1]])
            if level:
                node = node * _BLOCK + first(self.lowest[level - 1][node] < need[own][:, None])
        place[far[own]] = node
        return place

    def statistics(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """The matching statistics of the texts ``codes[begin:end]`` against the index: for each place the longest match, up
        to the cap, that begins there and stands in at least ``least`` places of the index.

        Each text is read backward: the match is extended by the character before it, or else shortened from its end.
        ``(text, place, low, high)`` are given where a match reaches the cap and may have places that the match at the next
        character didn't have; and, for every character of the texts, ``length``.
        """
        count = len(begin)
        at, length = end - 1, np.zeros(count, np.int64)
        low, high, wider = np.zeros(count, np.int64), np.full(count, self.size, np.int64), np.ones(count, bool)
        lengths = np.zeros(len(codes), np.int16)
        found: list[tuple] = []
        live = np.flatnonzero(at >= begin)
        while len(live):
            full = live[length[live] == self.cap]
            if len(full):
                length[full] -= 1
                new_low, new_high = self.widened(low[full], high[full], length[full])
                wider[full] = (new_low < low[full]) | (new_high > high[full])
                low[full], high[full] = new_low, new_high
            symbol = codes[at[live]] + 1
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            new_low, new_high = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
            good = new_high - new_low >= least[live]
            on = live[good]
            low[on], high[on] = new_low[good], new_high[good]
            length[on] += 1
            lengths[at[on]] = length[on]
            hit = on[(length[on] == self.cap) & wider[on]]
            found.append((hit, at[hit], low[hit], high[hit]))
            wider[hit] = False
            stuck = live[~good]
            short = stuck[length[stuck] > 0]
            length[short] = np.maximum(0, np.maximum(self.shared[low[short]], self.shared[high[short]]))
            low[short], high[short] = self.widened(low[short], high[short], length[short])
            wider[short] = True
            at[on] -= 1
            at[stuck[np.isin(stuck, short, invert=True)]] -= 1
            live = live[at[live] >= begin[live]]
        text, place, low, high = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        return text, place, low, high, lengths
