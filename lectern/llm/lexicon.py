"""A vocabulary as a trie, and the Levenshtein automata of words intersected with it.

The automaton of a word accepts every word within a number of edits: insertions, deletions and substitutions of a
character, and merges and splits (two characters read as one, one as two), which are what scanning does. Walking trie and
automata together visits only prefixes that can still lead to an accepted word, so the candidates are complete.

The automata of many words walk at once. A state is the distance of the path in the trie from each prefix of the word; as
only prefixes nearly as long as the path can be within reach, it is a band of few small numbers, whatever the word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (read, meant) pairs of characters that are commonly taken for one another in scanned text, in lower case.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("2", "z"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("6", "g"), ("7", "t"), ("8", "b"), ("9", "g"), ("9", "q"),
    ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("f", "e"), ("e", "f"), ("y", "v"), ("v", "y"),
    ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("g", "q"), ("q", "g"), ("i", "j"), ("j", "i"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("nn", "m"), ("ri", "n"), ("n", "ri"),
)
#: Letters read for digits.
DIGITS = {"l": "1", "I": "1", "|": "1", "i": "1", "!": "1", "O": "0", "o": "0", "D": "0", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9", "q": "9", "Z": "2", "z": "2"}

_BY_MEANT: dict[str, list[tuple[str, str]]] = {}
for _read, _meant in CONFUSIONS:
    _BY_MEANT.setdefault(_read[-1] + _meant[-1], []).append((_read, _meant))


EDITS = 2
_BAND, _FAR = 2 * EDITS + 1, 99
_AT_ONCE = 1 << 17


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, a row each, ended by zeros, and their lengths."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    table[np.arange(table.shape[1]) < size[:, None]] = codes
    return table, size


class Trie:
    """Words of one length. For each depth: the letter of each node and where its children begin in the next depth."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        table, size = _letters(self.words)
        self.depth = int(size[0])
        fresh = np.zeros(len(self.words), bool)
        fresh[0] = True
        firsts = [np.zeros(1, np.int64)]  # the first word below each node of a depth
        self.letters, self.children = [], []
        for d in range(self.depth):
            fresh[1:] |= table[1:, d] != table[:-1, d]
            firsts.append(np.flatnonzero(fresh))
            self.letters.append(table[firsts[-1], d])
        for above, below in zip(firsts, firsts[1:]):
            self.children.append(np.append(np.searchsorted(below, above), len(below)))

    def within(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(token, word)``: every word within ``EDITS`` edits of each token, as numbers."""
        table, size = _letters(tokens)
        padded = np.zeros((len(tokens), max(self.depth, table.shape[1]) + 2 * _BAND), np.uint32)
        padded[:, _BAND : _BAND + table.shape[1]] = table
        offset = np.arange(_BAND) - EDITS
        found = []
        start = np.where((offset >= 0) & (offset <= size[:, None]), offset, _FAR).astype(np.int8)
        stack = [(0, np.arange(len(tokens)), np.zeros(len(tokens), np.int64), start, np.full_like(start, _FAR))]
        while stack:
            depth, token, node, row, above = stack.pop()
            if depth == self.depth:
                end = size[token] - depth + EDITS
                inside = np.flatnonzero((end >= 0) & (end < _BAND))
                good = inside[row[inside, end[inside]] <= EDITS]
                found.append((token[good], node[good]))
                continue
            first, after = self.children[depth][node], self.children[depth][node + 1]
            if len(token) > 1 and (after - first).sum() > _AT_ONCE:
                half = len(token) // 2
                stack += [(depth, *(x[cut] for x in (token, node, row, above))) for cut in (slice(half), slice(half, None))]
                continue
            child, own = _ranges(first, after)
            token, row, above = token[own], row[own], above[own]
            depth += 1
            letter = self.letters[depth - 1][child]
            # The prefix of length j = depth + offset ends with the token's letter j - 1.
            ends = padded[token[:, None], depth + offset - 1 + _BAND]
            out = np.minimum(row + (ends != letter[:, None]), _FAR)
            out[:, :-1] = np.minimum(out[:, :-1], np.minimum(row[:, 1:], above[:, 1:]) + 1)
            out[:, 1:] = np.minimum(out[:, 1:], row[:, :-1] + 1)
            length = depth + offset
            out[(length < 0) | (length > size[token][:, None])] = _FAR
            for k in range(1, _BAND):
                out[:, k] = np.minimum(out[:, k], np.where(length[k] <= size[token], out[:, k - 1] + 1, _FAR))
            out = np.minimum(out, _FAR).astype(np.int8)
            live = (out.min(axis=1) <= EDITS) | (row.min(axis=1) < EDITS)
            stack.append((depth, token[live], child[live], out[live], row[live]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _ranges(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    count = after - first
    own = np.repeat(np.arange(len(first)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count), own


def misreadings(read: list[str], meant: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(confusions, others)`` for each ``read`` and the word ``meant`` beside it: of the ways to turn one into the other,
    the one with the least of others counted twice.

    Confusions are those of ``CONFUSIONS``; others are any insertion, deletion, substitution, merge or split. Pairs of
    equal lengths are looked at together: a table over their prefixes, each cell an array.
    """
    confusions, others = np.zeros(len(read), np.int32), np.zeros(len(read), np.int32)
    (r, r_size), (m, m_size) = _letters(read), _letters(meant)
    for x, y in set(zip(r_size.tolist(), m_size.tolist())):
        own = np.flatnonzero((r_size == x) & (m_size == y))
        for part in np.array_split(own, max(1, len(own) // (1 << 16))):
            best = _least_edits(r[part, :x], m[part, :y])
            confusions[part], others[part] = best // _STEP % _STEP, best % _STEP
    return confusions, others


#: A cost, confusions and others in one number, so that the least number is the least cost.
_STEP = 1 << 10
_CONFUSED, _OTHER = _STEP * _STEP + _STEP, 2 * _STEP * _STEP + 1


def _least_edits(read: np.ndarray, meant: np.ndarray) -> np.ndarray:
    table: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(len(read), np.int64)}
    for i in range(read.shape[1] + 1):
        for j in range(meant.shape[1] + 1):
            if abs(i - j) > EDITS + 1 or i == j == 0:
                continue
            best = np.full(len(read), np.iinfo(np.int64).max // 2)
            for a, b in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
                if (i - a, j - b) in table:
                    best = np.minimum(best, table[i - a, j - b] + _OTHER)
            if (i - 1, j - 1) in table:
                last, other = read[:, i - 1], meant[:, j - 1]
                best = np.where(last == other, np.minimum(best, table[i - 1, j - 1]), best)
                for (x, y), ways in _BY_MEANT.items():
                    here = np.flatnonzero((last == ord(x)) & (other == ord(y)))
                    for a, b in ways if len(here) else ():
                        if (i - len(a), j - len(b)) in table:
                            fits = here
                            for k, letter in enumerate(reversed(a)):
                                fits = fits[read[fits, i - 1 - k] == ord(letter)]
                            for k, letter in enumerate(reversed(b)):
                                fits = fits[meant[fits, j - 1 - k] == ord(letter)]
                            best[fits] = np.minimum(best[fits], table[i - len(a), j - len(b)][fits] + _CONFUSED)
            table[i, j] = best
    return table[read.shape[1], meant.shape[1]]


def misread_number(token: str) -> str | None:
    """The number meant by a token of digits, number signs and at least one letter read for a digit; else None."""
    if not any(c.isdigit() for c in token) or not any(c in DIGITS for c in token):
        return None
    meant = "".join(DIGITS.get(c, c) for c in token)
    return meant if all(c.isdigit() or c in ".,:/-+%$" for c in meant) else None


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int | None:
    """The value of a well-formed Roman numeral, in either letter case."""
    low = text.lower()
    if not low or any(c not in _ROMAN for c in low):
        return None
    total = 0
    for here, following in zip(low, low[1:] + " "):
        value = _ROMAN[here]
        total += -value if _ROMAN.get(following, 0) > value else value
    return total if _as_roman(total) == low else None


def _as_roman(number: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while number >= value:
            out, number = out + sign, number - value
    return out
