"""A Gray-order hierarchical index over bit fingerprints, built for many blocks at once.

Within a block the fingerprints are sorted by their rank in the Gray code, so that neighbours differ in few bits. Runs
of neighbours become nodes, runs of nodes become upper nodes, up to one root a block. A node keeps the bits on which all
below it agree, as a mask and a pattern; bits that its parent has already are left out of its own mask, so shared
patterns are factored into the upper nodes. A query walks down and adds up the differences within the masks; as soon as
the sum passes what a pair may differ by, everything below the node is pruned.
"""

from __future__ import annotations

import numpy as np

FAN = 8
FRONTIER = 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """For rows of 64-bit words (the most significant first), the number whose Gray code each row is, as such rows."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    for k in range(1, out.shape[1]):
        out[:, k] ^= np.uint64(0) - (out[:, k - 1] & np.uint64(1))
    return out


class GrayForest:
    """The index of all blocks; ``block`` and ``size`` (the number of elements of the set behind a fingerprint) are a row's."""

    def __init__(self, block: np.ndarray, codes: np.ndarray, size: np.ndarray) -> None:
        rank = gray_rank(codes)
        self.order = np.lexsort([*(rank[:, k] for k in range(rank.shape[1] - 1, -1, -1)), block])
        self.block, self.codes, self.size = block[self.order], codes[self.order], size[self.order]
        # levels[0] are the rows; each further level has, for a node, its first child and the one after its last.
        self.levels: list[dict] = [{"low": self.codes, "high": self.codes, "least": self.size, "most": self.size, "block": self.block}]
        while True:
            below = self.levels[-1]
            starts = np.flatnonzero(np.concatenate([[True], below["block"][1:] != below["block"][:-1]]))
            count = np.diff(np.append(starts, len(below["block"])))
            if len(self.levels) > 1 and count.max() == 1:
                break
            place = np.arange(len(below["block"])) - np.repeat(starts, count)
            first = np.flatnonzero(place % FAN == 0)
            self.levels.append(
                {
                    "low": np.bitwise_and.reduceat(below["low"], first),
                    "high": np.bitwise_or.reduceat(below["high"], first),
                    "least": np.minimum.reduceat(below["least"], first),
                    "most": np.maximum.reduceat(below["most"], first),
                    "block": below["block"][first],
                    "first": first,
                    "after": np.append(first[1:], len(below["block"])),
                }
            )
        parent_mask = None
        for level in reversed(self.levels):
            mask = ~(level["low"] ^ level["high"])
            level["own"] = mask if parent_mask is None else mask & ~parent_mask
            if level is not self.levels[0]:
                parent_mask = np.repeat(mask, level["after"] - level["first"], axis=0)

    def pairs(self, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of input rows of one block that can reach the Jaccard ``similarity``, each pair once.

        Sets A and B of such similarity differ in at most (1 - s) / (1 + s) * (|A| + |B|) elements, and a parity
        fingerprint differs in no more bits than its set does in elements, so no such pair is pruned.
        """
        top = self.levels[-1]
        root = np.searchsorted(top["block"], self.block)
        share = (1 - similarity) / (1 + similarity)
        found_a, found_b = [], []
        stack = [(len(self.levels) - 1, q, root[q], np.zeros(len(q), np.int32)) for q in np.array_split(np.arange(len(self.block)), max(1, len(self.block) // (1 << 16)))]
        while stack:
            depth, query, node, far = stack.pop()
            level = self.levels[depth]
            far = far + np.bitwise_count((self.codes[query] ^ level["low"][node]) & level["own"][node]).sum(axis=1, dtype=np.int32)
            size = self.size[query]
            widest = np.minimum(level["most"][node], np.floor(size / similarity + 1e-9))
            keep = (far <= share * (size + widest) + 1e-9) & (level["least"][node] <= widest) & (level["most"][node] >= similarity * size - 1e-9)
            if depth == 0:
                keep &= query < node
                found_a.append(query[keep]), found_b.append(node[keep])
                continue
            query, node, far = query[keep], node[keep], far[keep]
            first, count = level["first"][node], (level["after"] - level["first"])[node]
            begin = np.cumsum(count) - count
            child = np.arange(count.sum()) - np.repeat(begin - first, count)
            query, far = np.repeat(query, count), np.repeat(far, count)
            for part in range(0, len(child), FRONTIER):
                cut = slice(part, part + FRONTIER)
                stack.append((depth - 1, query[cut], child[cut], far[cut]))
        empty = np.zeros(0, np.int64)
        return self.order[np.concatenate([empty, *found_a])], self.order[np.concatenate([empty, *found_b])]
