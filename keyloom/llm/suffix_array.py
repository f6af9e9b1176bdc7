"""Enhanced suffix array and the scan for maximal repeat groups, for texts that fit one task.

`SuffixArray` orders chosen suffixes of a set of leaves (byte strings), cut at their leaf's end or at DEPTH bytes,
with the longest common prefix of neighbours.  `repeat_groups` walks it once with a stack, which visits the nodes of
the common-prefix interval tree bottom up: an interval is a set of suffixes that share a prefix of at least
`min_len` bytes.  It is kept as a maximal repeat if it can't be extended to the left, that is if the bytes before
its occurrences differ or one of them has no byte before it; all its occurrences come with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from keyloom.llm.kernels import eight_bytes

#: Longest prefix that is compared, in bytes.
DEPTH = 128
#: What stands for "no byte before" in the left extension.
NO_LEFT = 256


class SuffixArray:
    """leaf, at: the suffixes in order; lcp[i]: what suffix i shares with suffix i-1 (lcp[0] is 0)."""

    def __init__(self, data: np.ndarray, leaf_start: np.ndarray, leaf_end: np.ndarray, leaf: np.ndarray, at: np.ndarray):
        eight = eight_bytes(np.concatenate([data, np.zeros(DEPTH + 8, dtype=np.uint8)])).byteswap()
        start = leaf_start[leaf] + at
        length = np.minimum(leaf_end[leaf] - start, DEPTH)
        n_words = -(-int(length.max()) // 8) if len(length) else 0
        words = []
        for w in range(n_words):
            beyond = np.clip(8 * (w + 1) - length, 0, 8).astype(np.uint64)  # bytes of the word past the leaf's end
            word = eight[start + 8 * w] >> np.minimum(8 * beyond, np.uint64(63))
            words.append(np.where(beyond == 8, np.uint64(0), word << np.minimum(8 * beyond, np.uint64(63))))
        order = np.lexsort([length, *words[::-1]]) if n_words else np.arange(len(start))
        self.leaf, self.at, length = leaf[order], at[order], length[order]
        lcp = np.zeros(len(order), dtype=np.int64)
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for word in words:
            x = word[order]
            diff = x[1:] ^ x[:-1]
            lcp[1:] += np.where(same, np.where(diff == 0, 8, _leading_zero_bytes(diff)), 0)
            same &= diff == 0
        lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
        self.lcp, self.length = lcp, length


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    n = np.zeros(len(x), dtype=np.int64)
    for k in range(7, 0, -1):
        n += (x >> np.uint64(8 * k)) == 0
    return n


def intervals(lcp: list[int], min_len: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of every common-prefix interval of at least `min_len`, children before parents."""
    stack: list[tuple[int, int]] = []  # (length, first)
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n and lcp[i] >= min_len else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield first, i - 1, length
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(sa: SuffixArray, left: np.ndarray, min_len: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the maximal repeats among the suffixes, children before parents.

    `left` has the byte before each suffix, NO_LEFT where there is none.
    """
    lcp = sa.lcp
    deep = lcp >= min_len
    block = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for a, b in zip(block[::2].tolist(), block[1::2].tolist(), strict=True):
        lo = a - 1
        mine = left[lo:b]
        if not _diverse(mine):  # then no part of it is either
            continue
        for first, last, length in intervals(lcp[lo:b].tolist(), min_len):
            if _diverse(mine[first : last + 1]):
                yield lo + first, lo + last, length


def _diverse(left: np.ndarray) -> bool:
    return bool((left != left[0]).any() or left[0] == NO_LEFT or (left == NO_LEFT).any())
