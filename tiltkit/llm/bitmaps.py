"""Parity bitmaps of n-gram sets, which tell most unlike sets of a bucket apart.

Every n-gram of a set turns over one bit of its bitmap. What two sets share
cancels out, so their bitmaps differ in no more bits than the sets in n-grams:
sets whose bitmaps differ in more bits than a link allows do not link."""

from __future__ import annotations

import numpy as np

LEAST_BITS = 64


def bitmap(grams: np.ndarray) -> bytes:
    """The bitmap of a set of hashes: a power of two of bits, one per n-gram
    at least. Its halves, one turned over by the other, are that of half the
    bits, so bitmaps of unlike sizes can be compared."""
    bits = max(LEAST_BITS, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parts(sizes: np.ndarray, maps: list[bytes], roots: np.ndarray, percent: int) -> np.ndarray:
    """Per set of a bucket, the position of a set that names its part. Sets of
    unlike parts do not link, or have equal ``roots``, so are connected already.
    A set is compared with those that no part has yet, so a part of copies that
    differ a little takes few comparisons."""
    levels = np.array([len(m) for m in maps])
    at, tables = {}, {}  # by bitmap size: rows of the sets, and their bitmaps folded to that size
    folded = [np.frombuffer(m, dtype=np.uint64) for m in maps]
    for level in sorted({*levels.tolist()}, reverse=True):
        of = np.flatnonzero(levels >= level)
        for i in of:
            while folded[i].nbytes > level:
                half = len(folded[i]) // 2
                folded[i] = folded[i][:half] ^ folded[i][half:]
        at[level] = np.full(len(maps), -1)
        at[level][of] = np.arange(len(of))
        tables[level] = np.stack([folded[i] for i in of])

    def near(x: int, others: np.ndarray) -> np.ndarray:
        """Whether each of the others may link with x."""
        both = sizes[others] + sizes[x]
        may = roots[others] != roots[x]
        may &= 100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])
        most = both - 2 * -(-percent * both // (100 + percent))
        common = np.minimum(levels[others], levels[x])
        for level in {*common[may].tolist()}:
            i = np.flatnonzero(may & (common == level))
            table, row = tables[level], at[level]
            may[i] = np.bitwise_count(table[row[others[i]]] ^ table[row[x]]).sum(axis=1) <= most[i]
        return may

    names, counts = np.unique(roots, return_counts=True)
    # the most common root comes last; when only one root is left, no link is
    part, left = np.arange(len(maps)), np.argsort(roots == names[counts.argmax()], kind="stable")
    while (roots[left] != roots[left[-1:]]).any():
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            may = near(todo.pop(), left)
            found, left = left[may], left[~may]
            part[found] = first
            todo += found.tolist()
    return part
