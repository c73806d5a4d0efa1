"""A HAT-trie that counts phrases of word ids.

The root has a subtree per first word. A subtree is a hash container of the
words after it until it holds more than ``burst`` phrases; then it bursts into
one container per second word. ``spill`` gives up the largest subtrees whole,
each as a sorted run, so memory is bounded while frequent small ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bits of a word id in a packed phrase; 0 stands for no word.
ID_BITS = 21
MOST_IDS = (1 << ID_BITS) - 2
_SECOND = 2 * ID_BITS
_AFTER = (1 << _SECOND) - 1
_ONE = (1 << ID_BITS) - 1


def packed_rest(ids, starts, width: int):
    """The words after the first of the phrases at ``starts``, as one number
    each: 21 bits per word, ids plus one, the second word highest."""
    rest = (ids[starts + 1] + 1) << _SECOND if width > 1 else starts * 0
    if width > 2:
        rest = rest | ((ids[starts + 2] + 1) << ID_BITS)
    return rest | (ids[starts + 3] + 1) if width > 3 else rest


class Burst(dict):
    """A burst subtree: a container per second word."""


class HatTrie:
    def __init__(self, burst: int = 4_096):
        self.burst = burst
        self.ends: dict[int, int] = {}  # counts of single words
        self.below: dict[int, dict] = {}
        self.sizes: dict[int, int] = {}  # phrases in a subtree
        self.size = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """Counts of phrases with one first word."""
        box = self.below.get(first)
        if box is None:
            box = self.below[first] = {}
        grew = 0
        if type(box) is Burst:
            for rest, n in zip(rests, counts):
                inner = box.setdefault(rest >> _SECOND, {})
                low = rest & _AFTER
                grew += low not in inner
                inner[low] = inner.get(low, 0) + n
        else:
            grew = -len(box)
            get = box.get
            for rest, n in zip(rests, counts):
                box[rest] = get(rest, 0) + n
            grew += len(box)
            if len(box) > self.burst:
                parts = self.below[first] = Burst()
                for rest, n in box.items():
                    parts.setdefault(rest >> _SECOND, {})[rest & _AFTER] = n
        self.sizes[first] = self.sizes.get(first, 0) + grew
        self.size += grew

    def add_words(self, ids: list[int], counts: list[int]) -> None:
        ends, get = self.ends, self.ends.get
        for i, n in zip(ids, counts):
            ends[i] = get(i, 0) + n
        self.size = sum(self.sizes.values()) + len(ends)

    def spill_words(self) -> tuple[list[int], list[int]]:
        """Gives up the single words: ids and counts."""
        ends, self.ends = self.ends, {}
        self.size -= len(ends)
        return list(ends), list(ends.values())

    def spill(self, keep: int = 0) -> Iterator[tuple[int, list[int], list[int]]]:
        """Gives up subtrees, the largest first, until ``keep`` phrases are
        left: (first word, the words after it as packed numbers, counts)."""
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.size <= keep:
                return
            box = self.below.pop(first)
            self.size -= self.sizes.pop(first)
            if type(box) is Burst:
                box = {s << _SECOND | low: n for s, inner in box.items() for low, n in inner.items()}
            yield first, list(box), list(box.values())


def word_at(rests, place: int):
    """Ids of the second, third or fourth words (``place`` 1 to 3) of packed
    phrases (a numpy array), -1 where there is none."""
    return (rests >> (3 - place) * ID_BITS & _ONE) - 1
