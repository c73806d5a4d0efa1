"""Jaccard links within one small group of sets, by a radix trie."""

from __future__ import annotations

import numpy as np


class Node:
    """A run of n-grams that all sets below share."""

    __slots__ = ("run", "ends", "below", "members", "least", "most", "depth", "joined")

    def __init__(self, run, depth, members, sizes, ends):
        self.run, self.depth, self.members, self.ends = run, depth, members, ends
        self.least, self.most = min(sizes[m] for m in members), max(sizes[m] for m in members)
        self.below: list[Node] = []
        self.joined = False  # whether all members are known to be connected


def build(sets: list[np.ndarray], sizes: list[int]) -> Node:
    """The trie of sets given as sorted arrays of ranks; ``sizes`` counts also
    the n-grams that no other set of the group has (they are not in it)."""
    order = sorted(range(len(sets)), key=lambda m: sets[m].astype(">u4").tobytes())

    def node(members: list[int], depth: int) -> Node:
        """members: in order, with equal runs up to ``depth``."""
        first, last = sets[members[0]], sets[members[-1]]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        return Node(first[depth:end], end, members, sizes, [m for m in members if len(sets[m]) == end])

    root = node(order, 0)
    todo = [root]
    while todo:
        at = todo.pop()
        groups: dict[int, list[int]] = {}
        for m in at.members:
            if len(sets[m]) > at.depth:
                groups.setdefault(int(sets[m][at.depth]), []).append(m)
        at.below = [node(g, at.depth) for g in groups.values()]
        todo += at.below
    return root


def find(parent: list[int], x: int) -> int:
    """The root of x, with its path halved."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_buckets(grams: list[np.ndarray], buckets: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """``linked`` for each bucket of a group, where ``buckets`` has the
    buckets of each set: what one bucket has connected the next ones skip."""
    members: dict[int, list[int]] = {}
    for x, own in enumerate(buckets):
        for b in own:
            members.setdefault(b, []).append(x)
    parent, pairs = list(range(len(grams))), []
    for b in sorted(members, key=lambda b: (-len(members[b]), b)):
        m = members[b]
        roots = [find(parent, x) for x in m]
        if len(set(roots)) > 1:
            for i, j in linked([grams[x] for x in m], [False] * len(m), percent, roots):
                pairs.append((m[i], m[j]))
                parent[find(parent, m[j])] = find(parent, m[i])
    return pairs


def linked(grams: list[np.ndarray], rights: list[bool], percent: int, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect the same sets as all links do. If some
    sets are on the right side and some are not, only links between the sides
    count; else links between any two. Sets with equal ``roots`` are
    connected already."""
    values, ranks = np.unique(np.concatenate(grams), return_inverse=True)
    counts = np.bincount(ranks, minlength=len(values))
    # common first; those of one set only are left out
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.arange(len(values))
    n_shared = int((counts > 1).sum())
    cuts = np.cumsum([0] + [len(g) for g in grams])
    sets = [np.sort((p := place[ranks[a:b]])[p < n_shared]) for a, b in zip(cuts, cuts[1:])]
    sizes = [len(g) for g in grams]
    two_sided = any(rights) and not all(rights)
    probes = [i for i in range(len(sets)) if rights[i]] if two_sided else range(len(sets))
    stored = [i for i in range(len(sets)) if not rights[i]] if two_sided else list(range(len(sets)))
    root = build([sets[i] for i in stored], [sizes[i] for i in stored])
    first = {r: i for i, r in reversed(list(enumerate(roots or range(len(sets)))))}
    parent = [first[r] for r in (roots or range(len(sets)))]

    def apart(at: Node, x: int) -> bool:
        """Whether a member is not connected with x. A member found so moves
        to the front, where the next set meets it first."""
        r, ms = find(parent, x), at.members
        for i in range(1 if at.joined else len(ms)):
            if find(parent, stored[ms[i]]) != r:
                ms[0], ms[i] = ms[i], ms[0]
                return True
        at.joined = True
        return False

    pairs = []
    mark = np.zeros(n_shared, dtype=bool)
    for x in probes:
        own, size = sets[x], sizes[x]
        mark[own] = True
        todo = [(root, 0)]
        while todo:
            at, overlap = todo.pop()
            if 100 * min(size, at.most) < percent * max(size, at.least):
                continue
            if not apart(at, x):
                continue
            rest = len(own)
            if len(at.run):
                overlap += int(np.count_nonzero(mark[at.run]))
                rest -= int(np.searchsorted(own, at.run[-1], side="right"))
            need = -(-percent * (size + at.least) // (100 + percent))
            if overlap + min(rest, at.most - at.depth) < need:
                continue
            for m in at.ends:
                y = stored[m]
                if 100 * overlap >= percent * (size + sizes[y] - overlap) and find(parent, x) != find(parent, y):
                    parent[find(parent, y)] = find(parent, x)
                    pairs.append((x, y))
            todo += [(b, overlap) for b in at.below]
        mark[own] = False
    return pairs
