"""A z-fast trie over sequences given by the hashes of their prefixes.

A sequence of n steps is its path: n + 1 prefix hashes, the empty prefix's
first. Nodes are compacted: a node covers the depths in (start, end] of one
path. It is stored in a table under its handle, the path's hash at the depth of
(start, end] that the largest power of two divides, so the node where a path
leaves the trie is found by probing the table at O(log n) depths only.
"""

from __future__ import annotations

from collections.abc import Iterator


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides; a < b."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Node:
    __slots__ = ("start", "end", "path", "weights", "below", "n", "least", "label")

    def __init__(self, start: int, end: int, path: list, weights: list):
        self.start, self.end, self.path, self.weights = start, end, path, weights
        self.below: dict = {}
        self.n, self.least, self.label = 0, None, None  # of the sequences that end here


class Total:
    """Sums over the members or the subtree of a node."""

    __slots__ = ("n", "least", "leaves", "copies", "once")

    def __init__(self, n: int, least, leaves: int, copies: int, once: int):
        self.n, self.least, self.leaves, self.copies, self.once = n, least, leaves, copies, once


class ZFastTrie:
    def __init__(self, empty_prefix):
        self.root = Node(-1, 0, [empty_prefix], [0])
        self.handles: dict = {}

    def deepest(self, path: list, at: Node) -> tuple[Node, Node | None]:
        """Fat binary search below ``at``, a node whose end is on the path: the
        deepest such node, and the node below it that the path leaves inside
        its edge, if any."""
        low, high = at.end, len(path) - 1
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get(path[f])
            if found is not None and found.end < len(path) and path[found.end] == found.path[found.end]:
                at, low = found, found.end
            else:  # no such node, or the path leaves it inside its edge
                high = f - 1
        return at, at.below.get(path[at.end + 1]) if at.end + 1 < len(path) else None

    def _put(self, node: Node) -> None:
        self.handles[node.path[two_fattest(node.start, node.end)]] = node

    def insert(self, batch: list[tuple]) -> None:
        """Adds (path, weights of its steps with 0 first, count, least, label).
        All are located in the trie as it stands; each is then added below the
        node found, where an earlier one of the batch may have grown it."""
        located = [self.deepest(item[0], self.root)[0] for item in batch]
        for (path, weights, n, least, label), at in zip(batch, located):
            node = self._end_of(path, weights, at)
            node.n += n
            node.least = least if node.least is None else min(node.least, least)
            node.label = label

    def _end_of(self, path: list, weights: list, at: Node) -> Node:
        """The node that ends where the path does, made if need be."""
        at, edge = self.deepest(path, at)
        if edge is not None:
            # the depth at which the path leaves the edge: hashes agree up to it
            low, high = at.end + 1, min(edge.end, len(path) - 1)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if path[mid] == edge.path[mid] else (low, mid - 1)
            at = self._split(at, edge, low)
        if at.end < len(path) - 1:
            leaf = Node(at.end, len(path) - 1, path, weights)
            at.below[path[at.end + 1]] = leaf
            self._put(leaf)
            at = leaf
        return at

    def _split(self, parent: Node, edge: Node, depth: int) -> Node:
        """A new node that ends at ``depth`` inside the edge."""
        node = Node(parent.end, depth, edge.path, edge.weights)
        parent.below[edge.path[parent.end + 1]] = node
        node.below[edge.path[depth + 1]] = edge
        edge.start = depth
        # the edge's old handle is the new node's if it lies above the cut, else the edge keeps it
        self._put(node)
        self._put(edge)
        return node

    def expanded(self) -> Iterator[tuple]:
        """(path, depth, children, label, total, the parent's total) of every
        depth of every edge, the root's first. ``copies`` sums weight times
        members over the subtree, ``once`` each weight once."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.below.values()
        tops: dict[int, Total] = {}  # of the first depth of each edge
        steps: dict[int, list[Total]] = {}
        for node in reversed(order):
            subs = [tops.pop(id(b)) for b in node.below.values()]
            leasts = [x for x in (node.least, *(s.least for s in subs)) if x is not None]
            now = Total(node.n + sum(s.n for s in subs), min(leasts) if leasts else None, sum(s.leaves for s in subs) if subs else 1,
                        sum(s.copies for s in subs), sum(s.once for s in subs))
            levels = []
            for depth in range(node.end, node.start, -1):
                w = node.weights[depth]
                now = Total(now.n, now.least, now.leaves, now.copies + w * now.n, now.once + w)
                levels.append(now)
            tops[id(node)] = now
            steps[id(node)] = levels[::-1]
        above = {id(self.root): None}
        for node in order:
            up = above.pop(id(node))
            levels = steps.pop(id(node))
            for depth, total in zip(range(node.start + 1, node.end + 1), levels):
                last = depth == node.end
                yield node.path, depth, len(node.below) if last else 1, node.label if last else None, total, up
                up = total
            for b in node.below.values():
                above[id(b)] = up
