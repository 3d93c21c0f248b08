"""A tree of clustering features (count, linear sum, sum of squares), filled in batches of rows.

A node has at most ``branching`` entries.  A batch goes down from the root, each row to the
child whose centre is nearest, until it meets the sub-clusters of a leaf; there
the nearest one takes it if its radius stays within the threshold, else it starts
a sub-cluster.  A node with too many entries splits about its two farthest ones,
up to the root, so the depth grows with the logarithm of the sub-clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BRANCHING = 50


class Node:
    """Entries as arrays; ``children`` is None in a leaf."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, children: list[Node] | None):
        self.n, self.sums, self.squares, self.children = n, sums, squares, children

    def centres(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def total(self) -> tuple[float, np.ndarray, float]:
        return float(self.n.sum()), self.sums.sum(axis=0), float(self.squares.sum())

    def part(self, rows: np.ndarray) -> Node:
        children = None if self.children is None else [self.children[k] for k in np.flatnonzero(rows)]
        return Node(self.n[rows], self.sums[rows], self.squares[rows], children)

    def split(self, most: int) -> list[Node]:
        """This node, or parts of at most ``most`` entries, each about one of two farthest entries."""
        if len(self.n) <= most:
            return [self]
        c = self.centres()
        far = _far(c, c)
        a, b = np.unravel_index(int(far.argmax()), far.shape)
        near_a = far[a] <= far[b]
        if near_a.all():  # all centres are equal
            near_a = np.arange(len(self.n)) < len(self.n) // 2
        return [x for rows in (near_a, ~near_a) for x in self.part(rows).split(most)]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _parent(children: list[Node]) -> Node:
    totals = [c.total() for c in children]
    return Node(np.array([t[0] for t in totals]), np.stack([t[1] for t in totals]), np.array([t[2] for t in totals]), children)


class Tree:
    def __init__(self, threshold: float, branching: int = BRANCHING):
        self.threshold, self.branching, self.root, self.leaves = threshold, branching, None, 0

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """Rows that are clustering features themselves; a point x is (1, x, x.x)."""
        if not len(n):
            return
        if self.root is None:
            self.root = Node(n[:0], sums[:0], squares[:0], None)
        tops = self._into(self.root, n, sums, squares)
        while len(tops) > 1:
            tops = _parent(tops).split(self.branching)
        self.root = tops[0]

    def _into(self, node: Node, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> list[Node]:
        """The nodes that stand for ``node`` afterwards."""
        if node.children is None:
            return self._into_leaf(node, n, sums, squares)
        near = _far(sums / n[:, None], node.centres()).argmin(axis=1)
        children = []
        for k, child in enumerate(node.children):
            own = np.flatnonzero(near == k)
            children += self._into(child, n[own], sums[own], squares[own]) if len(own) else [child]
        return _parent(children).split(self.branching)

    def _into_leaf(self, leaf: Node, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> list[Node]:
        while len(n):
            left = np.zeros(len(n), bool)
            if len(leaf.n):
                far = _far(sums / n[:, None], leaf.centres())
                near, least = far.argmin(axis=1), far.min(axis=1)
                for k in np.unique(near).tolist():
                    own = np.flatnonzero(near == k)
                    own = own[np.argsort(least[own], kind="stable")]
                    m, s, q = leaf.n[k] + np.cumsum(n[own]), leaf.sums[k] + np.cumsum(sums[own], axis=0), leaf.squares[k] + np.cumsum(squares[own])
                    wide = q / m - ((s / m[:, None]) ** 2).sum(axis=1) > self.threshold**2
                    taken = int(wide.argmax()) if wide.any() else len(own)
                    if taken:
                        leaf.n[k], leaf.sums[k], leaf.squares[k] = m[taken - 1], s[taken - 1], q[taken - 1]
                    left[own[taken:]] = True
            else:
                left[:] = True
            first = np.flatnonzero(left)[:1]
            leaf = Node(np.append(leaf.n, n[first]), np.concatenate([leaf.sums, sums[first]]), np.append(leaf.squares, squares[first]), None)
            self.leaves += len(first)
            left[first] = False
            n, sums, squares = n[left], sums[left], squares[left]
            if len(leaf.n) > self.branching:
                parts = leaf.split(self.branching)
                if not len(n):
                    return parts
                return self._into(_parent(parts), n, sums, squares) if len(parts) <= self.branching else parts
        return [leaf]

    def depth(self) -> int:
        node, levels = self.root, 0
        while node is not None:
            node, levels = (node.children[0] if node.children else None), levels + 1
        return levels

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, sums, squares) of all sub-clusters."""
        todo, found = [self.root] if self.root is not None else [], []
        while todo:
            node = todo.pop()
            if node.children is None:
                found.append(node)
            else:
                todo += node.children[::-1]
        if not found:
            return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
        return np.concatenate([x.n for x in found]), np.concatenate([x.sums for x in found]), np.concatenate([x.squares for x in found])

    def shrunk(self, most: int) -> Tree:
        """The same under growing thresholds, until at most ``most`` sub-clusters are left."""
        now = self
        while now.leaves > most:
            wider = Tree(now.threshold * 1.5, now.branching)
            wider.add(*now.entries())
            now = wider
        return now

    def table(self) -> pa.RecordBatch:
        n, sums, squares = self.entries()
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(sums), pa.list_(pa.float64())), pa.array(squares)], names=["n", "sums", "squares"])
