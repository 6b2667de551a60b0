"""BK-trees over 64-bit fingerprints: children are keyed by Hamming distance to the parent."""

from __future__ import annotations

import numpy as np


def hamming(values: np.ndarray, other: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ other)


class Node:
    """``rows`` are the positions of the node's own value, which is first, and of all values below."""

    __slots__ = ("children", "rows")

    def __init__(self, rows: np.ndarray):
        self.rows, self.children = rows, {}


class BKTree:
    """A tree over distinct values: one in each node, under the child of its distance to the node's.

    ``visits`` counts the nodes that queries reached and ``followed`` the edges on their ways.
    """

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, dtype=np.uint64)
        self.visits = self.followed = 0
        self.root = Node(np.arange(len(self.values)))
        stack = [self.root]
        while stack:
            node = stack.pop()
            rest = node.rows[1:]
            if len(rest) == 1:
                node.children = {int(hamming(self.values[rest[0]], self.values[node.rows[0]])): Node(rest)}
            elif len(rest):
                away = hamming(self.values[rest], self.values[node.rows[0]])
                order = np.argsort(away, kind="stable")
                away, rest = away[order], rest[order]
                firsts = np.flatnonzero(np.diff(away, prepend=255))
                node.children = {int(away[a]): Node(part) for a, part in zip(firsts.tolist(), np.split(rest, firsts[1:]), strict=True)}
                stack += [c for c in node.children.values() if len(c.rows) > 1]

    def search(self, query: int, radius: int) -> list[int]:
        """Positions of the values within ``radius``; only edges within the radius are followed."""
        query, found, stack = np.uint64(query), [], [self.root] if len(self.values) else []
        while stack:
            node = stack.pop()
            away = int(hamming(self.values[node.rows[0]], query))
            if away <= radius:
                found.append(int(node.rows[0]))
            stack += [c for d, c in node.children.items() if abs(d - away) <= radius]
        return sorted(found)

    def components(self, radius: int, queries: np.ndarray | None = None) -> np.ndarray:
        """For each value the smallest position that links of at most ``radius`` reach.

        The queries, all values by default, walk the tree together as one array; with fewer, only
        their links count. A subtree whose values are already one component only takes queries
        from outside that component, so a tight cluster costs about its size times the tree's
        depth and not its square.
        """
        values, parent = self.values, np.arange(len(self.values))

        def roots(rows: np.ndarray) -> np.ndarray:
            up = parent[rows]
            while True:
                higher = parent[up]
                if np.array_equal(higher, up):
                    parent[rows] = up
                    return up
                up = higher

        stack = [(self.root, self.root.rows if queries is None else queries)] if len(values) else []
        while stack:
            node, near = stack.pop()
            below = roots(node.rows)
            if (below == below[0]).all():
                near = near[roots(near) != below[0]]
            if not len(near):
                continue
            away = hamming(values[near], values[node.rows[0]]).astype(np.int16)
            self.visits += len(near)
            close = near[away <= radius]
            if len(close):
                tops = np.unique(roots(np.append(close, node.rows[0])))
                parent[tops] = tops[0]
            for d, child in node.children.items():
                on = near[np.abs(away - d) <= radius]
                if len(on):
                    self.followed += len(on)
                    stack.append((child, on))
        return roots(np.arange(len(values)))
