"""A multiway hyperplane tree over vectors: every row belongs to its nearest split point, and every split point knows the range
of distances to each sibling's subtree. A query on inner products is a window of scores; with the norms of a subtree it is an
annulus of distances, and a subtree whose ranges do not meet it falls away."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

EXACT = float(1 << 53)
SLACK = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows; those beyond what doubles hold exactly in exact integers (dtype object)."""
    width = min(a.shape[1], b.shape[1])  # the shorter vectors end in zeros
    a, b = a[:, :width], b[:, :width]
    if not len(a) or not len(b) or width == 0 or width * np.abs(a).max() * np.abs(b).max() < EXACT:
        return a @ b.T
    exact = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape), np.array([[int(v) for v in row] for row in b], object).reshape(b.shape)
    return exact[0] @ exact[1].T


def norms(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows by rows, from above zero on."""
    return np.sqrt(np.maximum(norms(a)[:, None] + norms(b)[None] - 2 * products(a, b).astype(float), 0))


@dataclass
class Node:
    points: np.ndarray
    children: list  # a Node, or the number of a leaf
    number: int
    ranges: np.ndarray = field(default=None)  # [point, child, low / high]: distances from a point to a child's rows
    sizes: np.ndarray = field(default=None)  # [child, low / high]: squared lengths of a child's rows


class Gnat:
    """Fitted on a sample; `measure` then takes in the ranges of the rows that are really there."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, fanout: int = 8, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.leaves, self.nodes, self.fanout = 0, [], fanout
        self.root = self._build(sample, max(1, leaf_rows))

    def _build(self, rows: np.ndarray, leaf_rows: int):
        wanted = min(self.fanout, -(-len(rows) // leaf_rows))
        points = self._split_points(rows, wanted) if wanted > 1 else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(points, [], len(self.nodes))
        self.nodes.append(node)
        nearest = distances(rows, points).argmin(1)
        node.children = [self._build(rows[nearest == i], leaf_rows) for i in range(len(points))]
        count = len(points)
        node.ranges = np.tile([np.inf, -np.inf], (count, count, 1))
        node.sizes = np.tile([np.inf, -np.inf], (count, 1))
        return node

    def _split_points(self, rows: np.ndarray, wanted: int) -> np.ndarray:
        """Far-apart rows of a few times as many candidates, each the farthest from those taken before."""
        drawn = self.rng.choice(len(rows), min(len(rows), 3 * self.fanout), replace=False)
        candidates = np.unique(rows[drawn], axis=0)
        taken = [0]
        apart = distances(candidates, candidates[:1])[:, 0]
        while len(taken) < min(wanted, len(candidates)):
            best = int(apart.argmax())
            if apart[best] <= 0:
                break
            taken.append(best)
            apart = np.minimum(apart, distances(candidates, candidates[best:best + 1])[:, 0])
        return candidates[taken]

    def route(self, rows: np.ndarray, measure: bool = False) -> np.ndarray:
        """Leaf of each row; with `measure` the ranges grow to hold the rows."""
        found = np.zeros(len(rows), np.int64)
        sizes = norms(rows)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not isinstance(node, Node):
                found[at] = node
                continue
            if not len(at):
                continue
            apart = distances(rows[at], node.points)
            nearest = apart.argmin(1)
            for child, below in enumerate(node.children):
                mine = nearest == child
                if measure and mine.any():
                    inside = apart[mine]
                    node.ranges[:, child, 0] = np.minimum(node.ranges[:, child, 0], inside.min(0))
                    node.ranges[:, child, 1] = np.maximum(node.ranges[:, child, 1], inside.max(0))
                    own = sizes[at[mine]]
                    node.sizes[child] = min(node.sizes[child, 0], own.min()), max(node.sizes[child, 1], own.max())
                todo.append((below, at[mine]))
        return found

    def measures(self) -> list[tuple[int, int, int, float, float]]:
        """(node, point, child, low, high) of all ranges with rows; point -1 stands for the squared lengths."""
        out = []
        for node in self.nodes:
            for child in range(len(node.points)):
                if node.sizes[child, 0] <= node.sizes[child, 1]:
                    out.append((node.number, -1, child, *map(float, node.sizes[child])))
                    out += [(node.number, i, child, *map(float, node.ranges[i, child])) for i in range(len(node.points))]
        return out

    def take(self, measures) -> None:
        for number, point, child, low, high in measures:
            node = self.nodes[number]
            held = node.sizes[child] if point < 0 else node.ranges[point, child]
            held[:] = min(held[0], low), max(held[1], high)

    def survivors(self, queries: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        """For each leaf that may hold scores within a window of some query: (leaf, those queries, the best score that it may
        have with each). `lows` and `highs` have a row a query and a column a window; scores at both ends are inside."""
        own = norms(queries)
        far = np.full(len(queries), np.inf)
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)), far, far)]
        while todo:
            node, at, near, wide, best = todo.pop()
            if not isinstance(node, Node):
                yield node, at, best
                continue
            apart = distances(queries[at], node.points)
            for child, below in enumerate(node.children):
                low, high = node.ranges[:, child, 0], node.ranges[:, child, 1]
                if node.sizes[child, 0] > node.sizes[child, 1]:
                    continue  # no rows
                least = np.maximum(near, np.maximum(apart - high, low - apart).max(1) * (1 - SLACK) - SLACK)
                most = np.minimum(wide, (apart + high).min(1) * (1 + SLACK) + SLACK)
                top = (own[at] + node.sizes[child, 1] - np.maximum(least, 0) ** 2) / 2
                bottom = (own[at] + node.sizes[child, 0] - most ** 2) / 2
                margin = SLACK * (own[at] + node.sizes[child, 1]) + SLACK
                top, bottom = np.minimum(top + margin, best), bottom - margin
                kept = ((lows[at] <= top[:, None]) & (highs[at] >= bottom[:, None])).any(1)
                if kept.any():
                    todo.append((below, at[kept], least[kept], most[kept], top[kept]))
