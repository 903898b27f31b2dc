"""Points on a line and in the plane: bounds, KD and BKD trees, with what a search touches.

Trees are built over numpy arrays, one task's worth of points; a table of any
size is dealt into leaves by ``operators.points``. All edges are inclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Bytes of a coordinate and of a point's document in a leaf block.
COORDINATE_BYTES, DOC_BYTES = 4, 2


@dataclass(frozen=True)
class Region:
    min_x: float = -np.inf
    max_x: float = np.inf
    min_y: float = -np.inf
    max_y: float = np.inf

    def intersects(self, other: Region) -> bool:
        return self.min_x <= other.max_x and other.min_x <= self.max_x and self.min_y <= other.max_y and other.min_y <= self.max_y

    def contains(self, other: Region) -> bool:
        return self.min_x <= other.min_x and self.max_x >= other.max_x and self.min_y <= other.min_y and self.max_y >= other.max_y

    def has(self, points: np.ndarray) -> np.ndarray:
        """Which of the points (n, 2) lie inside."""
        low, high = np.array([self.min_x, self.min_y]), np.array([self.max_x, self.max_y])
        return ((points >= low) & (points <= high)).all(axis=1)

    def cut(self, dim: int, at: float, upper: bool) -> Region:
        """The half above or below a line."""
        side = ("min_" if upper else "max_") + "xy"[dim]
        return Region(**(self.__dict__ | {side: at}))

    @staticmethod
    def around(points: np.ndarray) -> Region:
        (a, c), (b, d) = points.min(axis=0), points.max(axis=0)
        return Region(float(a), float(b), float(c), float(d))


@dataclass
class Found:
    ids: list[int] = field(default_factory=list)
    visited: int = 0
    skipped: int = 0
    checked: int = 0
    inside: int = 0
    leaves: int = 0
    bytes: int = 0


def bound(values: np.ndarray, target: float, upper: bool = False) -> tuple[int, list[dict]]:
    """First place whose value is at least (``upper``: beyond) target, and the steps of the binary search."""
    lo, hi, steps = 0, len(values), []
    while lo < hi:
        mid = (lo + hi) // 2
        right = values[mid] <= target if upper else values[mid] < target
        steps.append({"lo": lo, "hi": hi, "mid": mid, "value": float(values[mid]), "right": bool(right)})
        lo, hi = (mid + 1, hi) if right else (lo, mid)
    return lo, steps


def point_range(values: np.ndarray, ids: np.ndarray, gte=None, gt=None, lte=None, lt=None) -> list[int]:
    """Ids, in order of value, of sorted values that meet all bounds; values that are null or NaN aren't there."""
    lo = max([0, *(bound(values, v)[0] for v in [gte] if v is not None), *(bound(values, v, True)[0] for v in [gt] if v is not None)])
    hi = min([len(values), *(bound(values, v, True)[0] for v in [lte] if v is not None), *(bound(values, v)[0] for v in [lt] if v is not None)])
    return ids[lo : max(lo, hi)].tolist()


class KdTree:
    """Points split at the median, by x and y in turn; a node is its middle point and the ranges on either side."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = np.asarray(points, float).reshape(-1, 2), np.asarray(ids)
        self.order = np.arange(len(self.points))
        todo = [(0, len(self.order), 0)]
        while todo:
            lo, hi, depth = todo.pop()
            if hi - lo > 1:
                part = self.order[lo:hi]
                self.order[lo:hi] = part[np.argsort(self.points[part, depth % 2], kind="stable")]
                mid = lo + (hi - lo) // 2
                todo += [(lo, mid, depth + 1), (mid + 1, hi, depth + 1)]

    def search(self, query: Region) -> Found:
        out, todo = Found(), [(0, len(self.order), 0, Region())]
        while todo:
            lo, hi, depth, region = todo.pop()
            if lo >= hi:
                continue
            if not query.intersects(region):
                out.skipped += 1
                continue
            mid, dim = lo + (hi - lo) // 2, depth % 2
            row = self.order[mid]
            out.visited += 1
            out.checked += 1
            if query.has(self.points[row : row + 1])[0]:
                out.ids.append(int(self.ids[row]))
            line = float(self.points[row, dim])
            todo += [(lo, mid, depth + 1, region.cut(dim, line, False)), (mid + 1, hi, depth + 1, region.cut(dim, line, True))]
        out.ids.sort()
        return out


@dataclass
class BkdNode:
    lo: int
    hi: int
    depth: int
    bounds: Region
    dim: int | None = None
    value: float | None = None
    children: tuple[int, int] | None = None
    offset: int = -1
    bytes: int = 0


class BkdTree:
    """Points in leaf blocks, split at the middle of the wider side; inner nodes hold tight bounds alone."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 4, dims: int = 2):
        self.points, self.ids, self.leaf = np.asarray(points, float).reshape(-1, 2), np.asarray(ids), leaf
        self.order, self.nodes, self.bytes = np.arange(len(self.points)), [], 0
        self.per_point = dims * COORDINATE_BYTES + DOC_BYTES
        if len(self.points):
            self._grow(0, len(self.points), 0)

    def _grow(self, lo: int, hi: int, depth: int) -> int:
        part = self.order[lo:hi]
        node = BkdNode(lo, hi, depth, Region.around(self.points[part]))
        number = len(self.nodes)
        self.nodes.append(node)
        if hi - lo <= self.leaf:
            node.offset, node.bytes = self.bytes, (hi - lo) * self.per_point
            self.bytes += node.bytes
            return number
        b = node.bounds
        node.dim = 0 if b.max_x - b.min_x >= b.max_y - b.min_y else 1
        self.order[lo:hi] = part[np.argsort(self.points[part, node.dim], kind="stable")]
        mid = lo + (hi - lo) // 2
        node.value = float(self.points[self.order[mid], node.dim])
        node.children = self._grow(lo, mid, depth + 1), self._grow(mid, hi, depth + 1)
        return number

    def leaves(self) -> list[BkdNode]:
        return [n for n in self.nodes if n.children is None]

    def _take(self, number: int, out: Found) -> None:
        todo = [self.nodes[number]]
        while todo:
            node = todo.pop()
            if node.children is None:
                out.leaves += 1
                out.bytes += node.bytes
                out.ids += self.ids[self.order[node.lo : node.hi]].tolist()
            else:
                todo += [self.nodes[k] for k in node.children]

    def search(self, query: Region) -> Found:
        """Subtrees apart from the query are skipped, subtrees inside it taken whole, other leaves checked point by point."""
        out, todo = Found(), [0] if self.nodes else []
        while todo:
            number = todo.pop()
            node = self.nodes[number]
            out.visited += 1
            if not query.intersects(node.bounds):
                out.skipped += 1
            elif query.contains(node.bounds):
                out.inside += 1
                self._take(number, out)
            elif node.children is None:
                rows = self.order[node.lo : node.hi]
                out.leaves += 1
                out.bytes += node.bytes
                out.checked += len(rows)
                out.ids += self.ids[rows[query.has(self.points[rows])]].tolist()
            else:
                todo += node.children
        out.ids.sort()
        return out

    def layout(self) -> dict:
        """Nodes and edges for drawing."""
        label = lambda n: f"leaf {n.hi - n.lo}pt" if n.children is None else f"{'xy'[n.dim]} < {n.value}"
        nodes = [{"id": k, "depth": n.depth, "leaf": n.children is None, "label": label(n), "count": n.hi - n.lo} for k, n in enumerate(self.nodes)]
        edges = [{"from": k, "to": c, "side": side} for k, n in enumerate(self.nodes) if n.children for c, side in zip(n.children, ("left", "right"), strict=True)]
        return {"nodes": nodes, "edges": edges}


def line_tree(values: np.ndarray, ids: np.ndarray, leaf: int = 4) -> BkdTree:
    """A BKD tree over one dimension; search it with ``Region(min_x, max_x)``."""
    return BkdTree(np.stack([np.asarray(values, float), np.zeros(len(values))], axis=1), ids, leaf)


def naive_search(points: np.ndarray, ids: np.ndarray, query: Region) -> list[int]:
    return sorted(np.asarray(ids)[query.has(np.asarray(points, float).reshape(-1, 2))].tolist())
