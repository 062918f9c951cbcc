"""Polygons as leaves of an adaptive tree of cells, and what is wrong with their rings; numpy for one zone at a time.

A cell of level l is one of 4^l x 4^l squares over the extent of all zones. A zone starts in the (at most four) cells of the
finest level that are as wide as the zone, and a cell with more than ``MOST_EDGES`` edges is cut into 4 x 4 until ``DEEPEST``.
A leaf keeps only the edges that meet it, and a flag.

Why that is enough: whether a point p is inside is the parity of the edges that its ray to the right crosses. An edge that
doesn't meet the cell is crossed by the rays of the cell's points only if it lies to the right of them, and then it is
crossed if just one of its ends is above p. Over all such edges the ends cancel in pairs, but for those they share with an
edge that is kept. So kept edges count their crossings and their ends that lie to the right of the cell and above p, and
what remains is one parity for the whole cell: the flag. No coordinate is ever computed or cut off, so the answers are
those of the whole polygon, bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

MOST_EDGES, DEEPEST, FAN = 16, 10, 4
#: Cells reach this share of the extent beyond their sides.
MARGIN = 2.0**-30


@dataclass(frozen=True)
class Grid:
    """The square that level 0 is; its width is a power of two, so that places in it are exact."""

    x: float
    y: float
    width: float

    @classmethod
    def over(cls, low_x: float, high_x: float, low_y: float, high_y: float) -> Grid:
        extent = max(high_x - low_x, high_y - low_y, 1e-300)
        return cls(low_x, low_y, 2.0 ** np.ceil(np.log2(extent * (1 + 1e-9))))

    @property
    def margin(self) -> float:
        return self.width * MARGIN

    def side(self, level: int) -> float:
        return self.width / FAN**level

    def box(self, level: int, cx: int, cy: int) -> tuple[float, float, float, float]:
        side = self.side(level)
        return self.x + cx * side - self.margin, self.y + cy * side - self.margin, self.x + (cx + 1) * side + self.margin, self.y + (cy + 1) * side + self.margin


@dataclass(frozen=True)
class Leaf:
    level: int
    cx: int
    cy: int
    flag: bool
    right: float
    edges: np.ndarray


def edges_of(rings: Sequence[tuple[Sequence[float], Sequence[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(x1, y1, x2, y2) of all edges of closed rings, without those of length 0, and (ring, place, edges of the ring)."""
    edges, names = [np.empty((0, 4))], [np.empty((0, 3), np.int64)]
    for k, (xs, ys) in enumerate(rings):
        p = np.stack((np.asarray(xs, float), np.asarray(ys, float)), 1)
        e = np.hstack((p, np.roll(p, -1, 0)))
        e = e[(e[:, :2] != e[:, 2:]).any(1)]
        edges.append(e)
        names.append(np.stack((np.full(len(e), k), np.arange(len(e)), np.full(len(e), len(e))), 1))
    return np.concatenate(edges), np.concatenate(names)


def meets(e: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which edges may have a point in a box: their boxes meet, and the box's corners don't all lie on one side."""
    x1, y1, x2, y2 = e.T
    a, b, c, d = box
    near = (np.minimum(x1, x2) <= c) & (np.maximum(x1, x2) >= a) & (np.minimum(y1, y2) <= d) & (np.maximum(y1, y2) >= b)
    dx, dy = x2 - x1, y2 - y1
    sides = np.stack([dx * (y - y1) - dy * (x - x1) for x, y in ((a, b), (c, b), (a, d), (c, d))])
    slack = 1e-12 * (np.abs(dx) + np.abs(dy)) * max(c - a, d - b)
    return near & (sides.min(0) <= slack) & (sides.max(0) >= -slack)


def parity(e: np.ndarray, right: float, px: float, py: float) -> bool:
    """What the edges of a cell that ends at ``right`` contribute to a point of it."""
    x1, y1, x2, y2 = e.T
    up1, up2 = y1 > py, y2 > py
    with np.errstate(all="ignore"):
        hit = (up1 != up2) & (px < (x2 - x1) * (py - y1) / np.where(y1 == y2, 1.0, y2 - y1) + x1)
    return bool((hit.sum() + ((x1 > right) & up1).sum() + ((x2 > right) & up2).sum()) % 2)


def leaves(edges: np.ndarray, grid: Grid, with_places: bool = False) -> Iterator[Leaf] | Iterator[tuple[Leaf, np.ndarray]]:
    """The leaves of a zone; with ``with_places`` also which edges each has."""
    if not len(edges):
        return
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    extent = max(xs.max() - xs.min(), ys.max() - ys.min())
    level = 0
    while level < DEEPEST and grid.side(level + 1) >= extent:
        level += 1
    side, everything = grid.side(level), np.arange(len(edges))
    reach = lambda v, at: range(int((v.min() - grid.margin - at) // side), int((v.max() + grid.margin - at) // side) + 1)
    work = [(level, cx, cy, everything, False, np.inf) for cx in reach(xs, grid.x) for cy in reach(ys, grid.y)]
    while work:
        level, cx, cy, some, flag, right = work.pop()
        box = grid.box(level, cx, cy)
        mid = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        kept = some[meets(edges[some], box)]
        flag = flag ^ parity(edges[some], right, *mid) ^ parity(edges[kept], box[2], *mid)
        if len(kept) > MOST_EDGES and level < DEEPEST:
            work += [(level + 1, FAN * cx + i, FAN * cy + j, kept, flag, box[2]) for i in range(FAN) for j in range(FAN)]
        elif len(kept) or flag:
            leaf = Leaf(level, cx, cy, flag, box[2], edges[kept])
            yield (leaf, kept) if with_places else leaf


# Rings


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: on which side of a-b each c lies; 0 too where rounding can't tell."""
    left, right = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    d = left - right
    return np.where(np.abs(d) <= 4e-16 * (np.abs(left) + np.abs(right)), 0, np.sign(d)).astype(int)


def _between(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether c, on the line a-b, lies strictly between them."""
    along = np.abs(b - a).argmax(1)
    pick = lambda v: v[np.arange(len(v)), along]
    return (np.minimum(pick(a), pick(b)) < pick(c)) & (pick(c) < np.maximum(pick(a), pick(b)))


#: Pairs of edges compared at once.
PAIRS = 200_000


def ring_faults(rings: Sequence[tuple[Sequence[float], Sequence[float]]], grid: Grid) -> list[tuple[str, float, float]]:
    """(fault, x, y) of a zone: CROSSING edges of any two rings, OVERLAPPING_EDGES, and a ring's SELF_TOUCH, found among the edges of each leaf; EMPTY_RING for one without area."""
    edges, names = edges_of(rings)
    found = {("EMPTY_RING", float(xs[0]) if len(xs) else 0.0, float(ys[0]) if len(ys) else 0.0) for k, (xs, ys) in enumerate(rings) if (names[:, 0] == k).sum() < 3}
    for leaf, places in leaves(edges, grid, True):
        n = len(places)
        rows = max(1, PAIRS // max(n, 1))
        for begin in range(0, n, rows):
            i, j = np.nonzero(np.arange(begin, min(begin + rows, n))[:, None] < np.arange(n)[None])
            i, j = places[i + begin], places[j]
            p1, p2, q1, q2 = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
            d1, d2, d3, d4 = _side(q1, q2, p1), _side(q1, q2, p2), _side(p1, p2, q1), _side(p1, p2, q2)
            crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
            on = [(d1 == 0) & _between(q1, q2, p1), (d2 == 0) & _between(q1, q2, p2), (d3 == 0) & _between(p1, p2, q1), (d4 == 0) & _between(p1, p2, q2)]
            flat = (d1 == 0) & (d2 == 0) & (d3 == 0) & (d4 == 0)
            same_ends = ((p1 == q1).all(1) & (p2 == q2).all(1)) | ((p1 == q2).all(1) & (p2 == q1).all(1))
            overlapping = flat & (np.logical_or.reduce(on) | same_ends)
            one_ring = names[i, 0] == names[j, 0]
            apart = (names[i, 1] - names[j, 1]) % names[i, 2]
            next_to = one_ring & ((apart == 1) | (apart == names[i, 2] - 1))
            meet = (p1 == q1).all(1) | (p1 == q2).all(1) | (p2 == q1).all(1) | (p2 == q2).all(1)
            touching = one_ring & ~overlapping & (np.logical_or.reduce(on) | (meet & ~next_to))
            for name, which in (("CROSSING", crossing), ("OVERLAPPING_EDGES", overlapping), ("SELF_TOUCH", touching & ~crossing)):
                found |= {(name, float(x), float(y)) for x, y in q1[which]}
    return sorted(found)


def inner_point(edges: np.ndarray) -> tuple[float, float] | None:
    """A point well inside: the middle of the widest stretch inside, on the lines halfway between neighbouring heights of vertices near the median."""
    heights = np.unique(edges[:, [1, 3]])
    if len(heights) < 2:
        return None
    best = None
    gaps = np.argsort(-np.diff(heights), kind="stable")[:8]
    for k in gaps:
        y = (heights[k] + heights[k + 1]) / 2
        x1, y1, x2, y2 = edges[(edges[:, 1] > y) != (edges[:, 3] > y)].T
        xs = np.sort((x2 - x1) * (y - y1) / (y2 - y1) + x1)
        for a, b in zip(xs[::2], xs[1::2]):
            size = min(b - a, heights[k + 1] - heights[k])
            if best is None or size > best[0]:
                best = size, float((a + b) / 2), float(y)
    return best and best[1:]
