"""Voronoi cells of frames that one task can hold, in numpy.

Sites of many frames are taken together. The rings of all cells are flat arrays, corner after corner, so a cell
with many corners costs no other cell anything. A cell starts as the world clipped by the bisectors towards some
sites nearby. Then the nearest site of every corner is looked up in a tree over its frame: one that is closer than the
cell's own shows a bisector that is missing. Clipping and looking up repeat until no corner has one, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 8  # sites of a leaf of the tree
WINDOW = 6  # sites before and after its own, in the order of the tree, that clip a cell first


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


class Tree:
    """Halves the sites of every frame along the longer side of their box, down to LEAF; the first nodes are the frames."""

    def __init__(self, frames: np.ndarray, x: np.ndarray, y: np.ndarray):
        """``frames``: where each frame starts, and the number of sites."""
        self.order = np.arange(len(x))
        low, high = frames[:-1], frames[1:]
        levels, known = [], 0
        while len(low):
            ends = np.column_stack([low, high]).ravel()
            box = [
                f.reduceat(np.append(v[self.order], 0.0), ends)[::2]
                for v in (x, y) for f in (np.minimum, np.maximum)
            ]
            wide = high - low > LEAF
            kid = np.full(len(low), -1)
            known += len(low)
            kid[wide] = known + 2 * np.arange(wide.sum())
            levels.append([*box, low, high, kid])
            along = (box[1] - box[0] >= box[3] - box[2])[wide]
            low, high = low[wide], high[wide]
            n = high - low
            node = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            sites = self.order[at]
            self.order[at] = sites[np.lexsort((np.where(along[node], x[sites], y[sites]), node))]
            middle = (low + high) // 2
            low, high = np.column_stack([low, middle]).ravel(), np.column_stack([middle, high]).ravel()
        self.x0, self.x1, self.y0, self.y1, low, high, self.kid = map(np.concatenate, zip(*levels))
        leaf = self.kid < 0
        at = low[leaf][:, None] + np.arange(LEAF)
        inside = at < high[leaf][:, None]
        # the sites of a leaf as one row, and the row of a node
        self.sites = self.order[np.where(inside, at, 0)]
        self.x, self.y = np.where(inside, x[self.sites], np.inf), np.where(inside, y[self.sites], np.inf)
        self.row = np.cumsum(leaf) - 1

    def gap(self, node: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Squared distance from a place to the box of a node."""
        dx = np.maximum(np.maximum(self.x0[node] - px, px - self.x1[node]), 0.0)
        dy = np.maximum(np.maximum(self.y0[node] - py, py - self.y1[node]), 0.0)
        return dx * dx + dy * dy

    def closest(self, root: np.ndarray, px: np.ndarray, py: np.ndarray, within: np.ndarray) -> np.ndarray:
        """The site of the frame ``root`` closest to each place, or -1 where none is closer than the root of ``within``."""
        best, found = within.copy(), np.full(len(px), -1)

        def look(q: np.ndarray, leaf: np.ndarray) -> None:
            row = self.row[leaf]
            d2 = (self.x[row] - px[q, None]) ** 2 + (self.y[row] - py[q, None]) ** 2
            nearest = d2.argmin(axis=1)
            d2, sites = d2[np.arange(len(q)), nearest], self.sites[row, nearest]
            closer = d2 < best[q]
            q, d2, sites = q[closer], d2[closer], sites[closer]
            by = np.lexsort((sites, d2, q))
            by = by[_starts(q[by])]
            best[q[by]], found[q[by]] = d2[by], sites[by]

        # the leaf around a place bounds what else is looked at
        node = root.copy()
        while len(deeper := np.flatnonzero(self.kid[node] >= 0)):
            kid = self.kid[node[deeper]]
            x, y = px[deeper], py[deeper]
            node[deeper] = kid + (self.gap(kid + 1, x, y) < self.gap(kid, x, y))
        look(np.arange(len(px)), node)
        q, node = np.arange(len(px)), root
        while len(q):
            near = self.gap(node, px[q], py[q]) < best[q]
            q, node = q[near], node[near]
            kid = self.kid[node]
            leaf = kid < 0
            look(q[leaf], node[leaf])
            q, kid = q[~leaf], kid[~leaf]
            q, node = np.repeat(q, 2), np.column_stack([kid, kid + 1]).ravel()
        return found


@dataclass
class Rings:
    """Corners cell by cell; ``beyond`` is the site on the other side of the edge that starts there, -1 for the world's border."""

    cell: np.ndarray
    x: np.ndarray
    y: np.ndarray
    beyond: np.ndarray

    def where(self, some: np.ndarray) -> "Rings":
        return Rings(self.cell[some], self.x[some], self.y[some], self.beyond[some])

    def following(self) -> np.ndarray:
        """The corner after each one."""
        first = _starts(self.cell)
        after = np.arange(1, len(self.cell) + 1)
        after[np.append(first[1:], len(self.cell))[: len(first)] - 1] = first
        return after


def _joined(parts: list[Rings]) -> Rings:
    """All corners, by cell."""
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("cell", "x", "y", "beyond")]
    order = np.argsort(columns[0], kind="stable")
    return Rings(*[c[order] for c in columns])


def _clip(rings: Rings, other: np.ndarray, x: np.ndarray, y: np.ndarray) -> Rings:
    """What is closer to a cell's site than to the site ``other[cell]``."""
    cell, q = rings.cell, other[rings.cell]
    f = (rings.x - (x[cell] + x[q]) / 2) * (x[q] - x[cell]) + (rings.y - (y[cell] + y[q]) / 2) * (y[q] - y[cell])
    kept = f <= 0
    if kept.all():
        return rings
    after = rings.following()
    g = f[after]
    crossing = f * g < 0
    n = kept + crossing.astype(int)
    at = np.cumsum(n) - n
    new = Rings(*[np.empty(n.sum(), v.dtype) for v in (cell, rings.x, rings.y, rings.beyond)])
    new.cell[:] = np.repeat(cell, n)
    new.x[at[kept]], new.y[at[kept]] = rings.x[kept], rings.y[kept]
    new.beyond[at[kept]] = np.where((f == 0) & (g > 0), q, rings.beyond)[kept]
    i, j, to = np.flatnonzero(crossing), after[crossing], (at + kept)[crossing]
    t = f[i] / (f[i] - f[j])
    new.x[to] = rings.x[i] + (rings.x[j] - rings.x[i]) * t
    new.y[to] = rings.y[i] + (rings.y[j] - rings.y[i]) * t
    new.beyond[to] = np.where(f[i] < 0, q[i], rings.beyond[i])
    return new


def _clip_all(rings: Rings, cell: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray) -> Rings:
    """Clips cells by the bisectors towards each of their ``other``, the closest first."""
    order = np.lexsort(((x[other] - x[cell]) ** 2 + (y[other] - y[cell]) ** 2, cell))
    other = other[order]
    n = np.bincount(cell, minlength=len(x))
    first = np.cumsum(n) - n
    ended = []
    for i in range(n.max(initial=0)):
        more = n[rings.cell] > i
        if not more.all():
            ended.append(rings.where(~more))
            rings = rings.where(more)
        rings = _clip(rings, other[np.minimum(first + i, len(other) - 1)], x, y)
    return _joined([*ended, rings])


def _pairs(cell: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a cell and another site."""
    cell, other = np.divmod(np.unique(cell * n + other), n)
    return cell, other


def cells(frames: np.ndarray, x: np.ndarray, y: np.ndarray, width: float, height: float, before: Rings | None = None) -> Rings:
    """The exact cells of sites at distinct places; ``before``: the rings of the same sites at places nearby."""
    n = len(x)
    frame = np.repeat(np.arange(len(frames) - 1), np.diff(frames))
    tree = Tree(frames, x, y)
    if before is None:
        steps = [(tree.order[:-i], tree.order[i:]) for i in range(1, min(WINDOW, n - 1) + 1)]
        a, b = (np.concatenate([np.empty(0, int), *side]) for side in zip(*steps)) if steps else (np.empty(0, int),) * 2
        near = frame[a] == frame[b]
        cell, other = _pairs(np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]]), n)
    else:
        edge = before.beyond >= 0
        cell, other = _pairs(before.cell[edge], before.beyond[edge], n)
    w, h = width / 2, height / 2
    corners = np.tile([-w, w, w, -w], n), np.tile([-h, -h, h, h], n)
    rings = _clip_all(Rings(np.repeat(np.arange(n), 4), *corners, np.full(4 * n, -1)), cell, other, x, y)
    whole = []
    while len(rings.cell):
        own = (rings.x - x[rings.cell]) ** 2 + (rings.y - y[rings.cell]) ** 2
        closer = tree.closest(frame[rings.cell], rings.x, rings.y, own * (1 - 1e-9) - 1e-12)
        missing = closer >= 0
        cell, other = _pairs(rings.cell[missing], closer[missing], n)
        still = np.isin(rings.cell, cell)
        whole.append(rings.where(~still))
        was = rings.where(still)
        rings = _clip_all(was, cell, other, x, y)
        # a clip that changes nothing ends a cell, so rounding can't keep it open
        changed = np.bincount(rings.cell, minlength=n) != np.bincount(was.cell, minlength=n)
        a, b = rings.where(~changed[rings.cell]), was.where(~changed[was.cell])
        changed[a.cell[(a.x != b.x) | (a.y != b.y)]] = True
        whole.append(rings.where(~changed[rings.cell]))
        rings = rings.where(changed[rings.cell])
    return _joined(whole) if whole else rings


def _moments(rings: Rings, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice the area of every cell, and six times its moments around its site, so that tiny cells keep their digits."""
    after = rings.following()
    rx, ry = rings.x - x[rings.cell], rings.y - y[rings.cell]
    cross = rx * ry[after] - rx[after] * ry
    terms = (cross, (rx + rx[after]) * cross, (ry + ry[after]) * cross)
    return tuple(np.bincount(rings.cell, v, len(x)) for v in terms)


def relaxed_areas(frames: np.ndarray, x: np.ndarray, y: np.ndarray, width: float, height: float, relaxations: int) -> np.ndarray:
    """Areas of the cells after moving each site to its cell's centre some times; 0 where nothing of a cell is in the world."""
    rings = cells(frames, x, y, width, height)
    for _ in range(relaxations):
        twice, mx, my = _moments(rings, x, y)
        some = twice != 0
        by = np.where(some, 3 * twice, 1.0)
        x, y = np.where(some, x + mx / by, x), np.where(some, y + my / by, y)
        rings = cells(frames, x, y, width, height, rings)
    return np.abs(_moments(rings, x, y)[0]) / 2
