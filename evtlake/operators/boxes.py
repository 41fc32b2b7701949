"""Points in the boxes of a k-d partition: farthest points and nearest neighbours that skip boxes out of reach.

Distances are summed axis by axis, and so is the distance of a box; rounding keeps the order of
what it rounds, so the computed distance of a box is never above that of a point inside, and
skipping changes no result, not even a tie.
"""

from __future__ import annotations

import numpy as np

LEAF = 64
NEAR_LEAF = 16
#: Points from which boxes pay: for the farthest one, for the nearest ones.
LARGE, MANY = 16_384, 512
NONE = np.iinfo(np.int64).max


def gaps(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of arrays [4, ...], summed axis by axis like the column expression of ``points``."""
    with np.errstate(invalid="ignore"):
        total = np.square(points[0] - centre[0])
        for axis in (1, 2, 3):
            total += np.square(points[axis] - centre[axis])
    return total


def split(points: np.ndarray, leaf: int) -> np.ndarray:
    """Rows [boxes, leaf] of positions, -1 beyond the end: halves along the widest axis until a part fits."""
    n = points.shape[1]
    parts = max(1, -(-n // leaf))
    boxes = 1 << (parts - 1).bit_length()
    order = np.arange(n)
    bounds = np.array([0, n])
    finite = np.where(np.isfinite(points), points, 0.0)
    while len(bounds) <= boxes:
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        some = finite[:, order]
        width = np.maximum.reduceat(some, bounds[:-1], axis=1) - np.minimum.reduceat(some, bounds[:-1], axis=1)
        value = np.take_along_axis(some, width.argmax(axis=0)[owner][None, :], axis=0)[0]
        order = order[np.lexsort((value, owner))]
        middle = bounds[:-1] + (sizes + 1) // 2
        bounds = np.unique(np.concatenate([bounds, middle]))
        if len(bounds) == len(sizes) + 1:
            break
    sizes = np.diff(bounds)
    out = np.full((len(sizes), int(sizes.max())), -1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(n) - bounds[owner]] = order
    return out


class Boxes:
    """Points [4, n] by box. ``compared`` counts the distances of points that were computed."""

    def __init__(self, points: np.ndarray, pos: np.ndarray | None = None, leaf: int = LEAF):
        at = split(points, leaf)
        self.here = at >= 0
        self.pos = np.where(self.here, (np.arange(points.shape[1]) if pos is None else pos)[at], NONE)
        self.at = at
        self.points = np.where(self.here, points[:, at], np.nan)
        finite = np.isfinite(self.points)
        self.low = np.where(finite, self.points, np.inf).min(axis=2)
        self.high = np.where(finite, self.points, -np.inf).max(axis=2)
        self.compared = 0

    def reach(self, centres: np.ndarray) -> np.ndarray:
        """Squared distance of every box [..., boxes] from centres [4, ...]; a box of no finite point is out of reach."""
        total = 0.0
        for axis in range(4):
            c = centres[axis][..., None]
            away = np.maximum(np.maximum(self.low[axis] - c, c - self.high[axis]), 0.0)
            total = total + np.square(away)
        return total


class Field(Boxes):
    """Distances of points to the nearest centre so far, and the farthest point of every box."""

    def __init__(self, points: np.ndarray, pos: np.ndarray | None = None, closest: np.ndarray | None = None, leaf: int = LEAF):
        super().__init__(points, pos, leaf)
        self.closest = np.where(self.here, np.inf if closest is None else closest[self.at], -np.inf)
        self._settle(np.arange(len(self.at)))

    def _settle(self, boxes: np.ndarray) -> None:
        if len(boxes) == len(self.at):
            self.far, self.who = np.empty(len(boxes)), np.empty(len(boxes), np.int64)
        closest = self.closest[boxes]
        far = closest.max(axis=1)
        self.far[boxes] = far
        self.who[boxes] = np.where(closest == far[:, None], self.pos[boxes], NONE).min(axis=1)

    def add(self, centre: np.ndarray) -> None:
        """Only boxes that hold a point farther away than the box is are looked at."""
        boxes = np.flatnonzero(self.reach(centre) < self.far)
        if len(boxes):
            # a point that is not finite has no distance and keeps the one it has
            self.closest[boxes] = np.fmin(self.closest[boxes], gaps(self.points[:, boxes], centre))
            self.compared += boxes.size * self.at.shape[1]
            self._settle(boxes)

    def best(self) -> tuple[float, int]:
        """Distance and position of the farthest point; of equally far ones the earliest."""
        far = self.far.max()
        return float(far), int(self.who[self.far == far].min())

    def point(self, pos: int) -> np.ndarray:
        return self.points[:, self.pos == pos][:, 0]


class Plain:
    """The same of few points, without boxes."""

    def __init__(self, points: np.ndarray, pos: np.ndarray, closest: np.ndarray | None = None):
        order = np.argsort(pos)
        self.points, self.pos = points[:, order], pos[order]
        self.closest = np.full(len(pos), np.inf) if closest is None else closest[order]

    def add(self, centre: np.ndarray) -> None:
        self.closest = np.fmin(self.closest, gaps(self.points, centre))

    def best(self) -> tuple[float, int]:
        i = int(self.closest.argmax())
        return float(self.closest[i]), int(self.pos[i])

    def point(self, pos: int) -> np.ndarray:
        return self.points[:, np.searchsorted(self.pos, pos)]


def field(points: np.ndarray, pos: np.ndarray, closest: np.ndarray | None = None) -> Field | Plain:
    return (Field if len(pos) >= LARGE else Plain)(points, pos, closest)


def nearest(boxes: Boxes, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances [centres, k] of the nearest points, ties by position.

    The nearest boxes come first; a centre is done when the next box is beyond its k-th distance.
    All coordinates must be finite. Places beyond the number of points hold NONE and NaN.
    The distances computed are counted in ``boxes.compared``.
    """
    n = centres.shape[1]
    away = boxes.reach(centres)
    order = np.argsort(away, axis=1, kind="stable")
    away = np.take_along_axis(away, order, axis=1)
    pos, d2 = np.full((n, k), NONE), np.full((n, k), np.inf)
    live = np.arange(n)
    for step in range(order.shape[1]):
        live = live[away[live, step] <= d2[live, k - 1]]
        if not len(live):
            break
        box = order[live, step]
        found = gaps(boxes.points[:, box], centres[:, live, None])
        boxes.compared += found.size
        all_pos = np.concatenate([pos[live], boxes.pos[box]], axis=1)
        all_d2 = np.concatenate([d2[live], np.where(boxes.here[box], found, np.inf)], axis=1)
        best = np.lexsort((all_pos, all_d2), axis=1)[:, :k]
        pos[live] = np.take_along_axis(all_pos, best, axis=1)
        d2[live] = np.take_along_axis(all_d2, best, axis=1)
    return pos, np.where(pos == NONE, np.nan, d2)


def nearest_of(points: np.ndarray, pos: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of any points: without boxes where they are few or not finite; a distance that is NaN comes last."""
    if len(pos) >= MANY and np.isfinite(points).all() and np.isfinite(centres).all():
        return nearest(Boxes(points, pos, NEAR_LEAF), centres, k)
    d2 = gaps(points[:, None, :], centres[:, :, None])
    return smallest(np.broadcast_to(pos, d2.shape), d2, k)


def smallest(pos: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row by distance and position, filled up with NONE and NaN, which sort behind all others."""
    best = np.lexsort((pos, d2), axis=1)[:, :k]
    pos, d2 = np.take_along_axis(pos, best, axis=1), np.take_along_axis(d2, best, axis=1)
    fill = ((0, 0), (0, k - best.shape[1]))
    return np.pad(pos, fill, constant_values=NONE), np.pad(d2, fill, constant_values=np.nan)
