"""A two-level pivot index over vectors: fine pivots that grow with the square root of the rows, and pivots of pivots.

A query measures the coarse pivots, drops coarse cells by the triangle inequality, and measures only the fine pivots of
the cells that are left. Every pivot is a vector of the data and every row belongs to one fine pivot, so bounds hold
whatever pivot a row was given to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PIVOT_BYTES = 256_000_000  # of all pivots together, which are broadcast; beyond it their number stays
_SLACK = 1e-6              # times the scale of the data: covers rounding in the distances to pivots


def wanted_pivots(n: int, dim: int) -> int:
    return max(1, min(int(np.sqrt(n) / 1.5), PIVOT_BYTES // (8 * max(dim, 1))))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] - 2.0 * x @ p.T + (p * p).sum(1)[None, :]
    return np.sqrt(np.maximum(d2, 0.0))


@dataclass
class PivotIndex:
    """Fine pivots in the order of their coarse cell; after :meth:`bound`, what lies in each of them."""

    pivots: np.ndarray
    coarse: np.ndarray = field(init=False)  # places of the coarse pivots among the fine ones
    starts: np.ndarray = field(init=False)  # first fine pivot of each coarse cell, and their number

    def __post_init__(self):
        n = len(self.pivots)
        chosen = [0]
        nearest = distances(self.pivots, self.pivots[:1])[:, 0]
        for _ in range(min(n, int(np.ceil(np.sqrt(n)))) - 1):  # the farthest from those chosen so far
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(self.pivots, self.pivots[chosen[-1:]])[:, 0])
        cells = np.concatenate([distances(self.pivots[i:i + 4096], self.pivots[chosen]).argmin(1) for i in range(0, n, 4096)])
        order = np.argsort(cells, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.pivots, self.coarse = self.pivots[order], place[chosen]
        self.starts = np.searchsorted(cells[order], np.arange(len(chosen) + 1))

    def members(self, cell: int) -> slice:
        return slice(int(self.starts[cell]), int(self.starts[cell + 1]))

    def nearest(self, x: np.ndarray, cells: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """A near fine pivot of each vector and the distance to it: the nearest one in the ``cells`` nearest coarse cells."""
        to = distances(x, self.pivots[self.coarse])
        near = np.argsort(to, axis=1, kind="stable")[:, :cells]
        best, own = np.full(len(x), np.inf), np.zeros(len(x), int)
        for cell in np.unique(near):
            rows = np.flatnonzero((near == cell).any(1))
            some = self.members(cell)
            if some.stop > some.start:
                d = distances(x[rows], self.pivots[some])
                j = d.argmin(1)
                closer = d[np.arange(len(rows)), j] < best[rows]
                best[rows[closer]], own[rows[closer]] = d[np.arange(len(rows)), j][closer], some.start + j[closer]
        return own, best

    def bound(self, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, cover: np.ndarray) -> "PivotIndex":
        """Per fine pivot: its vectors, their nearest and farthest distance, and the distance that holds enough row ids."""
        self.count, self.lo, self.hi, self.cover = count, lo, hi, cover
        centres = self.pivots[self.coarse]
        self.reach = np.full(len(centres), -np.inf)   # how far a coarse cell's rows can lie from its pivot
        self.hold = np.full(len(centres), np.inf)     # within which distance of it enough row ids surely lie
        for cell in range(len(centres)):
            some = self.members(cell)
            to = distances(centres[cell:cell + 1], self.pivots[some])[0]
            if len(to):
                self.reach[cell] = (to + self.hi[some]).max()
                self.hold[cell] = (to + self.cover[some]).min()
        top = np.sqrt((self.pivots * self.pivots).sum(1)).max()
        self.slack = _SLACK * (1e-3 + top + max(0.0, self.hi[np.isfinite(self.hi)].max(initial=0.0)))
        return self

    def blocked(self, rows: int) -> "PivotIndex":
        """Deal the pivots to blocks of about ``rows`` vectors: neighbouring small pivots share one, a crowded pivot has several."""
        self.first, self.parts = np.zeros(len(self.pivots), int), np.ones(len(self.pivots), int)
        at, filled = 0, 0
        for p, n in enumerate(self.count):
            if filled and filled + n > rows:
                at, filled = at + 1, 0
            self.first[p], self.parts[p] = at, max(1, -(-int(n) // rows))
            at, filled = (at + self.parts[p], 0) if n > rows else (at, filled + int(n))
        self.blocks = int((self.first + self.parts).max())
        return self

    def home(self, own: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The block of rows with the pivots ``own``; ``hashed`` deals the rows of a crowded pivot."""
        return self.first[own] + hashed % self.parts[own]

    def blocks_of(self, pivots: np.ndarray) -> np.ndarray:
        """The blocks that hold rows of the pivots."""
        first, parts = self.first[pivots], self.parts[pivots]
        more = [np.arange(a, a + n) for a, n in zip(first[parts > 1], parts[parts > 1])]
        return np.unique(np.concatenate([first[parts == 1], *more]))

    def visit(self, x: np.ndarray) -> list[np.ndarray]:
        return self.visit_within(x)[0]

    def visit_within(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the fine pivots that can hold one of its nearest rows, or one as near as those, and the distance that bounds them."""
        to = distances(x, self.pivots[self.coarse])
        limit = (to + self.hold).min(1) + self.slack
        first = to.argmin(1)
        for cell in np.unique(first):  # the own cell tightens the bound
            rows, some = np.flatnonzero(first == cell), self.members(cell)
            limit[rows] = np.minimum(limit[rows], (distances(x[rows], self.pivots[some]) + self.cover[some]).min(1) + self.slack)
        out: list[list[np.ndarray]] = [[] for _ in x]
        open_ = to - self.reach <= limit[:, None]
        for cell in np.flatnonzero(open_.any(0)):
            rows, some = np.flatnonzero(open_[:, cell]), self.members(cell)
            d = distances(x[rows], self.pivots[some])
            ok = (d - self.hi[some] <= limit[rows, None]) & (self.lo[some] - d <= limit[rows, None]) & (self.count[some] > 0)
            for i, r in enumerate(rows):
                out[r].append(some.start + np.flatnonzero(ok[i]))
        return [np.concatenate(p) if p else np.zeros(0, int) for p in out], limit

    def probe(self, x: np.ndarray, probes: int, need: int) -> list[np.ndarray]:
        return self.probe_within(x, probes, need)[0]

    def probe_within(self, x: np.ndarray, probes: int, need: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query its ``probes`` nearest fine pivots that hold rows, and more until they hold ``need`` vectors, and the distance to the last."""
        held = np.flatnonzero(self.count > 0)
        to = distances(x, self.pivots[self.coarse])
        in_cell = np.diff(np.searchsorted(held, self.starts))
        out, last = [], np.zeros(len(x))
        for i, row in enumerate(np.argsort(to, axis=1, kind="stable")):
            upto = np.cumsum(in_cell[row])
            cells = row[:int(np.searchsorted(upto, min(4 * probes, len(held))) + 2)]
            while True:
                some = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in cells])
                some = some[self.count[some] > 0]
                d = distances(x[i:i + 1], self.pivots[some])[0]
                order = some[d.argsort(kind="stable")]
                enough = int(np.searchsorted(np.cumsum(self.count[order]), need) + 1)
                if enough <= len(order) or len(cells) == len(row):
                    break
                cells = row[:2 * len(cells)]
            out.append(order[:max(probes, enough)])
            last[i] = np.sort(d)[min(max(probes, enough), len(d)) - 1] + self.slack
        return out, last
