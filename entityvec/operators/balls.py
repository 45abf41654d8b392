"""A hierarchy of balls over a corpus: groups of cells, cells, and parts of cells.

A row that looks for neighbours within a bound goes down the tree: a ball whose nearest point lies
beyond the bound is left out with all below it. Parts are small, so their radii are too: a cell
is met only if one of its parts may hold a neighbour, which its own radius often cannot rule out.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LLOYD_ROUNDS = 5


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _children(parent: np.ndarray, parents: int) -> list[np.ndarray]:
    order = np.argsort(parent, kind="stable")
    return np.split(order, np.searchsorted(parent[order], np.arange(1, parents)))


@dataclass
class Balls:
    """Centres of the three levels; radii are those of the rows placed in them."""

    groups: np.ndarray
    cells: np.ndarray
    parts: np.ndarray
    cell_group: np.ndarray
    part_cell: np.ndarray
    group_radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    part_radius: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.cells_of = _children(self.cell_group, len(self.groups))
        self.parts_of = _children(self.part_cell, len(self.cells))

    @staticmethod
    def over(cells: np.ndarray, sample: np.ndarray) -> "Balls":
        """Groups of about sqrt(cells) cells, refined by a few rounds of k-means; ``sample`` gives the parts."""
        wanted = max(1, int(np.sqrt(len(cells))))
        groups = cells[np.linspace(0, len(cells) - 1, wanted).astype(np.int64)]
        for _ in range(LLOYD_ROUNDS):
            near = _squared(cells, groups).argmin(1)
            used = np.unique(near)
            groups = np.stack([cells[near == g].mean(0) for g in used])
        near = _squared(cells, groups).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        empty = Balls(groups[used], cells, cells, near, np.arange(len(cells)))
        # Each cell is a part of itself, so none is without.
        parts = np.concatenate([cells, sample])
        return Balls(groups[used], cells, parts, near, np.append(np.arange(len(cells)), empty.place(sample)[1]))

    def place(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, cell and part of each row, each the nearest one inside that above."""
        group = _squared(a, self.groups).argmin(1) if len(a) else np.zeros(0, np.int64)
        cell, part = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for above, found, centres, below in ((group, cell, self.cells, self.cells_of), (cell, part, self.parts, self.parts_of)):
            for ball in np.unique(above):
                rows = np.flatnonzero(above == ball)
                found[rows] = below[ball][_squared(a[rows], centres[below[ball]]).argmin(1)]
        return group, cell, part

    def reached(self, a: np.ndarray, bound: np.ndarray, lower) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) that may have a score within their bound in one of the cell's parts.

        ``lower(rows, centres, radius)`` is the least score that a row can have in each ball.
        """
        near = lower(a, self.groups, self.group_radius) <= bound[:, None]
        for group in np.flatnonzero(near.any(0)):
            rows = np.flatnonzero(near[:, group])
            for cell in self.cells_of[group]:
                parts = self.parts_of[cell]
                parts = parts[self.part_radius[parts] >= 0]
                if not len(parts):
                    continue
                inside = rows[(lower(a[rows], self.parts[parts], self.part_radius[parts]) <= bound[rows, None]).any(1)]
                if len(inside):
                    yield int(cell), inside
