"""Exact nearest-vector search as a pruned block join.

1. Rows are assigned to the nearest of P pivots, which are rows sampled by hash. Dense
   regions get proportionally many pivots, so cells stay even; P is bounded.
2. Each cell is cut into blocks of about ``block_rows`` rows, several MB. A block is one packed
   row and the unit of the shuffle: a row travels once for each block that it may meet.
3. Every block looks up, for each of its rows, an upper bound of the k-th distance (inside
   its own block, over the pivots, or from the cell radii) and sends the row only to cells
   whose lower bound does not exceed it (triangle inequality). That leaves out far
   clusters. On vectors without clusters nearly every block is met, so the exact join does
   rows * rows / cores work there and moves rows * blocks vectors.
4. Packs and blocks meet in an equi join on the block key. A task goes over the block in
   tiles and keeps the k best of each row, by score and then id, so exactly min(k, candidates)
   edges leave a pair of blocks for a row; a rank window with a per-task limit merges them.

Only the cell summary (P vectors and counters) is ever broadcast. Results are exact and
do not depend on P, the block size or the partitioning; ties go to the smaller id.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityvec.functions.hashing import keyed_hash
from entityvec.functions.scratch import written
from entityvec.functions.shipping import ship_arrays, unpack_arrays
from entityvec.operators.balls import Balls
from entityvec.operators.ranking import take_by_hash

METRICS = ("euclidean", "dot")
MEMBER = ("id", "grp", "vec")
BATCH_BYTES = 32 * 1024 * 1024
GATHER_VALUES = 1 << 20
#: Pivots that the bounds of k-th scores are looked up among, and numbers of a tile of rows and cells.
BOUND_PIVOTS, TILE_VALUES = 4096, 1 << 22
#: Scores of a tile that are few: less than one in so many.
FEW_PARTS = 16
#: Small blocks and tiles grow with the corpus so that a cell is cut only where it has more than this part of all rows.
CORPUS_PARTS = 16
#: Rows that bound the k-th scores: a part of the corpus, up to so many bytes.
PROBE_PARTS, PROBE_BYTES = 8, 32 * 1024 * 1024


@dataclass(frozen=True)
class Layout:
    """Sizes of the search; they change the speed, never the result.

    ``probe_cells`` is the exception and off by default: a row then meets its own block and the
    cells of that many nearest pivots only, so neighbours can be missed. Work and shuffle fall
    to rows * probe_cells blocks, which is what an approximate search on unclustered vectors needs.
    """

    # A cell half as large again as the average is one block still.
    block_rows: int = 24_576
    block_bytes: int = 16 * 1024 * 1024
    cell_rows: int = 16_384
    max_cells: int = 4096
    pivot_bytes: int = 64 * 1024 * 1024
    cells: int | None = None
    tile: int = 1024
    probe_cells: int | None = None
    # Pivots moved by k-means to the middle of what they stand for; cells get smaller radii.
    refined: bool = False
    # Cells found and ruled out by a tree of balls with about so many parts for each cell; their
    # number is then bounded by ``pivot_bytes`` alone.
    tree: bool = False
    parts: int = 64

    def block_rows_for(self, width: int, rows: int) -> int:
        """Rows per block: wide vectors get shorter blocks, so a block fits a batch.

        A row may travel once for each block. So blocks shorter than the default ones grow with the number of
        rows, else the shuffle would grow with its square from the smallest tables on.
        """
        least = min(math.ceil(rows / CORPUS_PARTS), Layout.block_rows)
        return max(16, min(max(self.block_rows, least), self.block_bytes // (8 * max(width, 1))))

    def tile_for(self, rows: int) -> int:
        """Rows per tile: the tiles of two blocks are passed over one by one, so short ones grow with the number of rows as blocks do."""
        return max(self.tile, min(math.ceil(rows / CORPUS_PARTS), Layout.tile))

    def cells_for(self, rows: int, width: int) -> int:
        """Number of pivots; they go through the driver, so their total size is bounded."""
        wanted = self.cells or math.ceil(rows / self.cell_rows)
        fits = max(1, self.pivot_bytes // (8 * max(width, 1)))
        return max(1, min(wanted, fits if self.tree else self.max_cells, fits, max(rows, 1)))

    def sample_for(self, rows: int, width: int) -> int:
        """Rows that go through the driver: the pivots, and what they are refined or divided by."""
        wanted = self.cells_for(rows, width)
        if self.tree or self.refined:
            fits = max(1, self.pivot_bytes // (8 * max(width, 1)))
            return max(wanted, min(wanted * self.parts, fits, rows))
        return wanted


@dataclass(frozen=True)
class CellSummary:
    """What a task must know about all cells; P rows, whatever the table size."""

    metric: str
    pivots: np.ndarray
    pivot_groups: np.ndarray
    rows: np.ndarray
    largest_group: np.ndarray
    rmin: np.ndarray
    rmax: np.ndarray
    blocks: np.ndarray
    balls: Balls | None = None
    # More rows of the corpus than a block has, where it has many blocks: they bound the k-th scores.
    probes: np.ndarray | None = None
    probe_groups: np.ndarray | None = None


def as_matrix(vectors) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if vectors.null_count or (len(vectors) and (len(flat) % len(vectors))):
        raise ValueError("vectors must be present and equally long")
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0, out=out)


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Pairwise scores (smaller is nearer) and a bound of their rounding error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b))), 0.0
    size = float((a * a).sum(1).max() + (b * b).sum(1).max())
    if metric == "dot":
        return -(a @ b.T), 1e-12 * size
    return np.sqrt(squared_distances(a, b)), 2e-6 * math.sqrt(size)


def pair_scores(a: np.ndarray, r: np.ndarray, b: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows ``r`` of a with rows ``j`` of b, computed directly: equal vectors are at exactly 0.

    Vectors are gathered in slices of a few MB, however many pairs there are.
    """
    out = np.empty(len(r))
    step = max(1, GATHER_VALUES // max(1, a.shape[1]))
    for i in range(0, len(r), step):
        s = slice(i, i + step)
        if metric == "dot":
            out[s] = -(a[r[s]] * b[j[s]]).sum(1)
        else:
            d = a[r[s]] - b[j[s]]
            out[s] = np.sqrt((d * d).sum(1))
    return out


def raw_scores(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Scores that sort alike without the root (squared distances), and their error bound."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b))), 0.0
    size = float((a * a).sum(1).max() + (b * b).sum(1).max())
    return (-(a @ b.T) if metric == "dot" else squared_distances(a, b)), 1e-12 * size


def raw_limit(score: np.ndarray, metric: str) -> np.ndarray:
    return np.array(score, np.float64) if metric == "dot" else np.square(score, dtype=np.float64)


def group_codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Comparable codes of two group columns; rows without a group form one."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1)
    codes = both.to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a):]


def same_group(a, b) -> np.ndarray:
    """Matrix of equal groups."""
    x, y = group_codes(a, b)
    return x[:, None] == y[None, :]


def flat_row(column, row: int) -> pa.StructArray:
    """Struct array held by one row of a list column."""
    values = column[row].values
    return values if values is not None else pa.array([], column.type.value_type)


def as_list(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _assign(pivots) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = unpack_arrays(pivots)
        for batch in batches:
            if not batch.num_rows:
                continue
            a = as_matrix(batch.column("vec"))
            d2 = squared_distances(a, centres)
            cell = d2.argmin(1)
            radius = pair_scores(a, np.arange(len(a)), centres, cell, "euclidean")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                names=[*batch.schema.names, "cell", "radius"])

    return run


def _assign_down(sent) -> "callable":
    """Rows with their cell and part, and their distance from each centre above them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls: Balls = unpack_arrays(sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            a = as_matrix(batch.column("vec"))
            every = np.arange(len(a))
            group, cell, part = balls.place(a)
            far = [pair_scores(a, every, c, i, "euclidean") for c, i in
                   ((balls.cells, cell), (balls.parts, part), (balls.groups, group))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[0]), pa.array(part.astype(np.int32)),
                 pa.array(far[1]), pa.array(far[2])],
                names=[*batch.schema.names, "cell", "radius", "part", "part_radius", "group_radius"])

    return run


def _refined(sample: np.ndarray, cells: int, spark) -> np.ndarray:
    """Places in ``sample`` of the rows nearest to the centres of k-means over it.

    Pivots stay rows of the corpus, as the bounds of k-th scores want them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = spark.createDataFrame([(Vectors.dense(v),) for v in sample], T.StructType([T.StructField("features", VectorUDT())]))
    centres = np.array(KMeans(k=max(cells, 2), maxIter=10, seed=0, initMode="random").fit(rows).clusterCenters())
    step = max(1, (1 << 22) // len(sample))
    near = [squared_distances(centres[i:i + step], sample).argmin(1) for i in range(0, len(centres), step)]
    return np.unique(np.concatenate(near))[:max(cells, 1)]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] < k:
        return np.full(values.shape[0], np.inf)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


def _bounds(a, groups, summary: CellSummary, k: int, exclude: bool, self_join: bool, tile: int) -> np.ndarray:
    """Per row, a value that the k-th best score cannot exceed; memory is bounded by tiles."""
    bound = np.full(len(a), np.inf)
    # Any rows of the corpus give a bound; there may be very many pivots.
    known = [(summary.pivots[:BOUND_PIVOTS], pa.array(summary.pivot_groups[:BOUND_PIVOTS], type=groups.type))]
    if self_join:
        known.append((a, groups))
    if summary.probes is not None:
        known.append((summary.probes, pa.array(summary.probe_groups, type=groups.type)))
    for b, other in known:
        if len(b) >= k:
            bound = _sample_bounds(a, b, bound, *group_codes(groups, other), summary.metric, k, exclude, tile)
    for lo in range(0, len(a), tile):
        rows = slice(lo, lo + tile)
        bound[rows] = _cell_bounds(a[rows], bound[rows], summary, k, exclude)
    return bound


def _sample_bounds(a, b, bound: np.ndarray, mine, other, metric: str, k: int, exclude: bool, tile: int) -> np.ndarray:
    """The bounds, where lower: the k-th scores among some rows of the corpus."""
    bound, loose = bound.copy(), np.ones(len(a), bool)
    short = ShortScores.of(a, b, metric)
    if short is not None:
        kth = short.kth(mine, other, k, exclude, tile)
        low = kth + 2 * short.error
        bound = np.minimum(bound, np.sqrt(np.maximum(low, 0.0)) if metric == "euclidean" else low)
        # Single precision is near enough unless the neighbours lie very close.
        loose = np.isfinite(kth) & (short.error > 1e-3 * np.abs(kth))
    at = np.flatnonzero(loose)
    if len(at):
        for r, _, score in best_places(a[at], b, bound[at], mine[at], other, np.arange(len(b)), metric, k, exclude, tile):
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            # Scores of the same rows may differ in their last digits.
            bound[at[r[last]]] = np.minimum(bound[at[r[last]]], score[last] + 1e-12 * np.abs(score[last]))
    return bound


def _cell_bounds(a: np.ndarray, bound: np.ndarray, summary: CellSummary, k: int, exclude: bool) -> np.ndarray:
    """Bounds of rows without one, from the sizes of cells."""
    if np.isinf(bound).any():
        far = _cell_scores(a, summary)[1]
        sure = summary.rows - (summary.largest_group if exclude else 0)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(sure[order], axis=1) >= k
        first = enough.argmax(1)
        reach = np.take_along_axis(far, order, 1)[np.arange(len(a)), first]
        bound = np.minimum(bound, np.where(enough.any(1), reach, np.inf))
    return bound


def _cell_scores(a: np.ndarray, summary: CellSummary) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row of each cell can have."""
    s, slack = scores(a, summary.pivots, summary.metric)
    if summary.metric == "dot":
        reach = np.sqrt((a * a).sum(1))[:, None] * summary.rmax[None, :]
        return s - reach - slack - 1e-9 * reach, s + reach + slack + 1e-9 * reach
    low = np.maximum(s - summary.rmax, summary.rmin - s) - 2 * slack
    return np.maximum(low, 0.0), s + summary.rmax + 2 * slack


def _ball_scores(metric: str):
    """Least score that rows can have in balls, to the safe side of rounding."""
    def lower(a: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        s, slack = scores(a, centres, metric)
        if metric == "dot":
            reach = np.sqrt((a * a).sum(1))[:, None] * radius[None, :]
            return s - reach - slack - 1e-9 * reach
        return np.maximum(s - radius - 2 * slack, 0.0)
    return lower


def _targets(a: np.ndarray, bound: np.ndarray, summary: CellSummary, tile: int, probe: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows) for every cell that may hold a wanted neighbour of the rows."""
    if summary.balls is not None and probe is None:
        yield from summary.balls.reached(a, bound, _ball_scores(summary.metric))
        return
    wanted = np.vstack([_cell_scores(a[lo:lo + tile], summary)[0] <= bound[lo:lo + tile, None] for lo in range(0, len(a), tile)])
    if probe is not None:
        wanted &= np.vstack([_probed(a[lo:lo + tile], summary, probe) for lo in range(0, len(a), tile)])
    for c in np.flatnonzero(wanted.any(0)):
        yield int(c), np.flatnonzero(wanted[:, c])


def _probed(a: np.ndarray, summary: CellSummary, cells: int) -> np.ndarray:
    """(rows, cells): whether the cell's pivot is among the row's nearest ones."""
    near = scores(a, summary.pivots, summary.metric)[0]
    return near <= _kth(near, min(cells, near.shape[1]))[:, None]


def _route(cells, k: int | None, exclude: bool, self_join: bool, tile_rows: int, probe: int | None = None):
    """Packs to (target block, rows) for every block that may hold a wanted neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: CellSummary = unpack_arrays(cells)
        tile = max(1, min(tile_rows, TILE_VALUES // max(1, len(summary.pivots))))
        for batch in batches:
            members = as_list(batch.column("rows"))
            for i in range(batch.num_rows):
                rows = flat_row(members, i)
                home = (batch.column("cell")[i].as_py(),
                        batch.column("sub")[i].as_py() if self_join else 0)
                a = as_matrix(rows.field("vec"))
                if k is None:
                    bound = rows.field("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                else:
                    bound = _bounds(a, rows.field("grp"), summary, k, exclude, self_join, tile)
                    names = [f.name for f in rows.type]
                    rows = pa.StructArray.from_arrays(
                        [*[rows.field(n) for n in names], pa.array(bound)],
                        names=[*names, "bound"])
                room = max(1, BATCH_BYTES // (8 * a.shape[1]))
                yield from _packs(rows, _targets(a, bound, summary, tile, probe), summary.blocks, home, room)

    return run


def _packs(rows, wanted: Iterator[tuple[int, np.ndarray]], blocks: np.ndarray, home,
           room: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``room`` packed rows."""
    pending, size = [(home[0], home[1], True, np.arange(len(rows)))], len(rows)
    for c, idx in wanted:
        for target in ((c, s, False, idx) for s in range(int(blocks[c])) if (c, s) != home):
            if size >= room:
                yield _pack_batch(rows, pending)
                pending, size = [], 0
            pending.append(target)
            size += len(idx)
    if pending:
        yield _pack_batch(rows, pending)


def _pack_batch(rows, targets) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(t[3]) for t in targets])]).astype(np.int32)
    picked = rows.take(pa.array(np.concatenate([t[3] for t in targets])))
    return pa.RecordBatch.from_arrays(
        [pa.array([t[0] for t in targets], pa.int32()), pa.array([t[1] for t in targets], pa.int32()),
         pa.array([t[2] for t in targets]), pa.ListArray.from_arrays(pa.array(offsets), picked)],
        names=["cell", "sub", "home", "pack"])


def _nearest(metric: str, k: int, exclude: bool, tile: int):
    """(pack, block) pairs to the at most k best candidates of each packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs, blocks = as_list(batch.column("pack")), as_list(batch.column("rows"))
            for i in range(batch.num_rows):
                q, c = flat_row(packs, i), flat_row(blocks, i)
                if batch.column("home")[i].as_py():
                    # One empty edge per row keeps rows that find no neighbour at all.
                    n = len(q)
                    yield _edges(q, np.arange(n), c, np.full(n, -1), np.full(n, np.nan))
                if len(c) and len(q):
                    for found in best_pairs(q, c, metric, k, exclude, tile):
                        yield _edges(q, found[0], c, found[1], found[2])

    return run


def best_pairs(q, c, metric: str, k: int, exclude: bool, tile: int, keys: tuple[np.ndarray, np.ndarray] | None = None):
    """(rows of q, rows of c, scores) of the k best candidates within each row's bound.

    Yields one result for each ``tile`` rows of q. Equal scores go to the smaller id, so no
    row gets more than k whatever the ties. With ``keys``, a row of them for each row of q and of c,
    only rows that agree in a place of theirs are candidates.
    """
    bounds = q.field("bound").to_numpy(zero_copy_only=False).astype(np.float64)
    place = common_order(c.field("id"), c.field("id")[:0])[0].astype(np.int64)
    yield from best_places(as_matrix(q.field("vec")), as_matrix(c.field("vec")), bounds, *group_codes(q.field("grp"), c.field("grp")),
                           place, metric, k, exclude, tile, keys)


def best_places(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, mine: np.ndarray, other: np.ndarray, place: np.ndarray,
                metric: str, k: int, exclude: bool, tile: int, keys: tuple[np.ndarray, np.ndarray] | None = None,
                ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of matrices, codes of their groups and the places that ``b`` has in the order of ids."""
    short = ShortScores.of(a, b, metric)
    for lo in range(0, len(a), tile):
        part, limit = a[lo:lo + tile], bounds[lo:lo + tile].copy()
        r, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held, waiting = [], 0
        for start in range(0, len(b), tile):
            some = b[start:start + tile]
            groups = (mine[lo:lo + tile], other[start:start + tile]) if exclude else None
            both = keys and (keys[0][lo:lo + tile], keys[1][start:start + tile])
            near = short and near_pairs(*short.tile(slice(lo, lo + tile), slice(start, start + tile), limit), groups, k, both)
            # Scores in single precision that cannot tell the rows apart.
            if near is None or len(near[0]) > 2 * k * len(part):
                s, error = raw_scores(part, some, metric)
                near = near_pairs(s, raw_limit(limit, metric), error, groups, k, both)
            x, y = near
            if not len(x):
                continue
            held.append((x, y + start, pair_scores(part, x, some, y, metric)))
            waiting += len(x)
            # Merged when there are many, as a merge sorts all that is kept.
            if waiting > k * len(part) or start + tile >= len(b):
                r, j, score = first_k(*(np.concatenate(v) for v in zip((r, j, score), *held)), place, k)
                held, waiting = [], 0
                # The k-th score so far bounds what can still come in.
                ends = np.searchsorted(r, np.arange(len(part)), side="right")
                full = np.flatnonzero(ends - np.searchsorted(r, np.arange(len(part))) == k)
                limit[full] = np.minimum(limit[full], score[ends[full] - 1])
        if held:
            r, j, score = first_k(*(np.concatenate(v) for v in zip((r, j, score), *held)), place, k)
        if len(r):
            yield r + lo, j, score


@dataclass(frozen=True)
class ShortScores:
    """Raw scores of two sets of rows in single precision, less a number for each row, and a bound of their error."""

    a: np.ndarray
    b: np.ndarray
    offset: np.ndarray
    error: float
    metric: str

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, metric: str) -> "ShortScores | None":
        """None where single precision overflows or comes near its least numbers."""
        if not a.size or not b.size:
            return None
        # Distances from the middle stay the same, and norms get small.
        euclidean = metric == "euclidean"
        middle = b.mean(0) if euclidean else np.zeros(b.shape[1])
        mine, other = _norms(a, middle), _norms(b, middle)
        size = float(mine.max() + other.max())
        if not 1e-24 < size < 1e30:
            return None
        x = _shortened(a, middle, -2.0 if euclidean else -1.0, np.ones(len(a)) if euclidean else None)
        y = _shortened(b, middle, 1.0, other if euclidean else None)
        # Of d products, each rounded, and their sum: at most d + 2 roundings of the sum of their magnitudes. Shifting
        # to the middle rounds in double precision, which is less than the numbers added.
        return ShortScores(x, y, mine if euclidean else np.zeros(len(a)), (x.shape[1] + 32) * 2.0 ** -23 * size, metric)

    def tile(self, rows: slice, columns: slice, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Scores of a tile, and what ``limit`` is in their terms."""
        return self.a[rows] @ self.b[columns].T, raw_limit(limit, self.metric) - self.offset[rows], self.error


    def kth(self, mine: np.ndarray, other: np.ndarray, k: int, exclude: bool, tile: int) -> np.ndarray:
        """Per row the k-th raw score, within the error; infinite where there are fewer."""
        out = np.empty(len(self.a))
        for lo in range(0, len(self.a), tile):
            rows, best = slice(lo, lo + tile), np.zeros((len(self.a[lo:lo + tile]), 0), np.float32)
            step = max(2 * k, TILE_VALUES // max(1, len(best)))
            for start in range(0, len(self.b), step):
                s = self.a[rows] @ self.b[start:start + step].T
                # Only scores below the k-th so far can lower it.
                near = s < best.max(1)[:, None] if best.shape[1] == k else None
                if near is not None and np.count_nonzero(near) * FEW_PARTS < near.size:
                    x, y = np.divmod(few_places(near), s.shape[1])
                    if exclude:
                        foreign = mine[rows][x] != other[start + y]
                        x, y = x[foreign], y[foreign]
                    s = _side_by_side(x, s[x, y], len(s))
                elif exclude:
                    s[mine[rows, None] == other[None, start:start + step]] = np.inf
                best = np.concatenate([best, s], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, k - 1, axis=1)[:, :k].copy()
            out[rows] = _kth(best, k) + self.offset[rows]
        return out


def few_places(near: np.ndarray) -> np.ndarray:
    """Flat places of the true values of a matrix, quickest where they are few: eight values are passed over at once."""
    flat = np.ascontiguousarray(near).reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    at, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[at] * 8 + bit, np.flatnonzero(flat[whole:]) + whole])


def _side_by_side(x: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Values of ascending rows ``x`` as a matrix, filled up with infinity."""
    n = np.bincount(x, minlength=rows)
    out = np.full((rows, n.max(initial=0)), np.inf, values.dtype)
    out[x, np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _row_slices(a: np.ndarray) -> Iterator[slice]:
    """Slices of a few MB, so that no copy in double precision of a large block or of the probes is held."""
    step = max(1, GATHER_VALUES // max(1, a.shape[1]))
    return (slice(i, i + step) for i in range(0, len(a), step))


def _norms(a: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Squared distances from the middle."""
    out = np.empty(len(a))
    for s in _row_slices(a):
        out[s] = np.square(a[s] - middle).sum(1)
    return out


def _shortened(a: np.ndarray, middle: np.ndarray, factor: float, last: np.ndarray | None) -> np.ndarray:
    """Differences from the middle times a factor in single precision, with one more column."""
    out = np.empty((len(a), a.shape[1] + (last is not None)), np.float32)
    for s in _row_slices(a):
        out[s, :a.shape[1]] = factor * (a[s] - middle)
    if last is not None:
        out[:, -1] = last
    return out


def near_pairs(s: np.ndarray, limit: np.ndarray, error: float, groups, k: int, keys=None) -> tuple[np.ndarray, np.ndarray]:
    """Places in a tile of scores that may be among a row's k best within its limit, those too near to tell apart included."""
    near = s <= (limit + 2 * error).astype(s.dtype)[:, None]
    # No more than the tile's own k best of a row matter. Rows are counted only where there are more than k on average.
    many = np.flatnonzero(np.count_nonzero(near, axis=1) > k) if np.count_nonzero(near) > k * len(near) else ()
    if len(many):
        some = s[many]
        if groups is not None:
            some[groups[0][many, None] == groups[1][None, :]] = np.inf
        if keys is not None:
            some[~_agreeing(keys[0][many], keys[1])] = np.inf
        near[many] &= some <= (_kth(some, k) + 2 * error)[:, None]
    x, y = np.divmod(few_places(near), s.shape[1])
    keep = np.isfinite(s[x, y])
    if groups is not None:
        keep &= groups[0][x] != groups[1][y]
    x, y = x[keep], y[keep]
    if keys is not None:
        keep = (keys[0][x] == keys[1][y]).any(1)
        x, y = x[keep], y[keep]
    return x, y


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the rows whose keys agree in a place."""
    out = np.zeros((len(a), len(b)), bool)
    for i in range(a.shape[1]):
        out |= a[:, i, None] == b[None, :, i]
    return out


def first_k(r: np.ndarray, j: np.ndarray, score: np.ndarray, place: np.ndarray, k: int):
    """Per row the k lowest scores, equal ones by the place of their id."""
    order = np.lexsort((place[j], score, r))
    r, j, score = r[order], j[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], j[keep], score[keep]


def _edges(q, r, c, j, score) -> pa.RecordBatch:
    j = pa.array(j, mask=j < 0)
    return pa.RecordBatch.from_arrays(
        [q.field("id").take(pa.array(r)), q.field("grp").take(pa.array(r)),
         c.field("id").take(j), c.field("grp").take(j), pa.array(score, from_pandas=True)],
        names=["id", "grp", "nb_id", "nb_grp", "score"])


def _better(metric: str):
    """(pack, block) pairs to, per packed row, how many rows of other groups beat its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs, blocks = as_list(batch.column("pack")), as_list(batch.column("rows"))
            for i in range(batch.num_rows):
                q, c = flat_row(packs, i), flat_row(blocks, i)
                n = count_better(
                    q.field("id"), as_matrix(q.field("vec")), q.field("grp"),
                    q.field("bound").to_numpy(zero_copy_only=False), q.field("best_id"),
                    as_matrix(c.field("vec")), c.field("grp"), c.field("id"), metric)
                yield pa.RecordBatch.from_arrays([q.field("id"), pa.array(n)], names=["id", "n"])

    return run


def count_better(q_ids, a, ga, bound, best_id, b, gb, ids, metric: str) -> np.ndarray:
    """Rows of other groups that score below the bound, or equal it with a smaller id.

    The bound is the best score of the own group, so of that group only the query itself can
    lie below it.
    """
    if not len(b) or not len(a):
        return np.zeros(len(a), np.int64)
    s, error = raw_scores(a, b, metric)
    bound = np.asarray(bound, np.float64)
    limit = raw_limit(bound, metric)
    sure = s < (limit - 2 * error)[:, None]
    n = sure.sum(1).astype(np.int64)
    self_at = pc.index_in(q_ids, value_set=ids)
    here = np.nonzero(self_at.is_valid().to_numpy(zero_copy_only=False))[0]
    n[here] -= sure[here, self_at.take(pa.array(here)).to_numpy(zero_copy_only=False)]
    r, j = np.nonzero(np.abs(s - limit[:, None]) <= 2 * error)
    mine, other = group_codes(ga, gb)
    foreign = mine[r] != other[j]
    r, j = r[foreign], j[foreign]
    if len(r):
        exact = pair_scores(a, r, b, j, metric)
        wins = exact < bound[r]
        tie = exact == bound[r]
        if tie.any():
            mine, other = common_order(ids, best_id)
            wins[tie] = mine[j[tie]] < other[r[tie]]
        np.add.at(n, r[wins], 1)
    return n


def common_order(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of both arrays' values in their common order, equal values alike."""
    place = pc.rank(pa.concat_arrays([a, b]), tiebreaker="dense").to_numpy()
    return place[:len(a)], place[len(a):]


def _struct_of(schema: T.StructType, extra: list[T.StructField]) -> T.StructType:
    fields = [T.StructField(n, schema[n].dataType) for n in MEMBER]
    return T.StructType(fields + extra)


def _pack(assigned: DataFrame, blocks: np.ndarray, columns: list[str]) -> DataFrame:
    """One row per block. Blocks are about ``block_rows`` long, also in a hot cell."""
    spark = assigned.sparkSession
    # From an Arrow table, as a list of rows is read by Python workers that stay beside those of the search.
    counts = pa.table({"cell": pa.array(np.arange(len(blocks)), pa.int32()), "_blocks": pa.array(np.maximum(blocks, 1), pa.int32())})
    table = spark.createDataFrame(counts)
    sub = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    # The filter drops nothing; it makes both uses of the blocks plan alike and share a shuffle.
    return (assigned.join(F.broadcast(table), "cell").withColumn("sub", sub)
            .filter(F.col("sub").isNotNull())
            .groupBy("cell", "sub").agg(F.collect_list(F.struct(*columns)).alias("rows")))


def _summarise(assigned: DataFrame, pivots: np.ndarray, groups, metric: str,
               layout: Layout, balls: Balls | None = None) -> CellSummary:
    per_cell = (assigned.groupBy("cell", "grp")
                .agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"),
                     F.max("radius").alias("hi"))
                .groupBy("cell")
                .agg(F.sum("n").alias("n"), F.max("n").alias("g"), F.min("lo").alias("lo"),
                     F.max("hi").alias("hi")).collect())
    p = len(pivots)
    rows, top = np.zeros(p, np.int64), np.zeros(p, np.int64)
    lo, hi = np.zeros(p), np.zeros(p)
    for r in per_cell:
        i = r["cell"]
        rows[i], top[i], lo[i], hi[i] = r["n"], r["g"], r["lo"], r["hi"]
    if balls is not None:
        # Balls without a row stay below zero. A group's radius is that of all rows of its cells.
        balls.part_radius, balls.group_radius = np.full(len(balls.parts), -1.0), np.full(len(balls.groups), -1.0)
        for r in assigned.groupBy("cell", "part").agg(F.max("part_radius").alias("p"), F.max("group_radius").alias("g")).collect():
            balls.part_radius[r["part"]] = r["p"]
            group = balls.cell_group[r["cell"]]
            balls.group_radius[group] = max(balls.group_radius[group], r["g"])
    return CellSummary(metric, pivots, groups, rows, top, lo, hi,
                       np.ceil(rows / layout.block_rows_for(pivots.shape[1], int(rows.sum()))).astype(np.int64), balls)


class BlockSearch:
    """Cells and packed blocks of one corpus (columns ``id``, ``grp``, ``vec``)."""

    def __init__(self, corpus: DataFrame, metric: str = "euclidean",
                 layout: Layout | None = None):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.layout = layout or Layout()
        self.metric = metric
        self.spark = corpus.sparkSession
        # Read four times below; it may stand for a projection of wide vectors.
        self.corpus = written(corpus.select("id", "grp", "vec"), "corpus")
        self.size, width = self.corpus.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        if not self.size:
            raise ValueError("no vectors to search")
        wanted, taken = self.layout.cells_for(self.size, width), self.layout.sample_for(self.size, width)
        # A cut found from counters: no task gathers more than the sample.
        sample = (take_by_hash(self.corpus, "id", 0, lambda n: taken)[0]
                  .orderBy(keyed_hash(0, "id"), "id").collect())
        every = np.array([r["vec"] for r in sample], dtype=np.float64)
        chosen = _refined(every, wanted, self.spark) if self.layout.refined else np.arange(len(every))[:wanted]
        _, keep = np.unique(every[chosen], axis=0, return_index=True)
        keep = chosen[np.sort(keep)]
        self.pivots = every[keep]
        groups = np.empty(len(keep), dtype=object)
        groups[:] = [sample[i]["grp"] for i in keep]
        self.block_rows, self.tile = self.layout.block_rows_for(width, self.size), self.layout.tile_for(self.size)
        self.balls = Balls.over(self.pivots, every) if self.layout.tree else None
        self._centres = ship_arrays(self.spark, self.balls if self.layout.tree else self.pivots)
        self.assigned = written(self.assign(self.corpus), "cells")
        self.summary = replace(_summarise(self.assigned, self.pivots, groups, metric, self.layout, self.balls), **self._probes(width))
        self._cells = ship_arrays(self.spark, self.summary)
        # One plan for both sides of a self-join, so its shuffle is done once.
        self._blocks = _pack(self.assigned, self.summary.blocks, list(MEMBER))

    def _probes(self, width: int) -> dict[str, np.ndarray]:
        """Rows that bound the k-th scores better than a row's own block.

        A row gets up to k edges from each block within its bound. The bound of a sample of m rows leaves k * size / m.
        """
        taken = min(self.size // PROBE_PARTS, PROBE_BYTES // (8 * max(width, 1)))
        if taken <= self.block_rows or self.layout.probe_cells is not None:
            return {}
        rows = take_by_hash(self.corpus, "id", 1, lambda n: taken)[0].select("grp", F.col("vec").cast("array<double>").alias("vec")).toArrow()
        return {"probes": as_matrix(rows.column("vec")), "probe_groups": np.array(rows.column("grp").to_pylist(), dtype=object)}

    def assign(self, rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()),
                               T.StructField("radius", T.DoubleType())])
        if self.balls is None:
            return rows.mapInArrow(_assign(self._centres), schema)
        schema = schema.add("part", T.IntegerType()).add("part_radius", T.DoubleType()).add("group_radius", T.DoubleType())
        return rows.mapInArrow(_assign_down(self._centres), schema)

    def copies(self, k: int, exclude_group: bool = False) -> float:
        """Copies of a row that a self-join for the k nearest sends through the shuffle, on average."""
        member = _struct_of(self.corpus.schema, [T.StructField("bound", T.DoubleType())])
        routed = self._routed(self._blocks, self._cells, k, exclude_group, True, member)
        return routed.agg(F.sum(F.size("pack"))).first()[0] / self.size

    def _routed(self, packs: DataFrame, cells: Broadcast, k: int | None,
                exclude: bool, self_join: bool, member: T.StructType) -> DataFrame:
        routed_schema = T.StructType([
            T.StructField("cell", T.IntegerType()), T.StructField("sub", T.IntegerType()),
            T.StructField("home", T.BooleanType()),
            T.StructField("pack", T.ArrayType(member))])
        return packs.mapInArrow(_route(cells, k, exclude, self_join, self.tile,
                                       self.layout.probe_cells if k else None), routed_schema)

    def _meet(self, packs: DataFrame, blocks: DataFrame, cells: Broadcast, k: int | None,
              exclude: bool, self_join: bool, member: T.StructType) -> DataFrame:
        routed = self._routed(packs, cells, k, exclude, self_join, member)
        # Sort-merge: rows are megabytes, sizes are unknown to the planner, and adaptive
        # execution can split a block that very many packs are sent to.
        return routed.hint("merge").join(blocks, ["cell", "sub"], "left")

    def _query_packs(self, queries: DataFrame, columns: list[str]) -> DataFrame:
        placed = written(self.assign(queries), "queries")
        return _pack(placed, self._block_counts(placed), columns)

    def _block_counts(self, placed: DataFrame) -> np.ndarray:
        """Blocks needed per cell."""
        blocks = np.zeros(len(self.pivots), np.int64)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            blocks[r["cell"]] = r["n"]
        length = self.layout.block_rows_for(self.pivots.shape[1], int(blocks.sum()))
        return np.ceil(blocks / length).astype(np.int64)

    def nearest(self, k: int, queries: DataFrame | None = None,
                exclude_group: bool = False) -> DataFrame:
        """Edges ``id, grp, nb_id, nb_grp, score, rank``; one edge with null neighbour and
        rank 1 for a row that has none. Without ``queries`` the corpus is matched with itself.
        """
        if k < 1:
            raise ValueError("k must be positive")
        self_join = queries is None
        schema = self.corpus.schema if self_join else queries.select("id", "grp", "vec").schema
        packs = blocks = self._blocks
        if not self_join:
            packs = self._query_packs(queries.select(*MEMBER), list(MEMBER))
        member = _struct_of(schema, [T.StructField("bound", T.DoubleType())])
        joined = self._meet(packs, blocks, self._cells, k, exclude_group, self_join, member)
        own, other = schema, self.corpus.schema
        edge_schema = T.StructType([
            T.StructField("id", own["id"].dataType), T.StructField("grp", own["grp"].dataType),
            T.StructField("nb_id", other["id"].dataType),
            T.StructField("nb_grp", other["grp"].dataType),
            T.StructField("score", T.DoubleType())])
        edges = (joined.select("home", "pack", "rows")
                 .mapInArrow(_nearest(self.metric, k, exclude_group, self.tile), edge_schema))
        by_row = Window.partitionBy("id").orderBy(F.col("score").asc_nulls_last(), "nb_id")
        return (edges.withColumn("rank", F.row_number().over(by_row))
                .filter(F.col("rank") <= k)
                .filter(F.col("nb_id").isNotNull() | (F.col("rank") == 1)))

    def beaten_by(self, queries: DataFrame) -> DataFrame:
        """(id, n): how many corpus rows of other groups beat each query's ``bound``.

        ``queries`` has ``id, grp, vec, bound, best_id``; equal scores go to the smaller id.
        """
        columns = ["id", "grp", "vec", "bound", "best_id"]
        packs = self._query_packs(queries.select(*columns), columns)
        member = _struct_of(queries.schema, [
            T.StructField("bound", T.DoubleType()),
            T.StructField("best_id", queries.schema["best_id"].dataType)])
        joined = self._meet(packs, self._blocks, self._cells, None, True, False, member)
        out = T.StructType([T.StructField("id", queries.schema["id"].dataType),
                            T.StructField("n", T.LongType())])
        return (joined.select("pack", "rows").mapInArrow(_better(self.metric), out)
                .groupBy("id").agg(F.sum("n").alias("n")))


def candidate_rows(df: DataFrame, item: str, entity: str, vector: str | Column) -> DataFrame:
    vec = F.col(vector) if isinstance(vector, str) else vector
    return df.select(F.col(item).alias("id"), F.col(entity).alias("grp"), vec.alias("vec"))
