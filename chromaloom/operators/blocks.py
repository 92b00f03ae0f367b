"""Whole cells side by side in a task: neighbour support, greedy picks and Lloyd passes.

Points shuffle once, by cell. A task takes the rows of many cells together, so a step is one NumPy
pass over all of them. A cell above `kernel_points` never enters a task: it takes the joins and
rounds over the table, under the same rule and with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import cut

from .paths import cell_bounds, whole_cells

KEYS, AXES = ["fov", "cell"], ("y_um", "x_um", "z_um")
KERNEL_POINTS = 2_000      # points of a cell that one task may compare with each other


def valid(column) -> np.ndarray:
    return column.is_valid().to_numpy()


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a - b) ** 2
    return np.sqrt(d[:, 0] + d[:, 1] + d[:, 2])


class Cells:
    """Rows (fov, cell, point, bin, y_um, x_um, z_um) of whole cells, sorted by cell.

    A row without an id, or without a finite place, is near nothing.
    """

    def __init__(self, rows: pa.Table, bin_col: str):
        self.rows = rows
        self.first, end = cell_bounds(rows)
        self.cell = np.repeat(np.arange(len(self.first)), end - self.first)
        self.ids = rows.column("point").fill_null(-1).to_numpy()
        self.xyz = np.column_stack([rows.column(a).cast(pa.float64()).fill_null(np.nan).to_numpy() for a in AXES])
        self.placed = valid(rows.column("point")) & np.isfinite(self.xyz).all(1)
        codes = rows.column(bin_col).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.lexsort((codes, self.cell))
        new = np.concatenate([[True], (np.diff(codes[order]) != 0) | (np.diff(self.cell[order]) != 0)]) if len(order) else np.zeros(0, bool)
        rank = np.empty(len(order), int)
        rank[order] = np.cumsum(new) - 1
        # numbered anew in every cell, so a cell's set of bins is a few words
        rank -= np.minimum.reduceat(rank, self.first)[self.cell]
        self.word, self.bit = rank // 64, np.where(codes >= 0, np.uint64(1) << (rank % 64).astype(np.uint64), np.uint64(0))
        self.words = int(rank.max(initial=0)) // 64 + 1

    def pairs(self, live: np.ndarray, radius: float):
        """Pairs of live rows of a cell within the radius; those 1, 2, ... live rows apart in turn."""
        rows = np.flatnonzero(live)
        cell = self.cell[rows]
        left = np.searchsorted(cell, cell, side="right") - np.arange(len(rows)) - 1
        a, apart = np.flatnonzero(left >= 1), 1
        while len(a):
            i, j = rows[a], rows[a + apart]
            near = gaps(self.xyz[i], self.xyz[j]) <= radius
            yield i[near], j[near]
            apart += 1
            a = a[left[a] >= apart]

    def support(self, live: np.ndarray, radius: float) -> np.ndarray:
        """Distinct bins within the radius of each live row, its own included."""
        seen = np.zeros((len(self.cell), self.words), np.uint64)
        own = np.flatnonzero(live)
        seen[own, self.word[own]] = self.bit[own]
        for i, j in self.pairs(live, radius):
            seen[i, self.word[j]] |= self.bit[j]
            seen[j, self.word[i]] |= self.bit[i]
        return np.bitwise_count(seen).sum(1, dtype=np.int64)

    def mean(self, group: np.ndarray, n: int, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean place per group over the rows `take`, and their number; empty places do not count."""
        out, size = np.full((n, 3), np.nan), np.bincount(group[take], minlength=n)
        for k, a in enumerate(AXES):
            rows = np.flatnonzero(take & valid(self.rows.column(a)))
            count = np.bincount(group[rows], minlength=n)
            np.divide(np.bincount(group[rows], self.xyz[rows, k], n), count, out=out[:, k], where=count > 0)
        return out, size

    def picks(self, live: np.ndarray, keys: list[np.ndarray], radius: float, rounds: int) -> np.ndarray:
        """(rounds x cells) the row each round takes, -1 for none: largest keys first, then the smallest
        id; none within `radius` of one taken before."""
        n = len(self.cell)
        order = np.lexsort((self.ids, *[-k for k in reversed(keys)]))
        place = np.empty(n, int)
        place[order] = np.arange(n)
        free, out = live.copy(), np.full((rounds, len(self.first)), -1)
        for k in range(rounds):
            best = np.minimum.reduceat(np.where(free, place, n), self.first)
            out[k] = np.where(best < n, order[np.minimum(best, n - 1)], -1)
            at = out[k][self.cell]
            free &= (at >= 0) & (gaps(self.xyz, self.xyz[at]) > radius)
        return out

    def seeds(self, live: np.ndarray, radius: float, min_bins: int, rounds: int, among: np.ndarray) -> np.ndarray:
        """Picks by support, then by distance from the mean place of the rows `among`."""
        support = self.support(live, radius)
        middle, _ = self.mean(self.cell, len(self.first), among)
        far = np.round(gaps(self.xyz, middle[self.cell]), 9)
        return self.picks(live & (support >= min_bins), [support, far], radius, rounds)

    def lloyd(self, live: np.ndarray, seeds: np.ndarray, iters: int) -> tuple[np.ndarray, np.ndarray]:
        """Site of every live row of a cell with seeds, else -1, and the places (cells x sites x 3)."""
        k, n = seeds.shape
        centres = np.where((seeds >= 0).T[:, :, None], self.xyz[seeds.T], np.nan)
        rows = np.flatnonzero(live & (seeds[0] >= 0)[self.cell])
        xyz, cell, site = self.xyz[rows], self.cell[rows], np.full(len(rows), -1)
        for _ in range(iters if len(rows) else 0):
            to = np.stack([gaps(xyz, centres[cell, s]) for s in range(k)], 1)
            new = np.where(np.isnan(to), np.inf, to).argmin(1)
            if (new == site).all():
                break
            site = new
            group = cell * k + site
            count = np.bincount(group, minlength=n * k)
            for c in range(3):
                total = np.bincount(group, xyz[:, c], n * k)
                flat = centres[:, :, c].reshape(-1)
                centres[:, :, c] = np.where(count > 0, total / np.maximum(count, 1), flat).reshape(n, k)
        out = np.full(len(self.cell), -1)
        out[rows] = site
        return out, centres

    def bins_of(self, group: np.ndarray, n: int, take: np.ndarray) -> np.ndarray:
        """Distinct bins per group over the rows `take`; a group lies in one cell."""
        rows = np.flatnonzero(take & (self.bit > 0))
        rank = self.word[rows] * 64 + np.log2(self.bit[rows].astype(float)).astype(int)
        width = self.words * 64
        return np.bincount(np.unique(group[rows] * width + rank) // width, minlength=n)


def batch(schema: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in schema], names)


def over_cells(points: DataFrame, kernel: Callable, schema, columns: list[str], rounds: Callable, kernel_points: int = KERNEL_POINTS,
               beside: DataFrame | None = None) -> DataFrame:
    """`kernel` (table of whole cells -> record batch) over the cells up to `kernel_points`, `rounds` (points -> DataFrame)
    over the larger ones. Rows of `beside`, with the same columns, travel with their cell but do not count as points."""
    flat = points.select(*columns).where(" and ".join(f"{k} is not null" for k in KEYS))
    large = cut(flat.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > kernel_points).select(*KEYS))

    def block(batches):
        for rows in whole_cells(batches):
            yield kernel(rows)

    def settled(part: DataFrame) -> DataFrame:
        part = part if beside is None else part.unionByName(beside.select(*columns))
        return part.repartition(*KEYS).sortWithinPartitions(*KEYS, "point").mapInArrow(block, schema)

    if large.isEmpty():
        return settled(flat)
    # a cell of `beside` without points gives no row, so those of large cells need not leave it
    return settled(flat.join(large, KEYS, "left_anti")).unionByName(rounds(points.join(large, KEYS, "left_semi")))
