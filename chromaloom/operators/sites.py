"""Allele sites in a cell: the places several different bins agree on.

Points shuffle once, by cell, and support and greedy picks of all cells of a task are taken
together (`blocks.py`). For cells above `kernel_points` picking runs in rounds over the table: a
round takes the best remaining point of every cell in one aggregate and removes what lies within
its reach. The number of rounds is the site cap, a fixed small number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.session import cut

from .blocks import KERNEL_POINTS, Cells, batch, over_cells
from .distances import radius_support

# Fixed site parameters.
SITE_RADIUS_UM, SITE_FRACTION, MAX_SITES = 1.5, 0.24, 3
AXES = ("y_um", "x_um", "z_um")
KEYS = ["fov", "cell"]


def min_site_bins(n_slots: int) -> int:
    return max(2, round(SITE_FRACTION * n_slots))


def pick_sites(points: DataFrame, order: Column, radius: float, rounds: int) -> DataFrame:
    """(fov, cell, site, point, position): up to `rounds` points, best first, none within `radius` of another."""
    best = F.max_by(F.struct("point", *AXES), order).alias("b")
    remaining, chosen = cut(points), None
    for k in range(rounds):
        taken = remaining.groupBy(*KEYS).agg(best).select(*KEYS, F.lit(k).alias("site"), *[F.col(f"b.{c}").alias(c) for c in ("point", *AXES)])
        chosen = taken if chosen is None else chosen.unionByName(taken)
        if k + 1 == rounds:
            break
        centre = taken.select(*KEYS, *[F.col(a).alias(f"t_{a}") for a in AXES])
        gap = F.sqrt(sum((F.pow(F.col(a) - F.col(f"t_{a}"), F.lit(2.0)) for a in AXES[1:]), F.pow(F.col("y_um") - F.col("t_y_um"), F.lit(2.0))))
        remaining = cut(remaining.join(centre, KEYS).where(gap > F.lit(float(radius))).select(*points.columns))
    return chosen


def supported(points: DataFrame, radius: float, min_bins: int) -> DataFrame:
    support = radius_support(points, radius)
    return points.join(support, [*KEYS, "point"]).where(F.col("support") >= min_bins)


def spatial_multiplicity(points: DataFrame, n_slots: int, radius: float = SITE_RADIUS_UM, max_sites: int = MAX_SITES,
                         min_bins: int | None = None, kernel_points: int = KERNEL_POINTS) -> DataFrame:
    """(fov, cell, k): how many well-supported places a cell has, 0 when it has none."""
    least = min_bins or min_site_bins(n_slots)

    def kernel(rows):
        cells = Cells(rows, "bin")
        support = cells.support(cells.placed, radius)
        taken = cells.picks(cells.placed & (support >= least), [support], radius, max_sites)
        first = pa.array(cells.first)
        return batch([*[rows.column(c).take(first) for c in KEYS], pa.array((taken >= 0).sum(0))], [*KEYS, "k"])

    def in_rounds(part: DataFrame) -> DataFrame:
        good = supported(part, radius, least)
        sites = pick_sites(good, F.struct(F.col("support"), -F.col("point")), radius, max_sites)
        found = sites.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"))
        return part.select(*KEYS).distinct().join(found, KEYS, "left").select(*KEYS, F.coalesce("k", F.lit(0)).alias("k"))

    schema = points.select(*KEYS).schema.add("k", "long")
    return over_cells(points, kernel, schema, [*KEYS, "point", "bin", *AXES], in_rounds, kernel_points)


def seeds(points: DataFrame, k: int, radius: float, min_bins: int, kernel_points: int = KERNEL_POINTS) -> DataFrame:
    """Seed points by support, then by distance from the cell's centroid."""
    def kernel(rows):
        cells = Cells(rows, "bin")
        taken = cells.seeds(cells.placed, radius, min_bins, k, np.ones(len(cells.cell), bool))
        site, cell = np.nonzero(taken >= 0)
        at = pa.array(taken[site, cell])
        return batch([*[rows.column(c).take(at) for c in KEYS], pa.array(site, pa.int32()), *[rows.column(c).take(at) for c in ("point", *AXES)]],
                     [*KEYS, "site", "point", *AXES])

    def in_rounds(part: DataFrame) -> DataFrame:
        centre = part.groupBy(*KEYS).agg(*[F.avg(a).alias(f"c_{a}") for a in AXES])
        good = supported(part, radius, min_bins).join(centre, KEYS)
        far = F.round(F.sqrt(sum((F.pow(F.col(a) - F.col(f"c_{a}"), F.lit(2.0)) for a in AXES[1:]), F.pow(F.col("y_um") - F.col("c_y_um"), F.lit(2.0)))), 9)
        return pick_sites(good.withColumn("far", far), F.struct(F.col("support"), F.col("far"), -F.col("point")), radius, k)

    kinds = points.select(*KEYS, F.lit(0).alias("site"), "point", *AXES).schema
    return over_cells(points, kernel, kinds, [*KEYS, "point", "bin", *AXES], in_rounds, kernel_points)


def nearest_site(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Each point's closest site of its cell; at most MAX_SITES candidates per point."""
    s = sites.select(*KEYS, "site", *[F.col(a).alias(f"s_{a}") for a in AXES])
    gap = F.sqrt(sum((F.pow(F.col(a) - F.col(f"s_{a}"), F.lit(2.0)) for a in AXES[1:]), F.pow(F.col("y_um") - F.col("s_y_um"), F.lit(2.0))))
    return points.join(s, KEYS).groupBy(*KEYS, "point").agg(
        F.min_by("site", F.struct(gap, F.col("site"))).alias("site"), F.min(gap).alias("distance"))
