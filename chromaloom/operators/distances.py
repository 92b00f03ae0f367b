"""Within-cell distances between two spot (or traced-bin) sources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.scalar import TRACED, UNASSIGNED, USABLE_Z, closed_bin, euclid

from .blocks import AXES, KERNEL_POINTS, Cells, batch, over_cells
from .pairs import group_pairs
from .stats import group_quantiles

KEYS = ["fov", "cell"]


def is_traced(source) -> bool:
    return str(source[2]) == TRACED


def spot_points(spots: DataFrame, source, dims: str = "xyz") -> DataFrame:
    """Spots of a (modality, hybe, channel) source usable at this dimensionality.

    None as hybe or channel takes the whole modality. Homeless spots leave here,
    before any shuffle.
    """
    modality, hybe, channel = source
    rows = spots.where((F.col("modality") == modality) & F.col("z_status").isin(*USABLE_Z[dims]) & (F.col("cell") >= 0))
    if hybe is not None:
        rows = rows.where(F.col("hybe") == hybe)
    if channel is not None:
        rows = rows.where(F.col("channel") == int(channel))
    return rows.select(*KEYS, F.col("uid").alias("point"), "y_um", "x_um", "z_um")


def traced_points(polymer: DataFrame, slot: int) -> DataFrame:
    """One point per allele: where its trace puts the bin `slot`."""
    return polymer.where((F.col("slot") == int(slot)) & (F.col("cell") >= 0)).select(
        *KEYS, F.col("allele_id").alias("point"), "y_um", "x_um", "z_um")


def points_of(source, spots: DataFrame | None = None, polymer: DataFrame | None = None, dims: str = "xyz",
              slot_of: dict[str, int] | None = None, traced_modality: str | None = None) -> DataFrame:
    if not is_traced(source):
        return spot_points(spots, source, dims)
    if traced_modality and source[0] != traced_modality:
        raise ValueError(f"traced sources must name {traced_modality}, not {source[0]}")
    if source[1] not in (slot_of or {}):
        raise ValueError(f"{source[1]} is not a traced bin")
    return traced_points(polymer, slot_of[source[1]])


def pair_distances(a: DataFrame, b: DataFrame | None = None, dims: str = "xyz") -> DataFrame:
    """(fov, cell, point_a, point_b, d_um); `b` None pairs a source with itself, each pair once."""
    def side(points, s):
        return points.select(*KEYS, F.col("point").alias(f"point_{s}"), F.col("y_um").alias(f"{s}_y_um"),
                             F.col("x_um").alias(f"{s}_x_um"), F.col("z_um").alias(f"{s}_z_um"))

    once = None if b is not None else F.col("point_a") < F.col("point_b")
    pairs = group_pairs(side(a, "a"), side(a if b is None else b, "b"), KEYS, "point_a", once)
    return pairs.select(*KEYS, "point_a", "point_b", euclid(dims, "a_", "b_").alias("d_um"))


def pair_counts(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(fov, cell, n): an upper bound on a cell's pairs, without forming them."""
    na = a.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("na"))
    if b is None:
        return na.select(*KEYS, (F.col("na").cast("double") * F.col("na")).alias("n"))
    nb = b.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("nb"))
    return na.join(nb, KEYS).select(*KEYS, (F.col("na").cast("double") * F.col("nb")).alias("n"))


def per_cell(a: DataFrame, b: DataFrame | None = None, collapse: str = "median", dims: str = "xyz") -> DataFrame:
    """(fov, cell, n, d_um): the collapsed distance of every cell that has a pair."""
    pairs = pair_distances(a, b, dims)
    if collapse == "median":
        return group_quantiles(pairs, KEYS, "d_um", {"d_um_q": 0.5}, pair_counts(a, b)).withColumnRenamed("d_um_q", "d_um")
    how = {"mean": F.avg, "min": F.min}[collapse]
    return pairs.groupBy(*KEYS).agg(F.count("d_um").alias("n"), how("d_um").alias("d_um"))


def histogram(pairs: DataFrame, lo: float, hi: float, bins: int, gate: DataFrame | None = None,
              cells: DataFrame | None = None) -> DataFrame:
    """Counts per fixed bin, optionally per celltype, over the gated cells."""
    if gate is not None:
        pairs = pairs.join(gate.select(*KEYS), KEYS, "left_semi")
    binned = pairs.withColumn("bin", closed_bin("d_um", lo, hi, bins)).where(F.col("bin").isNotNull())
    if cells is None:
        return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # counted per cell first: the join carries one row per (cell, bin), not per pair
    per = binned.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("k"))
    label = F.when(F.coalesce(F.col("celltype"), F.lit("")) == "", UNASSIGNED).otherwise(F.col("celltype"))
    return (per.join(cells.select(*KEYS, "celltype"), KEYS, "left")
            .groupBy(label.alias("celltype"), "bin").agg(F.sum("k").alias("n")))


def radius_support(points: DataFrame, radius: float, bin_col: str = "bin", kernel_points: int = KERNEL_POINTS) -> DataFrame:
    """Distinct bins within `radius` of each point of its cell, itself included."""
    from .pairs import radius_neighbours

    def kernel(rows):
        cells = Cells(rows, bin_col)
        near = pa.array(np.flatnonzero(cells.placed))
        found = cells.support(cells.placed, radius)[cells.placed]
        return batch([*[rows.column(c).take(near) for c in (*KEYS, "point")], pa.array(found)], [*KEYS, "point", "support"])

    def joined(part: DataFrame) -> DataFrame:
        near = radius_neighbours(part, KEYS, ["y_um", "x_um", "z_um"], radius, "point")
        bins = part.select(*KEYS, F.col("point").alias("other"), bin_col)
        return (near.join(bins, [*KEYS, "other"]).groupBy(*KEYS, "point")
                .agg(F.count_distinct(bin_col).alias("support")))

    schema = points.select(*KEYS, "point").schema.add("support", "long")
    return over_cells(points, kernel, schema, [*KEYS, "point", bin_col, *AXES], joined, kernel_points)
