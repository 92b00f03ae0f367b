"""Flat export tables: spots, cells, alleles (long) and the combined sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import affine
from chromaloom.functions.scalar import VOXEL_UM, fov_key, from_learned_engine, z_status
from chromaloom.session import checked_broadcast

# Fixed column lists of the compact combined sheet.
COMBINED_SPOT = ("spot_key", "fov", "modality", "hybe", "readout_name", "readout_id", "channel_role", "cell",
                 "cell_key", "celltype", "uid", "adj_x_um", "adj_y_um", "adj_z_um", "p_exist")
COMBINED_CELL = ("nucleus_um2", "n_spots_readout", "touches_frame_edge")
COMBINED_SHARED = ("fov", "cell", "celltype", "cell_key")
SELECTED_TOL = 0.01


def cell_key() -> Column:
    return F.when(F.col("cell") < 0, F.lit("")).otherwise(fov_key("fov", "C", "cell"))


def scaled(prefix: str, voxel_um=VOXEL_UM) -> list[Column]:
    return [(F.col(f"{prefix}_{a}") * F.lit(v)).alias(f"{prefix}_{a}_um") for a, v in zip(("y", "x", "z"), voxel_um)]


def spot_rows(spots: DataFrame, cells: DataFrame, layout: DataFrame, extras: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per spot, homeless ones included; the cell's own celltype wins.

    `carry` names further columns of `cells` that its spots keep, behind all others.

    Homeless rows skip the cell join: they are split off by the join key being
    NULL, so the one key that holds most rows is never shuffled to one task.
    """
    key = F.when(F.col("cell") >= 0, F.col("cell"))
    carry = carry or []
    names = cells.select(F.col("fov").alias("__f"), F.col("cell").alias("__c"), F.col("celltype").alias("__ct"), *carry)
    lay = layout.select("modality", "hybe", "readout_name", "datatype", "readout_id", "fiducial_channel")
    joined = spots.withColumn("__k", key).join(checked_broadcast(lay), ["modality", "hybe"], "left")
    housed = joined.where(F.col("__k").isNotNull()).join(
        names, (F.col("fov") == F.col("__f")) & (F.col("__k") == F.col("__c")), "left")
    homeless = joined.where(F.col("__k").isNull()).withColumns({
        c.name: F.lit(None).cast(c.dataType) for c in names.schema})
    both = housed.unionByName(homeless)
    own = F.col("celltype") if "celltype" in spots.columns else F.lit("")
    role = F.when(F.col("fiducial_channel").isNull(), "").when(F.col("fiducial_channel") == F.col("channel"), "fiducial").otherwise("readout")
    adj = [F.col(f"adj_{a}") if f"adj_{a}" in spots.columns else F.col(f"raw_{a}").alias(f"adj_{a}") for a in ("y", "x", "z")]
    out = both.select(
        fov_key("fov", "U", "uid").alias("spot_key"), "fov", "modality", "hybe",
        F.coalesce("readout_name", F.lit("")).alias("readout_name"), F.coalesce("datatype", F.lit("")).alias("datatype"),
        F.coalesce("readout_id", F.lit(-1)).alias("readout_id"), "channel", role.alias("channel_role"), "cell",
        cell_key().alias("cell_key"), F.coalesce("__ct", own).alias("celltype"), "uid", "raw_x", "raw_y", "raw_z", *adj,
        "brightness", "p_exist", z_status("z_status").alias("z_status"),
        F.when(from_learned_engine("p_exist", "z_status"), "learned").otherwise("").alias("engine"), *(extras or []), *carry)
    return out.select(*[c for c in out.columns if c not in carry], *scaled("raw"), *scaled("adj"), *carry)


def per_cell_counts(spot_sheet: DataFrame) -> DataFrame:
    """(fov, cell, n_spots, n_spots_readout)."""
    return spot_sheet.where(F.col("cell") >= 0).groupBy("fov", "cell").agg(
        F.count(F.lit(1)).alias("n_spots"), F.sum((F.col("channel_role") == "readout").cast("long")).alias("n_spots_readout"))


def touches_edge(height: int, width: int) -> Column:
    """NULL when the cell has no mask."""
    return (F.col("min_x") <= 0) | (F.col("min_y") <= 0) | (F.col("max_x") >= width - 1) | (F.col("max_y") >= height - 1)


def cell_rows(cells: DataFrame, nucleus: DataFrame, spot_counts: DataFrame, allele_counts: DataFrame,
              placements: DataFrame, frame_shape: tuple[int, int], home: DataFrame | None = None) -> DataFrame:
    """One row per cell: mask statistics, counts, home transform parts and cycle columns."""
    keys = ["fov", "cell"]
    stats = nucleus.select(*keys, F.col("px").alias("nucleus_px"), F.col("um2").alias("nucleus_um2"),
                           F.col("centroid_x").alias("nucleus_centroid_x"), F.col("centroid_y").alias("nucleus_centroid_y"),
                           "min_x", "max_x", "min_y", "max_y")
    cyc = placements.select(*keys, *[F.col(c).alias(f"cellcycle_{c}") for c in placements.columns if c not in keys])
    out = cells.join(stats, keys, "left").join(spot_counts, keys, "left").join(allele_counts, keys, "left").join(cyc, keys, "left")
    parts = []
    if home is not None:
        out = out.join(home.select(*keys, F.col("h").alias("__h"), F.col("dz").alias("home_dz")), keys, "left")
        parts = [affine.of("__h").theta_deg().alias("home_yx_theta_deg"), F.col("__h.xt").alias("home_yx_dx"),
                 F.col("__h.yt").alias("home_yx_dy"), affine.of("__h").scale().alias("home_yx_scale"), "home_dz"]
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_spots", "n_spots_readout", "n_alleles")]
    known = {"fov", "cell", "celltype"}
    return out.select(
        cell_key().alias("cell_key"), *keys, "celltype", F.coalesce("nucleus_px", F.lit(0)).alias("nucleus_px"), "nucleus_um2",
        "nucleus_centroid_x", "nucleus_centroid_y", (F.col("nucleus_centroid_x") * VOXEL_UM[1]).alias("nucleus_centroid_x_um"),
        (F.col("nucleus_centroid_y") * VOXEL_UM[0]).alias("nucleus_centroid_y_um"),
        touches_edge(*frame_shape).alias("touches_frame_edge"), *counts, *parts,
        *[c for c in cyc.columns if c not in keys], *[c for c in cells.columns if c not in known])


def allele_rows(alleles: DataFrame, candidates: DataFrame, polymer: DataFrame, n_slots: int, cells: DataFrame,
                voxel_um=VOXEL_UM) -> DataFrame:
    """Long rows (allele, slot, candidate); an empty slot keeps one row with candidate_index -1.

    alleles has one row per allele. candidate_index counts the candidates of one bin in stored
    order; the windows cover one (allele, slot). The parts are stacked and told apart inside a
    bin, so candidates and polymer that are dealt by allele are not dealt again, and an allele
    gets its celltype and its place before it gets its slots.
    """
    from pyspark.sql import Window

    own = alleles.select("fov", "cell", "allele_id")
    # (fov, cell) lookup of the celltype; homeless alleles have none and skip it
    named = own.where(F.col("cell") >= 0).join(cells.select("fov", "cell", "celltype"), ["fov", "cell"], "left").unionByName(
        own.where(F.col("cell") < 0).withColumn("celltype", F.lit(None).cast("string")))
    grid = named.where("allele_id is not null").repartition("allele_id").select(
        "allele_id", F.struct("fov", "cell", "celltype").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long"))).alias("slot"))
    found = candidates.select("allele_id", F.col("slot").cast("long").alias("slot"), "cand", F.struct(
        F.col("x").alias("readout_adj_x"), F.col("y").alias("readout_adj_y"), F.col("z").alias("readout_adj_z"),
        F.col("amplitude").alias("readout_adj_amplitude"), F.col("quality").alias("readout_quality")).alias("at"))
    final = polymer.select("allele_id", F.col("slot").cast("long").alias("slot"), F.struct(
        "n_cand", F.col("x_um").alias("final_x_um"), F.col("y_um").alias("final_y_um"), F.col("z_um").alias("final_z_um")).alias("final"))
    stacked = found.unionByName(final, allowMissingColumns=True).unionByName(grid, allowMissingColumns=True)
    w = Window.partitionBy("allele_id", "slot")
    told = stacked.select(
        "allele_id", "slot", "at", (F.row_number().over(w.orderBy(F.col("at").isNull(), "cand")) - 1).alias("__r"),
        F.first("own", ignorenulls=True).over(w).alias("own"), F.first("final", ignorenulls=True).over(w).alias("final"))
    joined = told.where("own is not null and (at is not null or __r = 0)").select(
        "allele_id", F.col("slot").cast("int").alias("slot"), F.when(F.col("at").isNotNull(), F.col("__r")).alias("k"), "own.*", "final.*", "at.*")
    near = None
    for a, v in zip(("y", "x", "z"), voxel_um):
        close = F.abs(F.col(f"readout_adj_{a}") - F.col(f"final_{a}_um") / F.lit(v)) <= SELECTED_TOL
        near = close if near is None else near & close
    return joined.select(
        fov_key("fov", "A", "allele_id").alias("allele_key"), "allele_id", "fov", "cell", cell_key().alias("cell_key"),
        F.coalesce("celltype", F.lit("")).alias("celltype"), F.col("slot").alias("bin_index"),
        F.coalesce("k", F.lit(-1)).alias("candidate_index"), F.coalesce("n_cand", F.lit(0)).alias("n_candidates"),
        F.coalesce(near, F.lit(False)).alias("is_selected"), "readout_adj_x", "readout_adj_y", "readout_adj_z",
        "readout_adj_amplitude", "readout_quality", "final_x_um", "final_y_um", "final_z_um")


def combined_rows(spot_sheet: DataFrame, cell_sheet: DataFrame, declared_spot: list[str], declared_cell: list[str],
                  compact: bool = True, prefix: str = "cell_") -> DataFrame:
    """One row per spot with its cell's columns; homeless spots keep blanks.

    Compact keeps the key columns, two cell summaries and every undeclared field.
    """
    if compact:
        spot_cols = [c for c in spot_sheet.columns if c in COMBINED_SPOT or c not in declared_spot]
        cell_cols = [c for c in cell_sheet.columns if c in COMBINED_CELL or c not in declared_cell]
    else:
        spot_cols, cell_cols = spot_sheet.columns, cell_sheet.columns
    cell_cols = [c for c in cell_cols if c not in COMBINED_SHARED]
    right = cell_sheet.select(F.col("cell_key").alias("__ck"), *[F.col(c).alias(f"{prefix}{c}") for c in cell_cols])
    left = spot_sheet.select(*spot_cols)
    housed = left.where(F.col("cell_key") != "").join(right, F.col("cell_key") == F.col("__ck"), "left").drop("__ck")
    blanks = left.where(F.col("cell_key") == "")
    return housed.unionByName(blanks, allowMissingColumns=True)


def combined_sheet(spots: DataFrame, layout: DataFrame, cell_sheet: DataFrame, keep_cell: list[str], prefix: str = "cell_") -> DataFrame:
    """The spot sheet with the named columns of its cells, as `combined_rows` of both sheets gives it.

    A cell's celltype and its columns come to a spot in one join on (fov, cell).
    """
    own = [c for c in keep_cell if c not in COMBINED_SHARED]
    cells = cell_sheet.select("fov", "cell", "celltype", *[F.col(c).alias(f"{prefix}{c}") for c in own])
    return spot_rows(spots, cells, layout, carry=[f"{prefix}{c}" for c in own])
