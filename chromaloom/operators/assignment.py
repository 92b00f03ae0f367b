"""Spots to cells by mask membership, and segmentation quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.scalar import VOXEL_UM, reduce_any, safe_div
from chromaloom.session import checked_broadcast

from .stats import exact_quantiles

# Fixed segmentation thresholds.
SMALL_REL, LARGE_REL, IRREGULAR_SOLIDITY, DIM_Z, BRIGHT_Z, BORDER_PX = 0.5, 2.0, 0.9, -1.5, 3.0, 5
FLAGS = ("small", "large", "irregular", "dim", "bright", "border")


def owner_pixels(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(fov, y, x, owner): the last cell wins where masks overlap."""
    return pixels.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width)).groupBy(
        "fov", "y", "x").agg(F.max("cell").alias("owner"))


def assign_spots(spots: DataFrame, pixels: DataFrame, height: int, width: int) -> DataFrame:
    """spots plus `owner` (-1 outside every mask); raw coordinates are truncated to pixels."""
    owners = owner_pixels(pixels, height, width)
    at = spots.withColumns({"y": F.col("raw_y").cast("int"), "x": F.col("raw_x").cast("int")})
    return at.join(owners, ["fov", "y", "x"], "left").withColumn("owner", F.coalesce("owner", F.lit(-1).cast("long"))).drop("y", "x")


def mask_stats(pixels: DataFrame, voxel_um=VOXEL_UM) -> DataFrame:
    """Per cell: pixel count, area, centroid and extent of its mask."""
    return pixels.groupBy("fov", "cell").agg(
        F.count(F.lit(1)).alias("px"), (F.count(F.lit(1)) * F.lit(voxel_um[0] * voxel_um[1])).alias("um2"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def segmentation_flags(measured: DataFrame, height: int, width: int) -> DataFrame:
    """Per-FOV relative area and stain z-score, and the six quality flags.

    FOV statistics are aggregated and joined back; no window ever holds a FOV.
    """
    med = exact_quantiles(measured, ["fov"], "area", {"med": 0.5}).drop("n")
    moments = measured.groupBy("fov").agg(F.avg("mean_stain").alias("mu"), F.stddev_pop("mean_stain").alias("sd"))
    # an all-zero median divides by one instead
    scale = F.when(F.col("med") == 0, F.lit(1.0)).otherwise(F.col("med"))
    z = F.when(F.col("sd") > 0, safe_div(F.col("mean_stain") - F.col("mu"), "sd")).otherwise(F.lit(0.0))
    rel = measured.join(checked_broadcast(moments.join(med, "fov")), "fov").withColumns({"area_rel": F.col("area") / scale, "stain_z": z})
    border = ((F.col("min_y") < BORDER_PX) | (F.col("min_x") < BORDER_PX)
              | (F.col("max_y") >= height - BORDER_PX) | (F.col("max_x") >= width - BORDER_PX))
    return rel.withColumns({
        "small": F.col("area_rel") < SMALL_REL, "large": F.col("area_rel") > LARGE_REL,
        "irregular": F.col("solidity") < IRREGULAR_SOLIDITY, "dim": F.col("stain_z") < DIM_Z,
        "bright": F.col("stain_z") > BRIGHT_Z, "border": border}).drop("mu", "sd", "med")


def drop_flagged(flagged: DataFrame, names: str | list[str]) -> DataFrame:
    wanted = [n.strip() for n in names.split(",") if n.strip()] if isinstance(names, str) else list(names)
    unknown = [n for n in wanted if n not in FLAGS]
    if unknown:
        raise ValueError(f"unknown cell flags {unknown}; known: {FLAGS}")
    return flagged.where(~reduce_any([F.col(n) for n in wanted]))
