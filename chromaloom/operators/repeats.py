"""Replication error: a repeat round images the bin of its own readout again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.scalar import euclid
from chromaloom.session import checked_broadcast

from .stats import exact_quantiles

PLACES = ("y_um", "x_um", "z_um")


def _side(polymer: DataFrame, slots: DataFrame, datatype: str, prefix: str) -> DataFrame:
    named = slots.where(F.col("datatype") == datatype).select("slot", F.col("readout_id").alias(f"{prefix}_rid"))
    return polymer.join(checked_broadcast(named), "slot").select("fov", "cell", "allele_id", f"{prefix}_rid", *[F.col(c).alias(f"{prefix}_{c}") for c in PLACES])


def repeat_distances(polymer: DataFrame, slots: DataFrame, dims: str = "xyz") -> DataFrame:
    """(readout_id, same, d): every allele's distance from a repeated bin to its repeat (same) and,
    as the null it has to beat, to each of its other bins.

    slots(slot, readout_id, datatype): H bins and R rounds pair by readout id, whatever slots they
    lie in. Both kinds of distance use the same axes. An allele has one position per slot, so the
    null has at most one row per (allele, repeated bin, bin).
    """
    keys = ["fov", "cell", "allele_id"]
    bins, again = _side(polymer, slots, "H", "a"), _side(polymer, slots, "R", "b")
    same = bins.join(again, [*keys]).where("a_rid = b_rid").select(F.col("a_rid").alias("readout_id"), F.lit(True).alias("same"), euclid(dims, "a_", "b_").alias("d"))
    repeated = slots.where("datatype = 'R'").select(F.col("readout_id").alias("a_rid")).distinct()
    other = _side(polymer, slots, "H", "b")
    null = bins.join(checked_broadcast(repeated), "a_rid").join(other, [*keys]).where("a_rid <> b_rid").select(
        F.col("a_rid").alias("readout_id"), F.lit(False).alias("same"), euclid(dims, "a_", "b_").alias("d"))
    return same.unionByName(null)


def repeat_report(distances: DataFrame) -> DataFrame:
    """(readout_id, n, median_um, n_null, null_median_um, beats_null) per repeated readout.

    A repeat no closer than unrelated bins replicates nothing.
    """
    q = exact_quantiles(distances, ["readout_id", "same"], "d", {"m": 0.5})
    wide = q.groupBy("readout_id").agg(
        F.coalesce(F.max(F.when(F.col("same"), F.col("n"))), F.lit(0)).alias("n"), F.max(F.when(F.col("same"), F.col("m"))).alias("median_um"),
        F.coalesce(F.max(F.when(~F.col("same"), F.col("n"))), F.lit(0)).alias("n_null"), F.max(F.when(~F.col("same"), F.col("m"))).alias("null_median_um"))
    return wide.withColumn("beats_null", F.col("median_um") < F.col("null_median_um"))
