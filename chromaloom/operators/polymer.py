"""Polymer tables: candidate collapse, distance maps, quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.functions.scalar import VOXEL_UM, euclid
from chromaloom.session import cut

from .stats import exact_quantiles

ALLELE = ["fov", "cell", "allele_id"]
BRIGHTEST = ("amplitude", True)


def brightest_order() -> Column:
    """Rank key of the default selector: largest amplitude, then the first candidate."""
    return F.struct(F.col("amplitude"), -F.col("cand"))


def collapse(candidates: DataFrame, order: Column | None = None, voxel_um=VOXEL_UM) -> DataFrame:
    """One position per (allele, slot), um-scaled once, with its candidate count.

    The winner is an aggregate over an ordering struct, so a bin with many
    candidates is reduced before the shuffle; any ordering expression may be given.
    """
    order = brightest_order() if order is None else order
    best = F.max_by(F.struct("y", "x", "z", "amplitude", "quality", "cand"), order)
    # the allele leads: the sort of this aggregate tells most rows apart by its first key
    return candidates.groupBy("allele_id", "fov", "cell", "slot").agg(
        F.count(F.lit(1)).alias("n_cand"), best.alias("b")
    ).select(
        *ALLELE, "slot", "n_cand", (F.col("b.y") * voxel_um[0]).alias("y_um"), (F.col("b.x") * voxel_um[1]).alias("x_um"),
        (F.col("b.z") * voxel_um[2]).alias("z_um"), F.col("b.amplitude").alias("amp"), F.col("b.cand").alias("cand"))


def completeness(alleles: DataFrame, polymer: DataFrame) -> DataFrame:
    """Allele headers with n_traced; alleles without a single bin stay at 0."""
    traced = polymer.groupBy("allele_id").agg(F.count(F.lit(1)).alias("n_traced"))
    return alleles.join(traced, "allele_id", "left").withColumn("n_traced", F.coalesce("n_traced", F.lit(0)))


def efficacy(alleles: DataFrame, polymer: DataFrame, n_slots: int) -> DataFrame:
    """Fraction of alleles with each slot, over every slot of the axis."""
    # both sides are bounded by the axis length; the allele count is one value
    found = polymer.groupBy("slot").agg(F.count(F.lit(1)).alias("found"))
    total = alleles.select(F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot")).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_alleles"))
    return total.join(found, "slot", "left").select(
        "slot", "n_alleles", F.coalesce("found", F.lit(0)).alias("found"),
        (F.coalesce("found", F.lit(0)) / F.col("n_alleles")).alias("efficacy"))


def distance_maps(polymer: DataFrame, dims: str = "xyz", extra: list[Column] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(allele, bin_i < bin_j, d): the observed upper triangle of every allele's map.

    Pairs are bounded by the axis, and both sides read the same exchange on the allele.
    `carry` names further columns of the allele that its pairs keep.
    """
    own = [*ALLELE, *(carry or [])]

    def side(s):
        keep = [F.col(c).alias(f"{s}_{c}") for c in ("y_um", "x_um", "z_um")]
        return polymer.select(*(own if s == "a" else ["allele_id"]), F.col("slot").alias(f"bin_{'i' if s == 'a' else 'j'}"), *keep)

    joined = side("a").join(side("b"), "allele_id").where(F.col("bin_i") < F.col("bin_j"))
    return joined.select(*own, "bin_i", "bin_j", euclid(dims, "a_", "b_").alias("d"), *(extra or []))


def xy_and_xyz(polymer: DataFrame) -> DataFrame:
    """The same pairs measured in plane and in space."""
    return distance_maps(polymer, "xyz", [euclid("xy", "a_", "b_").alias("d_xy")]).withColumnRenamed("d", "d_xyz")


def slot_medians(polymer: DataFrame, dmaps: DataFrame) -> DataFrame:
    """(allele, slot, med): median distance of a bin to all observed bins, itself (0) included.

    Groups are bounded by the axis length, so the built-in median is safe.
    """
    ends = dmaps.select("allele_id", F.explode(F.array("bin_i", "bin_j")).alias("slot"), "d").unionByName(
        polymer.select("allele_id", "slot", F.lit(0.0).alias("d")))
    return ends.groupBy("allele_id", "slot").agg(F.median("d").alias("med"))


def qc_thresholds(polymer: DataFrame, dmaps: DataFrame, brightness=(0.05, 0.95), jump: float = 0.75,
                  max_dist: float = 0.95) -> DataFrame:
    """One row of thresholds; no data gives the open bound."""
    # a quantile passes over its values twice: what is measured from positions is kept as distances
    dmaps = cut(dmaps.select("allele_id", "bin_i", "bin_j", "d"))
    med = cut(slot_medians(polymer, dmaps).select("med"))
    amp = exact_quantiles(polymer, [], "amp", {"min_brightness": brightness[0], "max_brightness": brightness[1]})
    near = exact_quantiles(dmaps.where(F.col("bin_j") == F.col("bin_i") + 1), [], "d", {"max_jump_um": jump})
    far = exact_quantiles(med, [], "med", {"max_dist_um": max_dist})
    inf = F.lit(float("inf"))
    one = polymer.agg(F.count(F.lit(1)).alias("n"))
    return one.select(
        F.coalesce(amp.select("min_brightness").scalar(), F.lit(0.0)).alias("min_brightness"),
        F.coalesce(amp.select("max_brightness").scalar(), inf).alias("max_brightness"), F.coalesce(near.select("max_jump_um").scalar(), inf).alias("max_jump_um"),
        F.coalesce(far.select("max_dist_um").scalar(), inf).alias("max_dist_um"))


def bad_bins(polymer: DataFrame, dmaps: DataFrame, thresholds: dict[str, float], n_slots: int) -> DataFrame:
    """Polymer rows with `bad`: amplitude, both-neighbour jump, or median distance out of bounds.

    Neighbours are consecutive slots; a hole on either side keeps the bin.
    """
    inf = float("inf")
    lo, hi = thresholds.get("min_brightness", 0.0), thresholds.get("max_brightness", inf)
    far = dmaps.where((F.col("bin_j") == F.col("bin_i") + 1) & (F.col("d") > F.lit(thresholds.get("max_jump_um", inf))))
    jumps = far.select("allele_id", F.explode(F.array("bin_i", "bin_j")).alias("slot")).groupBy(
        "allele_id", "slot").agg(F.count(F.lit(1)).alias("n_far"))
    med = slot_medians(polymer, dmaps)
    interior = (F.col("slot") > 0) & (F.col("slot") < n_slots - 1)
    bad = (
        (F.col("amp") > hi) | (F.col("amp") < lo)
        | (interior & (F.coalesce(F.col("n_far"), F.lit(0)) == 2))
        | (F.coalesce(F.col("med"), F.lit(0.0)) > F.lit(thresholds.get("max_dist_um", inf)))
    )
    return polymer.join(med, ["allele_id", "slot"], "left").join(jumps, ["allele_id", "slot"], "left").withColumn(
        "bad", F.coalesce(bad, F.lit(False))).drop("n_far")


def apply_qc(flagged: DataFrame, min_traced: int = 2) -> DataFrame:
    """Good bins of the alleles that keep at least `min_traced` of them."""
    good = flagged.where(~F.col("bad"))
    w = Window.partitionBy("allele_id")   # bounded by the axis length
    return good.withColumn("n_traced", F.count(F.lit(1)).over(w)).where(F.col("n_traced") >= min_traced).drop("bad", "med")


def fit_rejection(depth: Column, *, z_trim: float | None = None, reject_at_bound: bool = True, min_occupancy: float | None = None,
                  max_uncert_xy_nm: float | None = None, max_uncert_z_nm: float | None = None) -> Column:
    """The first reason a fitted position is refused, NULL when it passes.

    Columns: found, z, at_bound (array<string>), occupancy, ci_y_um, ci_x_um, ci_z_um
    (half widths; the limits are full intervals in nm).
    """
    def undefined(c):
        return c.isNull() | F.isnan(c)

    xy, z = (F.greatest("ci_y_um", "ci_x_um") * 2000.0), F.col("ci_z_um") * 2000.0
    occ = F.col("occupancy")
    steps = [F.when(~F.col("found"), "fit failed")]
    if z_trim:
        steps.append(F.when((F.col("z") < z_trim) | (F.col("z") > depth - 1 - z_trim), "stack end"))
    if reject_at_bound:
        steps.append(F.when(F.size("at_bound") > 0, F.concat(F.lit("at bound ("), F.array_join("at_bound", ", "), F.lit(")"))))
    if min_occupancy is not None:
        steps += [F.when(undefined(occ), "occupancy undefined"), F.when(occ < min_occupancy, "occupancy")]
    if max_uncert_xy_nm is not None:
        steps.append(F.when(F.isnan(xy) | (xy > max_uncert_xy_nm), "lateral uncertainty"))
    if max_uncert_z_nm is not None:
        steps.append(F.when(F.isnan(z) | (z > max_uncert_z_nm), "axial uncertainty"))
    return F.coalesce(*steps)

