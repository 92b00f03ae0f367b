"""Cell types from barcode images, mask sums and the gene validity screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast

from .cellcycle import phase_bin
from .stats import exact_quantiles, group_quantiles, has_hot_group

KEYS = ["fov", "cell"]
MIN_SWING, MIN_RHO = 1.5, 0.3


def barcode_vote(pixels: DataFrame, image: DataFrame, types: dict[int, str]) -> DataFrame:
    """Majority over the mask's pixels of each pixel's strongest barcode channel.

    image(fov, channel, y, x, value) holds scaled intensities; a pixel with nothing
    above zero votes ''. Ties fall to the first channel, then the first name.
    """
    name = F.coalesce(*[F.when(F.col("channel") == c, F.lit(t)) for c, t in types.items()])
    # strongest channel per pixel first: one row per pixel meets the masks
    top = image.where(F.col("channel").isin(*types)).groupBy("fov", "y", "x").agg(
        F.max_by(F.struct("channel", "value"), F.struct(F.col("value"), -F.col("channel"))).alias("t")).select(
        "fov", "y", "x", F.col("t.channel").alias("channel"), F.col("t.value").alias("value"))
    won = top.select("fov", "y", "x", F.when(F.col("value") > 0, name).otherwise(F.lit("")).alias("celltype"))
    votes = pixels.join(won, ["fov", "y", "x"]).groupBy(*KEYS, "celltype").agg(F.count(F.lit(1)).alias("votes"))
    order = F.struct(-F.col("votes"), F.col("celltype"))
    return votes.groupBy(*KEYS).agg(F.min_by("celltype", order).alias("celltype"), F.max("votes").alias("votes"))


def mask_bound(pixels: DataFrame, image: DataFrame, by: list[str]) -> DataFrame:
    """(fov, cell, n): no fewer than the values under a mask, told without joining mask and image."""
    most = image.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return pixels.groupBy(*KEYS).agg((F.count(F.lit(1)) * F.lit(most)).alias("n"))


def barcode_median(pixels: DataFrame, image: DataFrame, types: dict[int, str]) -> DataFrame:
    """The channel with the largest median under the mask, '' when none is above zero."""
    seen = image.where(F.col("channel").isin(*types))
    bound = mask_bound(pixels, seen, ["fov", "channel", "y", "x"])
    per = group_quantiles(pixels.join(seen, ["fov", "y", "x"]), [*KEYS, "channel"], "value", {"m": 0.5}, bound=bound)
    name = F.coalesce(*[F.when(F.col("channel") == c, F.lit(t)) for c, t in types.items()])
    best = per.groupBy(*KEYS).agg(F.max_by(F.struct(name.alias("name"), F.col("m").alias("m")), F.struct(F.col("m"), -F.col("channel"))).alias("b"))
    return best.select(*KEYS, F.when(F.col("b.m") > 0, F.col("b.name")).otherwise(F.lit("")).alias("celltype"))


def mask_sums(pixels: DataFrame, image: DataFrame) -> DataFrame:
    """Per cell: area, mean, median and the sum above the FOV background.

    Background: the median outside every mask, or the 5th percentile of the FOV when
    less than one percent lies outside.
    """
    covered = pixels.select("fov", "y", "x").distinct().withColumn("inside", F.lit(True))
    marked = image.join(covered, ["fov", "y", "x"], "left")
    outside = exact_quantiles(marked.where("inside is null"), ["fov"], "value", {"outside": 0.5}).withColumnRenamed("n", "n_out")
    whole = exact_quantiles(image, ["fov"], "value", {"p5": 0.05})
    bg = whole.join(outside, "fov", "left").select(
        "fov", F.when(F.coalesce("n_out", F.lit(0)) >= F.col("n") * 0.01, F.col("outside")).otherwise(F.col("p5")).alias("background"))
    under = pixels.join(image, ["fov", "y", "x"])
    sums = [F.count("value").alias("area"), F.avg("value").alias("mask_mean"),
            F.sum(F.greatest(F.col("value") - F.col("background"), F.lit(0.0))).alias("sum_above_bg"), F.first("background").alias("background")]
    lit = under.join(checked_broadcast(bg), "fov")
    if not has_hot_group(mask_bound(pixels, image, ["fov", "y", "x"])):
        # no mask is large: the median goes with the sums, masks and image meet once
        known = F.when(~F.isnan(F.col("value").cast("double")), F.col("value"))
        return lit.groupBy(*KEYS).agg(*sums, F.percentile(known, F.lit(0.5)).alias("mask_median"))
    med = group_quantiles(under, KEYS, "value", {"mask_median": 0.5}).drop("n")
    return lit.groupBy(*KEYS).agg(*sums).join(med, KEYS)


def screen_genes(counts: DataFrame, placed: DataFrame, n_bins: int = 12) -> DataFrame:
    """Per source: rank correlation of its candidate and accepted phase profiles, swings, refusal.

    Profiles are n_bins numbers per source, so ranks are windows over n_bins rows.
    """
    src = ["modality", "hybe", "channel"]
    bins = placed.where("theta_deg is not null").select(*KEYS, phase_bin("theta_deg", n_bins).alias("bin"))
    prof = counts.join(bins, KEYS).groupBy(*src, "bin").agg(F.avg("candidates").alias("c"), F.avg("n").alias("a"))

    def mid_rank(v):
        tied = F.count(F.lit(1)).over(Window.partitionBy(*src, v))
        return F.rank().over(Window.partitionBy(*src).orderBy(v)) + (tied - 1) / 2.0

    ranked = prof.withColumns({"rc": mid_rank("c"), "ra": mid_rank("a")})
    out = ranked.groupBy(*src).agg(
        F.count(F.lit(1)).alias("n_bins"), F.corr("rc", "ra").alias("rho"),
        (F.max("c") / F.greatest(F.min("c"), F.lit(1.0))).alias("cand_swing"), (F.max("a") / F.greatest(F.min("a"), F.lit(0.5))).alias("acc_swing"),
        F.max(F.abs(F.col("c") - F.col("a"))).alias("gap"))
    judged = (F.col("n_bins") >= 6) & (F.col("gap") > 1e-8)
    return out.withColumn("judged", judged).withColumn(
        "refused", F.coalesce(judged & (F.col("acc_swing") >= MIN_SWING) & (F.col("rho") < MIN_RHO), F.lit(False))).drop("gap")
