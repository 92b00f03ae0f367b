"""Expression per (cell, source), modality-wide denominators and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.scalar import SPOT_GATE, accepted, nan_to_null, safe_div

from .stats import group_quantiles

KEYS = ["fov", "cell"]
SRC = ["modality", "hybe", "channel"]
DENOMINATOR = {"n_spots": "mod_n_spots", "brightness_median": "mod_brightness_median",
               "brightness_total": "mod_brightness_total", "mask_median": "mod_mask_median"}


def source_rows(sources) -> F.Column:
    """The run's source list as an array literal; exploded per cell, never joined."""
    return F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(h).alias("hybe"), F.lit(int(c)).alias("channel"))
                     for m, h, c in sources])


def _counted(spots: DataFrame, gate: float) -> DataFrame:
    return spots.where(accepted("p_exist", gate) & (F.col("cell") >= 0))


def expression_table(cells: DataFrame, spots: DataFrame, sources, gate: float = SPOT_GATE) -> DataFrame:
    """One row per (cell, source), zero-spot cells included."""
    per = (
        _counted(spots, gate)
        .where(F.struct(*SRC).isin(*[F.struct(F.lit(m), F.lit(h), F.lit(int(c))) for m, h, c in sources]))
        .select(*KEYS, *SRC, nan_to_null("brightness").alias("brightness"))
    )
    keys = [*KEYS, *SRC]
    med = group_quantiles(per, keys, "brightness", {"brightness_median": 0.5}).withColumnRenamed("n", "n_spots")
    total = per.groupBy(*keys).agg(F.sum("brightness").alias("brightness_total"))
    axis = cells.select(*KEYS, "celltype", F.explode(source_rows(sources)).alias("s")).select(
        *KEYS, "celltype", *[F.col(f"s.{c}").alias(c) for c in SRC])
    return axis.join(med, keys, "left").join(total, keys, "left").select(
        *KEYS, "celltype", *SRC, F.coalesce("n_spots", F.lit(0)).alias("n_spots"), "brightness_median",
        F.coalesce("brightness_total", F.lit(0.0)).alias("brightness_total"))


def modality_denominators(spots: DataFrame, gate: float = SPOT_GATE) -> DataFrame:
    """Per (fov, cell, modality); the count includes spots without a brightness."""
    keys = [*KEYS, "modality"]
    rows = _counted(spots, gate).select(*keys, nan_to_null("brightness").alias("brightness"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("mod_n_spots"),
                                     F.coalesce(F.sum("brightness"), F.lit(0.0)).alias("mod_brightness_total"))
    med = group_quantiles(rows, keys, "brightness", {"mod_brightness_median": 0.5},
                          counts.select(*keys, F.col("mod_n_spots").alias("n"))).drop("n")
    return counts.join(med, keys, "left")


def homeless_counts(spots: DataFrame, gate: float = SPOT_GATE) -> DataFrame:
    return (spots.where(accepted("p_exist", gate) & (F.col("cell") < 0))
            .groupBy("fov", *SRC).agg(F.count(F.lit(1)).alias("homeless")))


def mask_intensity(pixels: DataFrame, image: DataFrame, frame_shape: tuple[int, int]) -> DataFrame:
    """(fov, cell, ...) median image value under each mask; mask pixels clip to the frame."""
    h, w = frame_shape
    keys = [*KEYS, *[c for c in image.columns if c not in ("fov", "y", "x", "value")]]
    clipped = pixels.withColumns({"y": F.least(F.greatest(F.col("y"), F.lit(0)), F.lit(h - 1)),
                                  "x": F.least(F.greatest(F.col("x"), F.lit(0)), F.lit(w - 1))})
    return group_quantiles(clipped.join(image, ["fov", "y", "x"]), keys, "value", {"mask_median": 0.5}).drop("n")


def normalize(expr: DataFrame, metric: str, mode: str, ref_source=None,
              denominators: DataFrame | None = None) -> DataFrame:
    """Adds `<metric>_norm`; zero or missing denominators give NULL."""
    if metric not in DENOMINATOR:
        raise ValueError(f"unknown metric {metric!r}")
    if mode == "by_source":
        if ref_source is None:
            raise ValueError("by_source needs ref_source=(modality, hybe, channel)")
        m, h, c = ref_source
        ref = expr.where((F.col("modality") == m) & (F.col("hybe") == h) & (F.col("channel") == int(c)))
        joined = expr.join(ref.select(*KEYS, F.col(metric).alias("__den")), KEYS, "left")
    elif mode in ("by_modality", "by_total_count"):
        den = DENOMINATOR[metric]
        if den in expr.columns:
            joined = expr.withColumn("__den", F.col(den))
        elif denominators is not None and den in denominators.columns:
            joined = expr.join(denominators.select(*KEYS, "modality", F.col(den).alias("__den")),
                               [*KEYS, "modality"], "left")
        else:
            raise ValueError(f"{den} missing: pass the modality denominators")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    ratio = safe_div(F.col(metric).cast("double"), F.col("__den").cast("double"))
    return joined.withColumn(f"{metric}_norm", ratio).drop("__den")
