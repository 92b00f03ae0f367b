"""Per-cell allele counts from the spots per bin, and the repeat calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import exact_quantiles

KEYS = ["fov", "cell"]
CONTAMINATION = 0.05
MAX_ALLELES, MIN_SUPPORT = 3, 8


def bin_counts(points: DataFrame, n_slots: int, cells: DataFrame | None = None) -> DataFrame:
    """(fov, cell, counts): spots per slot over the whole axis, empty slots included.

    `cells` adds those without any spot; spots outside its cells are left out.
    """
    per = points.groupBy(*KEYS, "slot").agg(F.count(F.lit(1)).alias("c"))
    # at most n_slots entries per cell
    got = per.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("slot", "c"))).alias("m"))
    axis = F.sequence(F.lit(0), F.lit(n_slots - 1))
    if cells is not None:
        got = cells.select(*KEYS).join(got, KEYS, "left").withColumn("m", F.coalesce("m", F.create_map().cast(got.schema["m"].dataType)))
    return got.select(*KEYS, F.transform(axis, lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0))).cast("array<int>").alias("counts"))


def _log_binomial(c: Column, k: int, log_e: Column, log_miss: Column) -> Column:
    """ln P(c | k, e); NULL above k."""
    choose = F.coalesce(*[F.when(c == v, F.lit(math.log(math.comb(k, v)))) for v in range(k + 1)])
    return F.when(c <= k, choose + c * log_e + (F.lit(k) - c) * log_miss)


def binomial_multiplicity(counts: DataFrame, max_alleles: int = MAX_ALLELES, contamination: float = CONTAMINATION,
                          min_support: int = MIN_SUPPORT) -> DataFrame:
    """(fov, cell, k, efficiency, loglik, reason): binomial counts with uniform contamination.

    The smallest k within one nat of the best wins. Everything is array arithmetic on
    the bounded count vector. Fewer than `min_support` bins give no k (reason `few bins`), a cell
    without a spot has k 0 and efficiency 0 (`no spots`).
    """
    c = F.col("counts")
    n = F.size(c)
    span = F.ln(F.greatest(F.array_max(c), F.lit(1)).cast("double") + 1)
    clean, dirty = math.log1p(-contamination), math.log(contamination)
    df = counts.withColumn("dirt", F.lit(dirty) - span)
    def clipped_sum(k: int) -> Column:
        return F.aggregate(c, F.lit(0), lambda s, v: s + F.least(v, F.lit(k)))

    def loglik(k: int) -> Column:
        def add(s, v):
            b = F.lit(clean) + _log_binomial(v, k, F.col(f"le{k}"), F.col(f"lm{k}"))
            top = F.greatest(b, F.col("dirt"))
            # above k only contamination explains the count
            return s + F.coalesce(top + F.ln(F.exp(b - top) + F.exp(F.col("dirt") - top)), F.col("dirt"))
        return F.aggregate(c, F.lit(0.0), add)

    for k in range(1, max_alleles + 1):
        e = F.least(F.greatest(clipped_sum(k) / n / float(k), F.lit(1e-6)), F.lit(1 - 1e-6))
        df = df.withColumns({f"e{k}": e, f"le{k}": F.ln(e), f"lm{k}": F.ln(F.lit(1.0) - e)}).withColumn(f"ll{k}", loglik(k))
    best = F.greatest(*[F.col(f"ll{k}") for k in range(1, max_alleles + 1)])
    pick = F.coalesce(*[F.when(F.col(f"ll{k}") >= best - 1.0, F.struct(
        F.lit(k).alias("k"), F.col(f"e{k}").alias("efficiency"), F.col(f"ll{k}").alias("loglik"))) for k in range(1, max_alleles + 1)])
    few, bare = n < min_support, F.coalesce(F.array_max(c), F.lit(0)) == 0
    nothing = F.lit(None)
    return df.select(*KEYS, pick.alias("p"), few.alias("few"), bare.alias("bare")).select(
        *KEYS, F.when(F.col("few"), nothing).when(F.col("bare"), F.lit(0)).otherwise(F.col("p.k")).alias("k"),
        F.when(F.col("few"), nothing).when(F.col("bare"), F.lit(0.0)).otherwise(F.col("p.efficiency")).alias("efficiency"),
        F.when(F.col("few") | F.col("bare"), nothing).otherwise(F.col("p.loglik")).alias("loglik"),
        F.when(F.col("few"), "few bins").when(F.col("bare"), "no spots").otherwise("fitted").alias("reason"))


def repeat_calibration(vectors: DataFrame, iters: int = 30) -> dict[str, float]:
    """Localisation spread from repeat separations (dy, dx, dz): a clean and a
    mis-assigned diagonal Gaussian, fitted by EM.

    Each iteration is one aggregate that returns seven numbers.
    """
    q = {"q50": 0.5}
    mids = {a: exact_quantiles(vectors, [], a, q).first() for a in ("dy", "dx", "dz")}
    if mids["dy"]["n"] < 30:
        raise ValueError(f"need at least 30 repeat pairs, got {mids['dy']['n']}")

    def spread(a: str) -> float:
        mad = exact_quantiles(vectors.select(F.abs(F.col(a) - mids[a]["q50"]).alias("m")), [], "m", q).first()["q50"]
        return (1.4826 * mad) ** 2

    plane = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    axial = F.col("dz") * F.col("dz")
    sq = vectors.select(plane.alias("r2"), axial.alias("z2"))
    far = {c: exact_quantiles(sq, [], c, {"q": 0.99}).first()["q"] for c in ("r2", "z2")}
    sxy, sz = max((spread("dy") + spread("dx")) / 2, 1e-10), max(spread("dz"), 1e-10)
    txy, tz, mix = max(far["r2"] / 2, 4 * sxy), max(far["z2"], 4 * sz), 0.15
    for _ in range(iters):
        def density(vxy, vz, weight):
            return F.lit(math.log(max(weight, 1e-12)) - math.log(vxy) - 0.5 * math.log(vz)) - F.col("r2") / (2 * vxy) - F.col("z2") / (2 * vz)

        w = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(density(txy, tz, mix) - density(sxy, sz, 1 - mix), F.lit(700.0))))
        m = sq.withColumn("w", w).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r2")).alias("wr"), F.sum(F.col("w") * F.col("z2")).alias("wz"),
            F.sum(1 - F.col("w")).alias("u"), F.sum((1 - F.col("w")) * F.col("r2")).alias("ur"), F.sum((1 - F.col("w")) * F.col("z2")).alias("uz")).first()
        old = (sxy, sz, mix)
        if m["w"] > 10:
            sxy, sz = max(m["wr"] / (2 * m["w"]), 1e-12), max(m["wz"] / m["w"], 1e-12)
        if m["u"] > 10:
            txy, tz = m["ur"] / (2 * m["u"]), m["uz"] / m["u"]
        mix = m["u"] / (m["w"] + m["u"])
        if abs(old[0] - sxy) < 1e-12 and abs(old[1] - sz) < 1e-12 and abs(old[2] - mix) < 1e-10:
            break
    return {"sigma_xy": math.sqrt(sxy / 2), "sigma_z": math.sqrt(sz / 2), "mix": mix, "n": float(mids["dy"]["n"])}
