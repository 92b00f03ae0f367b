"""Cell-cycle counts, categories and circular statistics as aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions.scalar import SPOT_GATE, circular_abs_diff, in_arc, in_range, wrap360

from chromaloom.session import checked_broadcast

from .expression import KEYS, SRC, source_rows
from .stats import exact_quantiles

# Fixed verdict gates: key -> (column, direction).
GATE_KEYS = {"min_R": ("R", "ge"), "min_ring_tail": ("ring_tail", "ge"), "min_fit_z": ("fit_z", "ge"),
             "max_fit_z": ("fit_z", "le"), "min_radius": ("radius", "ge"), "max_radius": ("radius", "le"),
             "min_total": ("total", "ge")}
ON_RING = 0.05


def count_table(cells: DataFrame, spots: DataFrame, sources, gate: float = SPOT_GATE) -> DataFrame:
    """Per (cell, source): n, soft, candidates; p_min and n_stored of the FOV's slice.

    A spot of a cell the table does not know still counts as stored, not as a candidate.
    """
    wanted = [F.struct(F.lit(m), F.lit(h), F.lit(int(c))) for m, h, c in sources]
    p = F.col("p_exist")
    scored = p.isNotNull() & ~F.isnan(p)
    rows = spots.where(F.struct(*SRC).isin(*wanted))
    per = rows.groupBy(*KEYS, *SRC).agg(
        F.sum((~scored | (p >= gate)).cast("long")).alias("n"),
        F.sum(F.when(scored, p).otherwise(F.lit(1.0))).alias("soft"),
        F.count(F.lit(1)).alias("candidates"), F.min(F.when(scored, p)).alias("p_low"))
    keys = [*KEYS, *SRC]
    known = per.join(cells.select(*KEYS), KEYS, "left_semi")
    low = known.groupBy("fov", *SRC).agg(F.min("p_low").alias("p_min"))
    stored = per.groupBy("fov", *SRC).agg(F.sum("candidates").alias("n_stored"))
    slice_facts = stored.join(low, ["fov", *SRC], "left")
    axis = cells.select(*KEYS, "celltype", F.explode(source_rows(sources)).alias("s")).select(
        *KEYS, "celltype", *[F.col(f"s.{c}").alias(c) for c in SRC])
    return axis.join(known.drop("p_low"), keys, "left").join(checked_broadcast(slice_facts), ["fov", *SRC], "left").select(
        *KEYS, "celltype", *SRC, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("soft", F.lit(0.0)).alias("soft"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), "p_min", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


def gene_table(counts: DataFrame, genes: dict[tuple, str], metric: str = "n") -> DataFrame:
    """cells x genes; a cell with any gene missing is dropped. The gene list is the pivot list."""
    name = F.coalesce(*[F.when((F.col("modality") == m) & (F.col("hybe") == h) & (F.col("channel") == int(c)), F.lit(g))
                        for (m, h, c), g in genes.items()], F.lit(None).cast("string"))
    named = counts.withColumn("gene", name).where(F.col("gene").isNotNull())
    wide = named.groupBy(*KEYS, "celltype").agg(*[
        F.max(F.when(F.col("gene") == g, F.col(metric))).alias(g) for g in genes.values()])
    return wide.dropna(subset=list(genes.values()))


def saturation_table(counts: DataFrame, min_candidates: float = 20.0, max_fraction: float = 0.12) -> DataFrame:
    """Per source: mean candidates, mean accepted, their ratio, and the low-acceptance flag."""
    t = counts.groupBy(*SRC).agg(F.avg("candidates").alias("candidates"), F.avg("n").alias("accepted"))
    frac = F.col("accepted") / F.greatest(F.col("candidates"), F.lit(1e-9))
    return t.withColumn("accepted_fraction", frac).withColumn(
        "flag", (F.col("accepted_fraction") < max_fraction) & (F.col("candidates") > min_candidates))


def categorize(theta, arcs: list[dict]) -> Column:
    """Name of the first listed arc that holds the angle, '' outside all of them."""
    hits = [F.when(in_arc(theta, a["start_deg"], a["end_deg"]), F.lit(a["name"])) for a in arcs]
    return F.coalesce(*hits, F.lit(""))


def verdict_gates(table: DataFrame, gates: dict | None) -> Column:
    ok = F.lit(True)
    for key, (column, direction) in GATE_KEYS.items():
        bound = (gates or {}).get(key)
        if bound is None:
            continue
        if column not in table.columns:
            return F.lit(False)
        ok = ok & (in_range(column, lo=float(bound)) if direction == "ge" else in_range(column, hi=float(bound)))
    return ok


def assign(table: DataFrame, arcs: list[dict], gates: dict | None = None) -> DataFrame:
    """Placements plus `category`: derived at read time, never stored."""
    return table.withColumn("category", F.when(verdict_gates(table, gates), categorize("theta_deg", arcs)).otherwise(F.lit("")))


def phase_bin(theta, n_bins: int, lo: float = 0.0, hi: float = 360.0) -> Column:
    wrapped = F.pmod(F.col(theta) - F.lit(lo), F.lit(hi - lo))
    return F.least(F.floor(wrapped * n_bins / (hi - lo)).cast("int"), F.lit(n_bins - 1))


def binned_stat(table: DataFrame, value: str, n_bins: int = 24, stat: str = "median", theta: str = "theta_deg",
                min_n: int = 5) -> DataFrame:
    """Per phase bin: n, centre, the statistic and both quartiles; NULL under min_n values."""
    rows = table.where(F.col(theta).isNotNull() & F.col(value).isNotNull()).select(
        phase_bin(theta, n_bins).alias("bin"), F.col(value).alias("v"))
    q = exact_quantiles(rows, ["bin"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, few_groups=True)
    mean = rows.groupBy("bin").agg(F.avg("v").alias("mean"))
    wide = q.join(F.broadcast(mean), "bin")
    show = F.col("n") >= min_n
    return wide.select("bin", "n", ((F.col("bin") + 0.5) * (360.0 / n_bins)).alias("center"),
                       F.when(show, F.col("q50" if stat == "median" else "mean")).alias("value"),
                       F.when(show, F.col("q25")).alias("q25"), F.when(show, F.col("q75")).alias("q75"))


def circular_summary(table: DataFrame, by: list[str], theta: str = "theta_deg") -> DataFrame:
    """n, circular mean, concentration, medians and fractions per group."""
    rows = table.where(F.col(theta).isNotNull())
    rad = F.radians(F.col(theta))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(rad)).alias("c"), F.avg(F.sin(rad)).alias("s"),
        F.avg(F.coalesce(F.col("fit_z") < -2, F.lit(False)).cast("double")).alias("frac_outside"),
        F.avg(F.coalesce(F.col("ring_tail") >= ON_RING, F.lit(False)).cast("double")).alias("frac_on_ring"))
    out = base.select(*by, "n", wrap360(F.degrees(F.atan2("s", "c"))).alias("mean_deg"),
                      F.hypot("c", "s").alias("concentration"), "frac_outside", "frac_on_ring")
    # the three medians share one pass: their columns are stacked under a name
    stacked = rows.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("R", "fit_z", "radius")])).alias("s")).select(*by, "s.*")
    med = exact_quantiles(stacked, [*by, "name"], "v", {"m": 0.5})
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("m"))).alias(f"median_{c}") for c in ("R", "fit_z", "radius")])
    return out.join(wide, by, "left")


def phase_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two phase sets of the same cells: median absolute difference and fractions within 30/45/90."""
    d = a.select(*KEYS, F.col("theta_deg").alias("ta")).join(b.select(*KEYS, F.col("theta_deg").alias("tb")), KEYS)
    d = d.where("ta is not null and tb is not null").select(circular_abs_diff("ta", "tb").alias("d"))
    within = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("d") <= k).cast("double")).alias(f"frac_within_{k}") for k in (30, 45, 90)])
    med = exact_quantiles(d, [], "d", {"median_abs_diff_deg": 0.5})
    return within.withColumn("median_abs_diff_deg", med.select("median_abs_diff_deg").scalar())


def normalise_by_fov(table: DataFrame, value: str, min_cells: int = 5) -> DataFrame:
    """value over its FOV's median; NULL for sparse FOVs or a non-positive median."""
    med = exact_quantiles(table, ["fov"], value, {"__med": 0.5})
    ok = (F.col("n") >= min_cells) & (F.col("__med") > 0)
    return table.join(checked_broadcast(med), "fov", "left").withColumn(f"{value}_norm", F.when(ok, F.col(value) / F.col("__med"))).drop("n", "__med")


def phase_medians(table: DataFrame, value: str, n_bins: int = 36, theta: str = "theta_deg", min_n: int = 5) -> np.ndarray:
    """The binned median curve (n_bins numbers); sparse bins filled along the circle."""
    rows = binned_stat(table, value, n_bins, theta=theta, min_n=min_n).select("bin", "value").collect()   # n_bins rows
    curve = np.full(n_bins, np.nan)
    for row in rows:
        if row["value"] is not None:
            curve[row["bin"]] = row["value"]
    good = np.flatnonzero(np.isfinite(curve))
    if len(good) < 6:
        raise ValueError("too few phase bins hold enough cells")
    return np.interp(np.arange(n_bins), good, curve[good], period=n_bins)


def dna_curve(table: DataFrame, value: str, n_bins: int = 36, smooth: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bin centres, circularly smoothed median)."""
    curve = phase_medians(table, value, n_bins)
    shifted = [np.roll(curve, k) for k in range(-smooth, smooth + 1)]
    return (np.arange(n_bins) + 0.5) * 360.0 / n_bins, np.mean(shifted, axis=0)


def total_drop(table: DataFrame, n_bins: int = 36, smooth: int = 2, min_cells: int = 200):
    """(angle, factor) of the steepest fall of the log median total; (None, None) with too few cells."""
    usable = table.where((F.col("total") > 0) & F.col("theta_deg").isNotNull())
    if usable.limit(min_cells).count() < min_cells:
        return None, None
    log_median = np.log(phase_medians(usable, "total", n_bins))
    width = smooth + 2
    before = np.stack([np.roll(log_median, k) for k in range(1, width + 1)])
    after = np.stack([np.roll(log_median, -k) for k in range(width)])
    j = int(np.argmax(before.mean(0) - after.mean(0)))
    return 360.0 * j / n_bins, float(np.exp(before[:, j].max() - after[:, j].min()))


# 2^31 - 1 times the distribution function of a Poisson variable of mean 1 at 0, 1, 2, ...
POISSON_STEPS = tuple(round(2147483647 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(7))


def direction_ci(table: DataFrame, by: list[str], n_boot: int = 500, seed: int = 12345, theta: str = "theta_deg") -> DataFrame:
    """Half width of the bootstrap 95% interval of each group's mean direction.

    A Poisson bootstrap in columns: every cell draws its multiplicity in every replicate
    from two 30-bit words of an MD5 of (seed, fov, cell), so a task emits (groups x replicates)
    sums, no resample is shuffled and the draw can be repeated outside Spark. Two cells draw alike
    in all replicates only if all 60 bits agree.
    """
    word = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("fov").cast("string"), F.col("cell").cast("string")))
    halves = [F.conv(F.substring(word, at, 8), 16, 10).cast("long") % (1 << 30) for at in (1, 9)]
    rows = table.where(F.col(theta).isNotNull()).select(*by, F.radians(theta).alias("__t"), halves[0].alias("__c"), halves[1].alias("__s"))
    prime = F.lit(2147483647).cast("long")
    drawn = rows.select(*by, F.cos("__t").alias("__x"), F.sin("__t").alias("__y"), "__c", "__s", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("__b"))
    u = F.pmod(F.pmod(F.pmod(F.col("__c") + (F.col("__b").cast("long") + 1) * F.col("__s"), prime) * 48271, prime) * 48271, prime)
    drawn = drawn.withColumn("__u", u)
    times = sum(((F.col("__u") >= t).cast("int") for t in POISSON_STEPS[1:]), (F.col("__u") >= POISSON_STEPS[0]).cast("int"))
    sums = drawn.groupBy(*by, "__b").agg(F.sum(times * F.col("__x")).alias("c"), F.sum(times * F.col("__y")).alias("s"))
    mean = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.degrees(F.atan2(F.avg(F.sin("__t")), F.avg(F.cos("__t")))).alias("m"))
    mean = mean.select(*[F.col(k).alias(f"__k_{k}") for k in by], "n", "m")
    both = sums.join(mean, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by])
    gap = circular_abs_diff(F.degrees(F.atan2("s", "c")), F.col("m"))
    # n_boot values per group
    return both.groupBy(*by, "n", "m").agg(F.percentile(gap, F.lit(0.95)).alias("half_width_deg")).select(
        *by, "n", wrap360("m").alias("mean_deg"), "half_width_deg")


def arcs_from_time(elapsed: np.ndarray, shares: list[tuple[str, float]], birth_deg: float = 0.0) -> list[dict]:
    """Category arcs from shares of the cycle, through the elapsed time at each grid angle."""
    n = len(elapsed)
    start = int(np.ceil((birth_deg % 360.0) * n / 360.0)) % n
    clock = np.concatenate([[0.0], np.roll(elapsed, -start)])
    angle = birth_deg + np.arange(n + 1) * 360.0 / n
    total, at, arcs, used = sum(s for _n, s in shares), float(birth_deg) % 360.0, [], 0.0
    for k, (name, share) in enumerate(shares):
        used += share / total
        end = float(birth_deg) % 360.0 if k + 1 == len(shares) else float(np.interp(used, clock, angle)) % 360.0
        arcs.append({"name": name, "start_deg": at, "end_deg": end})
        at = end
    return arcs
