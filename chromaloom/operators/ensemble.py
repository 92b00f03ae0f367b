"""Ensemble maps over alleles and the comparisons built on them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.session import checked_broadcast

from .pairs import group_pairs
from .stats import exact_quantiles

PIXEL = ["bin_i", "bin_j"]


def ensemble_map(dmaps: DataFrame, reducer: str = "median", min_n: int = 5, by: list[str] | None = None) -> DataFrame:
    """Per pixel: n and the reduced distance, NULL below min_n observations.

    A pixel holds one value per allele, so its median is ranked by counting
    (exact_quantiles), never in one buffer. Without `by` the number of pixels is
    bounded by the axis.
    """
    by = by or []
    keys = [*by, *PIXEL]
    if reducer == "median":
        m = exact_quantiles(dmaps, keys, "d", {"value": 0.5}, few_groups=not by)
    else:
        m = dmaps.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("value"))
    return m.withColumn("value", F.when(F.col("n") >= min_n, F.col("value")))


def subtraction_map(dmaps: DataFrame, in_a: Column, in_b: Column, reducer: str = "median", min_n: int = 5) -> DataFrame:
    """map(A) - map(B); NULL where either group is under-observed. Groups may overlap."""
    tagged = dmaps.withColumn("g", F.explode(F.array_compact(F.array(
        F.when(in_a, F.lit("a")), F.when(in_b, F.lit("b"))))))
    keys = ["g", *PIXEL]
    if reducer == "median":
        m = exact_quantiles(tagged, keys, "d", {"value": 0.5}, few_groups=True)
    else:
        m = tagged.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("value"))

    def pick(group, c):
        return F.max(F.when(F.col("g") == group, F.col(c)))

    wide = m.groupBy(*PIXEL).agg(F.coalesce(pick("a", "n"), F.lit(0)).alias("n_a"), F.coalesce(pick("b", "n"), F.lit(0)).alias("n_b"),
                                 pick("a", "value").alias("va"), pick("b", "value").alias("vb"))
    shown = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    return wide.select(*PIXEL, "n_a", "n_b", F.when(shown, F.col("va") - F.col("vb")).alias("value"))


def full_square(upper: DataFrame, n_slots: int, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Dense symmetric grid with a zero diagonal where the map has any pixel; NULL elsewhere."""
    by = by or []
    both = upper.select(*by, F.explode(F.array(
        F.struct(F.col("bin_i").alias("i"), F.col("bin_j").alias("j")),
        F.struct(F.col("bin_j").alias("i"), F.col("bin_i").alias("j")))).alias("p"), F.col(value).alias("v")).select(
        *by, "p.i", "p.j", "v")
    diagonal = both.groupBy(*by, "i").agg(F.lit(0.0).alias("v")).select(*by, "i", F.col("i").alias("j"), "v")
    axis = F.sequence(F.lit(0), F.lit(n_slots - 1))
    some = upper.select(*by).distinct() if by else upper.groupBy().agg(F.count(F.lit(1)).alias("__n"))
    grid = some.select(*by, F.explode(axis).alias("i")).select(*by, "i", F.explode(axis).alias("j"))
    return grid.join(both.unionByName(diagonal), [*by, "i", "j"], "left")


def box_mean(square: DataFrame, h: int, by: list[str] | None = None) -> DataFrame:
    """Two separable passes of a (2h+1) box mean over the observed pixels; edges shrink."""
    by = by or []
    rows = Window.partitionBy(*by, "j").orderBy("i").rangeBetween(-h, h)
    cols = Window.partitionBy(*by, "i").orderBy("j").rangeBetween(-h, h)
    first = square.withColumn("v", F.avg("v").over(rows))
    return first.withColumn("v", F.avg("v").over(cols))


def scc(map_a: DataFrame, map_b: DataFrame, h: int = 0, n_slots: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Stratum-adjusted correlation of two maps (bin_i, bin_j, value), per group of `by` on side a."""
    by = by or []
    if h:
        map_a = box_mean(full_square(map_a, n_slots, by=by), h, by).where("i < j").select(
            *by, F.col("i").alias("bin_i"), F.col("j").alias("bin_j"), F.col("v").alias("value"))
        map_b = box_mean(full_square(map_b, n_slots), h).where("i < j").select(
            F.col("i").alias("bin_i"), F.col("j").alias("bin_j"), F.col("v").alias("value"))
    both = map_a.select(*by, *PIXEL, F.col("value").alias("a")).join(
        map_b.select(*PIXEL, F.col("value").alias("b")), PIXEL).where("a is not null and b is not null")
    strata = both.groupBy(*by, (F.col("bin_j") - F.col("bin_i")).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.covar_pop("a", "b").alias("cov"))
    used = strata.where("n >= 3 and sa > 0 and sb > 0")
    # weight n*sa*sb times r = cov/(sa*sb) leaves n*cov on top
    return used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.try_divide(F.sum(F.col("n") * F.col("cov")), F.sum(F.col("n") * F.col("sa") * F.col("sb"))).alias("scc"))


def allele_pair_difference(dmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per allele pair: shared triangle entries, sum of |d1-d2| and of (d1-d2)^2."""
    a = dmaps.select(F.col("allele_id").alias("allele_a"), *PIXEL, F.col("d").alias("da"))
    b = dmaps.select(F.col("allele_id").alias("allele_b"), *PIXEL, F.col("d").alias("db"))
    diff = F.col("da") - F.col("db")
    return (pairs.join(a, "allele_a").join(b, ["allele_b", *PIXEL])
            .groupBy(*pairs.columns)
            .agg(F.count(F.lit(1)).alias("n_shared"), F.sum(F.abs(diff)).alias("sum_abs"), F.sum(diff * diff).alias("sum_sq")))


def within_cell_pairs(alleles: DataFrame) -> DataFrame:
    """Unordered allele pairs of a cell; homeless alleles have none."""
    housed = alleles.where(F.col("cell") >= 0)
    left = housed.select("fov", "cell", F.col("allele_id").alias("allele_a"))
    right = housed.select("fov", "cell", F.col("allele_id").alias("allele_b"))
    return group_pairs(left, right, ["fov", "cell"], "allele_a", F.col("allele_a") < F.col("allele_b"))


def shared_bins(polymer: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observed bins common to both alleles of a pair (the zero diagonal of their maps)."""
    a = polymer.select(F.col("allele_id").alias("allele_a"), "slot")
    b = polymer.select(F.col("allele_id").alias("allele_b"), "slot")
    return pairs.join(a, "allele_a").join(b, ["allele_b", "slot"]).groupBy(*pairs.columns).agg(
        F.count(F.lit(1)).alias("n_diag"))


def mean_abs_difference(diffs: DataFrame, diagonal: DataFrame, keys: list[str], min_entries: int = 3) -> DataFrame:
    """Mean |d1-d2| over the full symmetric maps, diagonal included; NULL below min_entries."""
    both = diagonal.join(diffs, keys, "left")
    entries = F.coalesce(F.col("n_shared"), F.lit(0)) * 2 + F.col("n_diag")
    mean = F.coalesce(F.col("sum_abs"), F.lit(0.0)) * 2 / entries
    return both.select(*keys, entries.alias("n_entries"), F.when(entries >= min_entries, mean).alias("difference"))


PAIR_BUCKET = 4096   # alleles per sampling bucket


def ring_pairs(alleles: DataFrame, seed: int, lag: int = 1, group: list[str] | None = None) -> DataFrame:
    """A seeded sample of allele pairs, linear in the number of alleles.

    Alleles are dealt into hash buckets of about PAIR_BUCKET (per `group`), put in
    the order of a second hash and paired with their next `lag` neighbours. This is
    the sampling operator behind the across-cell null. The hash is 60 bits of an MD5 of
    seed and id, so any number of alleles spreads and a sample can be reproduced outside Spark.
    """
    group = group or []
    mix = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("allele_id").cast("string"))), 1, 15), 16, 10).cast("long")
    mixed = alleles.select("fov", "cell", "allele_id", mix.alias("mix"))
    # the number of buckets follows the group's own size, so a small group is never torn apart
    sizes = alleles.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(float(PAIR_BUCKET)))).cast("long").alias("__buckets"))
    if group:
        known = sizes.select(*[F.col(g).alias(f"__{g}") for g in group], "__buckets")
        dealt = mixed.join(checked_broadcast(known), [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    else:
        dealt = mixed.withColumn("__buckets", sizes.select("__buckets").scalar())
    dealt = dealt.select("fov", "cell", "allele_id", "mix", F.pmod("mix", F.col("__buckets")).alias("bucket"))
    w = Window.partitionBy(*group, "bucket").orderBy("mix", "allele_id")
    steps = [
        F.struct(F.lead("allele_id", k).over(w).alias("allele_b"), F.lead("fov", k).over(w).alias("fov_b"),
                 F.lead("cell", k).over(w).alias("cell_b"))
        for k in range(1, lag + 1)]
    return dealt.select(
        F.col("allele_id").alias("allele_a"), F.col("fov").alias("fov_a"), F.col("cell").alias("cell_a"),
        F.array(*steps).alias("next")).select("allele_a", "fov_a", "cell_a", F.explode("next").alias("b")).select(
        "allele_a", "fov_a", "cell_a", "b.allele_b", "b.fov_b", "b.cell_b").where("allele_b is not null")


def welch(stats: DataFrame, flag: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Welch t of value between flag=true and flag=false, per group; t NULL under three samples."""
    by = by or []

    def pick(f, side):
        return f(F.when(F.col(flag) == F.lit(side), F.col(value)))

    m = stats.groupBy(*by).agg(
        pick(F.count, True).alias("n1"), pick(F.count, False).alias("n2"), pick(F.avg, True).alias("m1"),
        pick(F.avg, False).alias("m2"), pick(F.var_samp, True).alias("v1"), pick(F.var_samp, False).alias("v2"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    enough = (F.col("n1") >= 3) & (F.col("n2") >= 3) & (s1 + s2 > 0)
    df = F.try_divide(F.pow(s1 + s2, F.lit(2.0)), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    return m.select(*by, "n1", "n2", "m1", "m2",
                    F.when(enough, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))).alias("t"),
                    F.when(enough, df).alias("df"))


def student_two_sided(t: float, df: float) -> float:
    """Two-sided Student-t tail (one result row at a time, after aggregation)."""
    if t is None or df is None:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0

    def fraction(x, a, b):
        tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                c = 1.0 + num / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1.0 - x, b, a) / b


MIN_SHARED = 10      # fixed: map entries two alleles must share before their difference counts


def pair_msd(diffs: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Mean squared difference of allele pairs that share enough entries."""
    return diffs.where(F.col("n_shared") >= min_shared).withColumn("msd", F.col("sum_sq") / F.col("n_shared"))


def with_tail(table: DataFrame, t: str = "t", df: str = "df") -> DataFrame:
    """p, neglog10p and signed_neglog10p of a Welch table: one row per test, after aggregation."""
    @F.pandas_udf("double")
    def tail(tv: pd.Series, dv: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_sided(float(a), float(b)) for a, b in zip(tv, dv)], dtype=float)

    scored = table.withColumn("p", tail(F.col(t), F.col(df)))
    score = -F.log10(F.greatest(F.col("p"), F.lit(1e-300)))
    return scored.withColumns({"neglog10p": score, "signed_neglog10p": F.signum(F.col(t)) * score})


def fov_scores(cross: DataFrame) -> DataFrame:
    """(fov, n_with, n_without, m_with, m_without, t, df, p, neglog10p, signed_neglog10p).

    cross(fov_a, fov_b, msd): the pairs that link two fields. A field's own pairs are tested against
    the pairs that do not touch it; only a deviant field scores strongly positive. Per-field sums
    and one total give every split, so the pairs are read once. NULL under three pairs a side.
    """
    touched = cross.select(F.explode(F.array("fov_a", "fov_b")).alias("fov"), "msd").groupBy("fov").agg(
        F.count(F.lit(1)).alias("n_with"), F.sum("msd").alias("s1"), F.sum(F.col("msd") * F.col("msd")).alias("q1"))
    total = cross.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("msd").alias("s"), F.sum(F.col("msd") * F.col("msd")).alias("q")).alias("all"))
    j = touched.withColumn("all", total.scalar()).withColumn("n_without", F.col("all.n") - F.col("n_with"))
    m1, m2 = F.col("s1") / F.col("n_with"), F.try_divide(F.col("all.s") - F.col("s1"), F.col("n_without"))
    enough = (F.col("n_with") >= 3) & (F.col("n_without") >= 3)
    v1 = F.when(enough, (F.col("q1") - F.col("s1") * m1) / (F.col("n_with") - 1)) / F.col("n_with")
    v2 = F.when(enough, (F.col("all.q") - F.col("q1") - (F.col("all.s") - F.col("s1")) * m2) / (F.col("n_without") - 1)) / F.col("n_without")
    df = F.try_divide((v1 + v2) * (v1 + v2), v1 * v1 / (F.col("n_with") - 1) + v2 * v2 / (F.col("n_without") - 1))
    out = j.select("fov", "n_with", "n_without", m1.alias("m_with"), m2.alias("m_without"), F.try_divide(m1 - m2, F.sqrt(v1 + v2)).alias("t"), df.alias("df"))
    return with_tail(out)
