"""Which number a result set is gated on, and what the gate denies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALIBRATED, RANKING = "p_exist", "p"      # fixed: a probability, and a quality score


def _finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def gate_quantity(spots: DataFrame) -> str | None:
    """`p_exist` if any spot carries one, else `p`, else None.

    One quantity for the whole set, never a choice per spot: two scales on one axis would let a
    threshold mean different things. One aggregate over the columns that exist.
    """
    known = [c for c in (CALIBRATED, RANKING) if c in spots.columns]
    if not known:
        return None
    row = spots.agg(*[F.bool_or(_finite(c)).alias(c) for c in known]).first()
    return next((c for c in known if row[c]), None)


def gate_value(quantity: str | None) -> Column:
    """The gated number of a spot; NULL where it has none."""
    return F.lit(None).cast("double") if quantity is None else F.when(_finite(quantity), F.col(quantity).cast("double"))


def denied(quantity: str | None, threshold: float) -> Column:
    """Below the threshold; a spot nobody scored is not denied."""
    return F.coalesce(gate_value(quantity) < F.lit(float(threshold)), F.lit(False))


def gate_report(spots: DataFrame, threshold: float) -> DataFrame:
    """One row: quantity, calibrated, n_total, n_scored, n_denied, n_kept (scored ones), value range.

    `degenerate` says that all scored spots carry one value, so no threshold can part them.
    """
    q = gate_quantity(spots)
    v = gate_value(q)
    one = spots.select(v.alias("v"), denied(q, threshold).alias("d")).agg(
        F.count(F.lit(1)).alias("n_total"), F.count("v").alias("n_scored"), F.count_if("d").alias("n_denied"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    return one.select(F.lit(q).cast("string").alias("quantity"), F.lit(q == CALIBRATED).alias("calibrated"), "n_total", "n_scored", "n_denied",
                      (F.col("n_scored") - F.col("n_denied")).alias("n_kept"), "v_min", "v_max", F.coalesce(F.col("v_min") == F.col("v_max"), F.lit(False)).alias("degenerate"))
