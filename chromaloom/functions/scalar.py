"""Column helpers shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
VOXEL_UM = (0.208, 0.208, 0.2)          # um per pixel / plane along y, x, z
SPOT_GATE = 0.5                         # p_exist needed for a spot to count
EDGE_MARGIN_PLANES = 11.0               # axial positions closer to a stack end are not believed
Z_STATUSES = ("accepted", "rejected", "not_fit")
USABLE_Z = {"xyz": ("accepted",), "xy": ("accepted", "not_fit")}
UNASSIGNED = "Unassigned"
TRACED = "traced"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN becomes NULL once, at the boundary; aggregates then skip it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def safe_div(num, den) -> Column:
    """NULL for a zero or missing denominator."""
    return F.try_divide(col(num), col(den))


def in_range(c, lo=None, hi=None) -> Column:
    """Closed range with open bounds as None; a missing value fails."""
    c = col(c)
    ok = c.isNotNull() & ~F.isnan(c.cast("double"))
    if lo is not None:
        ok = ok & (c >= F.lit(lo))
    if hi is not None:
        ok = ok & (c <= F.lit(hi))
    return F.coalesce(ok, F.lit(False))


def wrap360(deg) -> Column:
    return F.pmod(col(deg).cast("double"), F.lit(360.0))


def arc_width(lo_deg: float, hi_deg: float) -> float:
    """Degrees covered going forward from lo to hi; a zero width is the full circle."""
    return (float(hi_deg) - float(lo_deg)) % 360.0 or 360.0


def in_arc(theta, lo_deg: float, hi_deg: float) -> Column:
    theta = col(theta)
    inside = wrap360(theta - F.lit(float(lo_deg))) <= F.lit(arc_width(lo_deg, hi_deg))
    return F.coalesce(theta.isNotNull() & ~F.isnan(theta) & inside, F.lit(False))


def circular_abs_diff(a, b) -> Column:
    """Smallest angle between two directions in degrees."""
    return F.abs(wrap360(col(a) - col(b) + F.lit(180.0)) - F.lit(180.0))


def accepted(p_exist, gate: float = SPOT_GATE) -> Column:
    """A spot counts when nobody scored it or its score reaches the gate."""
    p = col(p_exist)
    return p.isNull() | F.isnan(p) | (p >= F.lit(float(gate)))


def z_status(c) -> Column:
    c = col(c)
    return F.when(c.isin(*Z_STATUSES), c).otherwise(F.lit("not_fit"))


def from_learned_engine(p_exist, status) -> Column:
    p = col(p_exist)
    return F.coalesce(p.isNotNull() & ~F.isnan(p) & (col(status) == "accepted"), F.lit(False))


def planes_from_end(z, depth) -> Column:
    """Planes to the nearer face of the stack, never below zero."""
    z, depth = col(z), col(depth)
    zero = F.lit(0.0)
    return F.when(depth > 0, F.least(F.greatest(z, zero), F.greatest(depth - 1 - z, zero))).otherwise(zero)


def euclid(dims: str, prefix_a: str, prefix_b: str) -> Column:
    """Distance between two (y_um, x_um[, z_um]) points named by prefix."""
    axes = {"xyz": ("y_um", "x_um", "z_um"), "xy": ("y_um", "x_um")}[dims]
    total = None
    for axis in axes:
        diff = F.col(prefix_a + axis) - F.col(prefix_b + axis)
        total = diff * diff if total is None else total + diff * diff
    return F.sqrt(total)


def fov_key(fov, letter: str, ident) -> Column:
    """`F007-C12`-style key; only the field of view is padded."""
    f = col(fov).cast("string")
    padded = F.when((col(fov) >= 0) & (col(fov) < 100), F.lpad(f, 3, "0")).otherwise(f)
    return F.concat(F.lit("F"), padded, F.lit(f"-{letter}"), col(ident).cast("string"))


def closed_bin(value, lo: float, hi: float, n: int) -> Column:
    """Equal-width bin 0..n-1 over [lo, hi]; the last bin is closed, outside is NULL."""
    v = col(value)
    raw = F.floor((v - F.lit(float(lo))) * F.lit(float(n)) / F.lit(float(hi - lo))).cast("int")
    return F.when((v >= F.lit(float(lo))) & (v <= F.lit(float(hi))), F.least(raw, F.lit(n - 1)))


def r(c, places: int = 6) -> Column:
    """Rounded double, for results that are compared across engines."""
    return F.round(col(c), places)


def reduce_all(flags: list[Column]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def reduce_any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out
