"""Which way round a ring runs and where it starts: orientation by gene roles or by the DNA sawtooth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cycle_model import GRID, RingModel, _grid, _harmonics
from .stats import exact_quantiles

TURN = 2 * np.pi


def peaks(model: RingModel) -> dict[str, float]:
    """Angle (radians, on the grid) at which each gene's profile is highest."""
    profile = _harmonics(model.coef.shape[1] // 2) @ model.coef.T
    return dict(zip(model.genes, _grid()[profile.argmax(0)], strict=True))


def rotate(model: RingModel, shift: float, flip: bool = False) -> RingModel:
    """The frame in which the point at `shift` is 0 and, with `flip`, angles run the other way."""
    coef = np.empty_like(model.coef)
    for k in range(1, model.coef.shape[1] // 2 + 1):
        b, c = model.coef[:, 2 * k - 2], model.coef[:, 2 * k - 1]
        coef[:, 2 * k - 2] = b * np.cos(k * shift) + c * np.sin(k * shift)
        coef[:, 2 * k - 1] = (c * np.cos(k * shift) - b * np.sin(k * shift)) * (-1 if flip else 1)
    spectrum = model.spectrum
    if spectrum is not None:
        old = ((-1 if flip else 1) * _grid() + shift) % TURN
        spectrum = spectrum[np.round(old * GRID / TURN).astype(int) % GRID]
        spectrum = spectrum / spectrum.sum()
    return RingModel(model.genes, model.intercept, coef, model.alpha, model.history, spectrum)


def orient(model: RingModel, early: list[str], late: list[str]) -> tuple[RingModel, float, bool]:
    """(model, shift, flip): the early genes' mean peak at 0, the late genes' in the forward half turn."""
    at = peaks(model)
    e, l = [at[g] for g in early if g in at], [at[g] for g in late if g in at]
    if not e or not l:
        raise ValueError("orientation needs an early and a late gene of the model")

    def middle(angles):
        return float(np.arctan2(np.sin(angles).mean(), np.cos(angles).mean()))
    shift = middle(e)
    flip = (middle(l) - shift) % TURN > np.pi
    return rotate(model, shift, flip), shift, bool(flip)


def cycle_clock(table: DataFrame, smooth: int = 5) -> np.ndarray:
    """Share of the cells passed at every grid angle, from the circular histogram of phases."""
    width = 360.0 / GRID
    place = F.least(F.floor(F.col("theta_deg") / width), F.lit(GRID - 1)).cast("int")
    counts = np.zeros(GRID)
    for r in table.groupBy(place.alias("i")).count().collect():           # at most GRID rows
        counts[r["i"]] = r["count"]
    share = counts / max(counts.sum(), 1.0)
    share = np.mean([np.roll(share, k) for k in range(-(smooth // 2), smooth // 2 + 1)], axis=0)
    share = share / share.sum()
    return (np.cumsum(share) - share[0] / 2) % 1.0


def clock_column(clock: np.ndarray, theta: str = "theta_deg") -> Column:
    """A phase as elapsed share, interpolated between grid angles around the circle."""
    steps = F.array(*[F.lit(float(v)) for v in clock])
    at = F.col(theta) * (GRID / 360.0)
    low = F.floor(at).cast("int")
    here, there = F.get(steps, F.pmod(low, F.lit(GRID))), F.get(steps, F.pmod(low + 1, F.lit(GRID)))
    return here + (there - here) * (at - low)


def dna_direction(table: DataFrame, value: str, n_bins: int = 20, min_cells: int = 200, least: int = 8) -> tuple[float | None, int]:
    """(ratio, cells): the DNA curve's steepest fall over its steepest rise in cycle time.

    Content climbs slowly and halves at once, so above 1 the handedness is right and a mirror
    image reads the reciprocal. table(theta_deg, value, and optionally inside: a cell's distance
    of its ring place from the centre in median units, of which 0.5 is wanted). None with too
    few cells or more than six sparse bins.
    """
    usable = table.where(F.col("theta_deg").isNotNull() & F.col(value).isNotNull() & (F.col(value) > 0))
    if "inside" in table.columns:
        usable = usable.where("inside >= 0.5")
    n = usable.count()
    if n < min_cells:
        return None, n
    tau = clock_column(cycle_clock(usable))
    bins = F.greatest(F.least(F.floor(tau * n_bins).cast("int"), F.lit(n_bins - 1)), F.lit(0))
    medians = exact_quantiles(usable.select(bins.alias("bin"), F.col(value).alias("v")), ["bin"], "v", {"m": 0.5}, few_groups=True)
    curve = np.full(n_bins, np.nan)
    for r in medians.where(F.col("n") >= least).collect():                # at most n_bins rows
        curve[r["bin"]] = r["m"]
    good = np.flatnonzero(np.isfinite(curve))
    if len(good) < n_bins - 6:
        return None, n
    logs = np.log(np.interp(np.arange(n_bins), good, curve[good], period=n_bins))
    step = np.roll(logs, -1) - logs
    return float(-step.min() / max(step.max(), 1e-9)), n


def orient_by_dna(model: RingModel, table: DataFrame, value: str, **kw) -> tuple[RingModel, float | None, bool]:
    """(model, ratio, flipped): mirrored where the DNA says so; as it is where it cannot tell."""
    ratio, _ = dna_direction(table, value, **kw)
    if ratio is None or ratio >= 1.0:
        return model, ratio, False
    return rotate(model, 0.0, True), ratio, True
