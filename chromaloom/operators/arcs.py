"""Proposals for category arcs on the phase circle: from gene profiles, from DNA content, and the
sparse stretch right after division. The cells are read in one aggregate per proposal; what
follows is arithmetic on the curve's few bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cellcycle import phase_medians
from .cycle_model import GRID, RingModel, _harmonics, cycle_time, smooth_circle

# Fixed values of the proposers.
RISE, PLATEAU, SPARSE = 1.15, 0.85, 0.5


def _three(birth: float, s: float, g2: float) -> list[dict]:
    birth = float(birth) % 360.0
    ends = [birth, float(s) % 360.0, float(g2) % 360.0, birth]
    return [{"name": n, "start_deg": a, "end_deg": b} for n, a, b in zip(("G1", "S", "G2/M"), ends, ends[1:])]


def arcs_from_profiles(model: RingModel, roles: dict[str, str], birth_deg: float = 0.0) -> list[dict]:
    """S and G2/M begin where the mean fold profile of their genes rises through 1 before its peak."""
    f = _harmonics(model.coef.shape[1] // 2) @ model.coef.T
    fold = np.exp(f - f.mean(0))

    def rise(role: str) -> float:
        own = [k for k, g in enumerate(model.genes) if roles.get(g) == role]
        if not own:
            raise ValueError(f"no gene of the model has the role {role}")
        curve = fold[:, own].mean(1)
        back = curve[(curve.argmax() - np.arange(1, GRID + 1)) % GRID] <= 1.0
        steps = int(back.argmax()) if back.any() else 0
        return (int(curve.argmax()) - steps) % GRID * 360.0 / GRID
    return _three(birth_deg, rise("S"), rise("G2/M"))


def arcs_from_dna(table: DataFrame, value: str, birth_deg: float = 0.0, rise: float = RISE, plateau: float = PLATEAU,
                  n_bins: int = 36) -> tuple[list[dict], dict]:
    """(arcs, levels): S where the binned median leaves its 2N trough for two bins, G2/M near its top.

    table(theta_deg, value), the value already divided by its field's median where fields differ.
    The trough is the lowest three-bin mean after birth, and only a rise after it counts. A curve
    without such a rise, or with a single spike, is refused with a ValueError.
    """
    curve = phase_medians(table, value, n_bins)
    width = 360.0 / n_bins
    first = int(np.ceil((birth_deg % 360.0) / width)) % n_bins
    walk = np.roll(curve, -first)
    mean = (np.roll(walk, 1) + walk + np.roll(walk, -1)) / 3
    low = int(mean.argmin())
    base, top = float(mean[low]), float(walk.max())
    high = walk >= base * rise
    starts = [i for i in range(low, n_bins - 1) if high[i] and high[i + 1]]
    if top < base * rise or not starts:
        raise ValueError(f"the content never stays above {rise} times its trough ({base:.4g} to {top:.4g})")
    s = starts[0]
    g2 = next((i for i in range(s, n_bins) if walk[i] >= base + plateau * (top - base)), n_bins - 1)

    def at(i):
        return (first + i) % n_bins * width
    return _three(birth_deg, at(s), at(g2)), {"g1_level": base, "top": top, "trough_deg": at(low), "ratio": top / base if base > 0 else float("nan")}


def phase_density(table: DataFrame) -> np.ndarray:
    """Share of the cells at every grid angle (angle k stands for the nearest phases)."""
    place = F.pmod(F.floor(F.col("theta_deg") * (GRID / 360.0) + 0.5).cast("int"), F.lit(GRID))
    out = np.zeros(GRID)
    for r in table.where("theta_deg is not null").groupBy(place.alias("i")).count().collect():       # at most GRID rows
        out[r["i"]] = r["count"]
    if not out.sum():
        raise ValueError("no cell has a phase")
    return out / out.sum()


def post_division_end(density: np.ndarray, birth_deg: float = 0.0, level: float = SPARSE) -> float | None:
    """Angle after birth where the smoothed density is back at `level` times its median; None if it never fell below."""
    w = smooth_circle(density)
    start = int(np.ceil((birth_deg % 360.0) * GRID / 360.0)) % GRID
    full = np.roll(w, -start) >= level * np.median(w)
    if full[0] or not full.any():
        return None
    return float(((start + full.argmax()) % GRID - 0.5) * 360.0 / GRID % 360.0)


def with_post_division(arcs: list[dict], density: np.ndarray, birth_deg: float = 0.0, level: float = SPARSE,
                       share: float | None = None, name: str = "post-M") -> list[dict]:
    """The arc from birth split where the sparse stretch ends, or after `share` of the cycle's time.

    Unchanged without either, and where the split would lie outside the first arc.
    """
    end = post_division_end(density, birth_deg, level)
    if end is None and share is not None:
        clock = cycle_time(density, birth_deg)
        start = int(np.ceil((birth_deg % 360.0) * GRID / 360.0)) % GRID
        past = np.concatenate([[0.0], np.roll(clock, -start)])
        # a grid angle's share lies half a step to either side of it
        edges = (start + np.concatenate([[0.0], np.arange(GRID - 1) + 0.5, [GRID]])) * 360.0 / GRID
        end = float((np.interp(share, past, edges) - start * 360.0 / GRID + birth_deg) % 360.0)
    if end is None or not arcs:
        return arcs
    head = arcs[0]
    span, at = (head["end_deg"] - head["start_deg"]) % 360.0, (end - head["start_deg"]) % 360.0
    if not 0 < at < span:
        return arcs
    return [{"name": name, "start_deg": head["start_deg"], "end_deg": end}, {**head, "start_deg": end}, *arcs[1:]]
