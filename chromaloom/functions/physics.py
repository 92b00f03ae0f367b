"""Chain-law scoring of locus pairs as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


@dataclass(frozen=True)
class ChainLaw:
    """Fixed default calibration values; a store measures its own."""

    a: float = 0.0572
    alpha: float = 0.267
    sigma_xy: float = 0.031
    sigma_z: float = 0.076
    tau_xy: float = 0.685
    tau_z: float = 1.177
    mix: float = 0.32


def chain_variance(law: ChainLaw, s_kb: Column) -> tuple[Column, Column]:
    spread = F.lit(law.a) * F.pow(F.greatest(s_kb, F.lit(1e-6)), F.lit(law.alpha))
    return spread * spread + 2.0 * law.sigma_xy**2, spread * spread + 2.0 * law.sigma_z**2


def log_density(dy, dx, dz, v_xy, v_z) -> Column:
    quad = (col(dy) * col(dy) + col(dx) * col(dx)) / v_xy + col(dz) * col(dz) / v_z
    return F.lit(-1.5 * math.log(2.0 * math.pi)) - quad / 2.0 - F.ln(v_xy) - F.ln(v_z) / 2.0


def _weighted(law, dy, dx, dz, s_kb) -> tuple[Column, Column]:
    s = col(s_kb).cast("double")
    chain = F.lit(math.log(1.0 - law.mix)) + log_density(dy, dx, dz, *chain_variance(law, s))
    other = F.lit(math.log(law.mix)) + log_density(dy, dx, dz, F.lit(law.tau_xy**2), F.lit(law.tau_z**2))
    return chain, other


def pair_cost(dy, dx, dz, s_kb, law: ChainLaw = ChainLaw()) -> Column:
    """Negative log of the chain / contaminant mixture."""
    chain, other = _weighted(law, dy, dx, dz, s_kb)
    top = F.greatest(chain, other)
    return -(top + F.ln(F.exp(chain - top) + F.exp(other - top)))


def p_same_chain(dy, dx, dz, s_kb, law: ChainLaw = ChainLaw()) -> Column:
    chain, other = _weighted(law, dy, dx, dz, s_kb)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(other - chain))


def saturation_um(s_kb, law: ChainLaw = ChainLaw(), axis: str = "xy") -> Column:
    """Separation where both components weigh the same; NULL where they never cross."""
    v_xy, v_z = chain_variance(law, col(s_kb).cast("double"))
    v_chain, v_other = (v_xy, law.tau_xy**2) if axis == "xy" else (v_z, law.tau_z**2)
    gap = F.lit(math.log(law.mix / (1.0 - law.mix))) + F.ln(F.lit(v_other) / v_chain) / 2.0
    square = F.lit(2.0) * gap / (F.lit(1.0) / v_chain - F.lit(1.0 / v_other))
    return F.when((v_chain < v_other) & (square > 0), F.sqrt(F.abs(square)))


def clutter_price(volume, n) -> Column:
    """ln(V / max(n, 1))."""
    return F.ln(col(volume) / F.greatest(col(n), F.lit(1)))
