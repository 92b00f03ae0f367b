"""Planar affine transforms as six double columns.

y' = yy*y + yx*x + yt and x' = xy*y + xx*x + xt. Composition, inverse and
application are closed formulas, so frame work stays inside codegen. Intermediate
transforms are staged as plain columns: a chain of compositions then grows with its
length, where one nested expression would double at every step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col


class Affine(NamedTuple):
    yy: Column
    yx: Column
    yt: Column
    xy: Column
    xx: Column
    xt: Column

    def struct(self) -> Column:
        return F.struct(*[c.cast("double").alias(f) for f, c in zip(self._fields, self)])

    def stage(self, df: DataFrame, prefix: str) -> tuple[DataFrame, "Affine"]:
        """Materialise the six entries as columns `<prefix>_yy` ... of the plan."""
        names = {f: f"{prefix}_{f}" for f in self._fields}
        return df.withColumns({names[f]: c for f, c in zip(self._fields, self)}), Affine(*[F.col(n) for n in names.values()])

    def y(self, y, x) -> Column:
        return self.yy * col(y) + self.yx * col(x) + self.yt

    def x(self, y, x) -> Column:
        return self.xy * col(y) + self.xx * col(x) + self.xt

    def theta_deg(self) -> Column:
        return F.degrees(F.atan2(self.xy, self.yy))

    def scale(self) -> Column:
        return F.hypot(self.yy, self.xy)

    def swap_axes(self) -> "Affine":
        """The same move written x-major instead of y-major."""
        return Affine(self.xx, self.xy, self.xt, self.yx, self.yy, self.yt)

    def within_bounds(self, height: float, width: float, max_translation: float, max_rotation: float) -> Column:
        """Does it move the image centre and turn it by no more than allowed?"""
        cy, cx = F.lit(height / 2.0), F.lit(width / 2.0)
        return ((F.abs(self.y(cy, cx) - cy) <= max_translation) & (F.abs(self.x(cy, cx) - cx) <= max_translation)
                & (F.abs(self.theta_deg()) <= max_rotation))


def make(**entries) -> Column:
    """A struct column of the six entries, the storage form of a transform."""
    return Affine(*[col(entries[f]) for f in Affine._fields]).struct()


def identity() -> Affine:
    return Affine(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])


def of(struct) -> Affine:
    s = col(struct)
    return Affine(*[s[f] for f in Affine._fields])


def or_identity(struct) -> Affine:
    """The stored transform, or identity where the layer was never computed."""
    return Affine(*[F.coalesce(c, i) for c, i in zip(of(struct), identity())])


def choose(flag: Column, yes: Affine, no: Affine) -> Affine:
    return Affine(*[F.when(flag, a).otherwise(b) for a, b in zip(yes, no)])


def compose(a: Affine, b: Affine) -> Affine:
    """a after b."""
    return Affine(
        a.yy * b.yy + a.yx * b.xy, a.yy * b.yx + a.yx * b.xx, a.yy * b.yt + a.yx * b.xt + a.yt,
        a.xy * b.yy + a.xx * b.xy, a.xy * b.yx + a.xx * b.xx, a.xy * b.yt + a.xx * b.xt + a.xt)


def inverse(a: Affine) -> Affine:
    det = a.yy * a.xx - a.yx * a.xy
    yy, yx, xy, xx = a.xx / det, -a.yx / det, -a.xy / det, a.yy / det
    return Affine(yy, yx, -(yy * a.yt + yx * a.xt), xy, xx, -(xy * a.yt + xx * a.xt))
