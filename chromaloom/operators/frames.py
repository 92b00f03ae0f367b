"""Coordinate frames: resolve every spot's transform by joins, then apply it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import affine

from chromaloom.session import checked_broadcast, cut

from .stats import exact_quantiles


def attach_layers(rows: DataFrame, within: DataFrame, bridges: DataFrame, entries: DataFrame | None = None,
                  anchors: DataFrame | None = None, cell_bridges: DataFrame | None = None) -> DataFrame:
    """rows(fov, cell, modality, hybe, ...) with the nullable layer columns.

    FOV layers have one row per (fov, modality[, hybe]); cell layers one per cell.
    What depends only on a layer (a cell entry carried through its anchor) is
    composed on the layer's own table, before it meets the rows. FOV layers are
    broadcast when their counted size allows, and shuffled otherwise.
    """
    out = rows.join(checked_broadcast(within), ["fov", "modality", "hybe"], "left").join(
        checked_broadcast(bridges), ["fov", "modality"], "left")
    kind = out.schema["h_within"].dataType
    none = {n: F.lit(None).cast(kind) for n in ("h_cell", "h_anchor", "h_placed", "h_move")}
    if entries is not None:
        placed = affine.compose(affine.of("h_anchor"), affine.of("h_cell"))
        carried, staged = placed.stage(entries.join(checked_broadcast(anchors), ["fov", "modality"], "left"), "__p")
        carried, back = affine.inverse(affine.of("h_anchor")).stage(carried, "__b")
        known = F.col("h_anchor").isNotNull()
        carried = carried.select(*entries.columns, "h_anchor", F.when(known, staged.struct()).alias("h_placed"),
                                 F.when(known, affine.compose(staged, back).struct()).alias("h_move"))
        # homeless rows have no cell entry: they skip the shuffle on their one shared key
        housed = out.where(F.col("cell") >= 0).join(carried, ["fov", "cell", "modality", "hybe"], "left")
        out = housed.unionByName(out.where(F.col("cell") < 0), allowMissingColumns=True)
    else:
        out = out.withColumns({**none, "dz_cell": F.lit(None).cast("double"), "yx_is_residual": F.lit(None).cast("boolean")})
    if cell_bridges is not None:
        out = out.join(cell_bridges, ["fov", "cell", "modality"], "left")
    else:
        out = out.withColumns({"h_cell_bridge": F.lit(None).cast(kind), "dz_cell_bridge": F.lit(None).cast("double")})
    return out


def to_shared(layered: DataFrame, shared: str, prefix: str = "h") -> tuple[DataFrame, affine.Affine]:
    """The affine into the shared frame, staged from the attached layers.

    A layer that was never computed is identity. A residual cell entry is
    conjugated by its anchor and re-composed onto the FOV route; an older entry
    already holds the whole way to the anchor.
    """
    def stage(df, h, name):
        return h.stage(df, f"__{prefix}_{name}")

    own = F.col("modality") == shared
    bridge = affine.choose(own, affine.identity(), affine.or_identity("h_bridge"))
    cell_bridge = affine.or_identity("h_cell_bridge")
    df, fov = stage(layered, affine.compose(bridge, affine.or_identity("h_within")), "fov")
    df, route = stage(df, affine.compose(cell_bridge, fov), "route")
    usable = F.col("h_cell").isNotNull() & F.col("h_anchor").isNotNull()
    residual = F.coalesce(F.col("yx_is_residual"), F.lit(False))
    by_cell = affine.choose(residual, affine.compose(affine.of("h_move"), route), affine.compose(cell_bridge, affine.of("h_placed")))
    return affine.choose(usable, by_cell, route).stage(df, prefix)


def z_to_shared(shared: str) -> Column:
    zero = F.lit(0.0)
    bridge = F.when(F.col("modality") == shared, zero).otherwise(F.coalesce(F.col("dz_bridge"), zero))
    return F.coalesce(F.col("dz_cell"), zero) + F.coalesce(F.col("dz_cell_bridge"), zero) + bridge


def missing_layers(shared: str) -> Column:
    """Names of the layers that defaulted to identity."""
    whole = F.col("h_cell").isNotNull() & F.col("h_anchor").isNotNull() & ~F.coalesce(F.col("yx_is_residual"), F.lit(False))
    return F.array_compact(F.array(
        F.when(F.col("h_cell").isNotNull() & F.col("h_anchor").isNull(), F.concat(F.lit("cell-anchor:"), "modality")),
        F.when(~whole & F.col("h_within").isNull(), F.concat(F.lit("same-modality:"), "modality", F.lit("/"), "hybe")),
        F.when(~whole & F.col("h_bridge").isNull() & (F.col("modality") != shared),
               F.concat(F.lit("cross-modal:"), "modality", F.lit("->"), F.lit(shared)))))


def project(layered: DataFrame, shared: str, keep: list[str]) -> DataFrame:
    """adj_y, adj_x, adj_z and the missing-layer list of every row.

    A spot with z exactly 0 before and after is a 2-D placeholder and keeps 0.
    """
    own = F.col("modality") == shared
    usable = F.col("h_cell").isNotNull() & F.col("h_anchor").isNotNull()
    residual = usable & F.coalesce(F.col("yx_is_residual"), F.lit(False))
    # the point is carried through the layers one by one; no matrix is built per spot
    whole = usable & ~residual
    start = affine.choose(whole, affine.of("h_placed"), affine.or_identity("h_within"))
    bridge = affine.choose(own | whole, affine.identity(), affine.or_identity("h_bridge"))
    last = affine.choose(residual, affine.of("h_move"), affine.identity())
    df, y, x = layered, "raw_y", "raw_x"
    for k, h in enumerate((start, bridge, affine.or_identity("h_cell_bridge"), last)):
        df = df.withColumns({f"__y{k}": h.y(y, x), f"__x{k}": h.x(y, x)})
        y, x = f"__y{k}", f"__x{k}"
    z = F.col("raw_z") + z_to_shared(shared)
    if "stored_z" in layered.columns:
        z = F.when((F.col("raw_z") == 0) & (F.col("stored_z") == 0), F.lit(0.0)).otherwise(z)
    return df.select(*keep, F.col(y).alias("adj_y"), F.col(x).alias("adj_x"), z.alias("adj_z"), missing_layers(shared).alias("missing"))


def transform_between(src: DataFrame, dst: DataFrame, keys: list[str], shared: str) -> DataFrame:
    """Per key: the affine `h` and dz from the source layers' frame into the destination's."""
    a, ha = to_shared(src, shared, "s")
    b, hb = to_shared(dst, shared, "t")
    both = a.select(*keys, *ha, z_to_shared(shared).alias("z_src")).join(b.select(*keys, *hb, z_to_shared(shared).alias("z_dst")), keys)
    both, back = affine.inverse(hb).stage(both, "back")
    return both.select(*keys, affine.compose(back, ha).struct().alias("h"), (F.col("z_src") - F.col("z_dst")).alias("dz"))


def infer_hub(modalities: DataFrame, bridges: DataFrame) -> str:
    """The one modality without a bridge of its own; more or none is an error."""
    free = modalities.select("modality").distinct().join(bridges.select("modality").distinct(), "modality", "left_anti")
    names = [r["modality"] for r in free.limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"cannot infer the shared modality from {names}")
    return names[0]


def shift_stats(rows: DataFrame, new: tuple[str, str], old: tuple[str, str], by: list[str]) -> DataFrame:
    """n, median, p90 and max of the in-plane move, per group."""
    # kept, as several passes read it and each would attach the layers again
    moved = cut(rows.select(*by, F.hypot(F.col(new[0]) - F.col(old[0]), F.col(new[1]) - F.col(old[1])).alias("shift")))
    return exact_quantiles(moved, by, "shift", {"median": 0.5, "p90": 0.9, "max": 1.0})


def z_consensus(entries: DataFrame, min_cells: int = 8) -> DataFrame:
    """Refused z fits take the median accepted dz of their (fov, modality, hybe), when enough cells agree."""
    keys = ["fov", "modality", "hybe"]
    med = exact_quantiles(entries.where(~F.col("z_rejected")), keys, "dz", {"consensus": 0.5})
    usable = (F.col("n") >= min_cells) & (F.col("consensus") != 0)
    joined = entries.join(checked_broadcast(med), keys, "left")
    applied = F.col("z_rejected") & F.coalesce(usable, F.lit(False))
    return joined.select(*entries.columns, F.when(applied, F.col("consensus")).otherwise(F.col("dz")).alias("dz_used"),
                         applied.alias("imputed"))


def map_points(points: DataFrame, matrices: DataFrame, inverse: bool = False, strict: bool = True) -> DataFrame:
    """points(.., fov, modality, hybe, y, x) with ref_y, ref_x in the reference frame.

    With `inverse` (y, x) is a reference place and raw_y, raw_x are where it lies in the round's own
    frame. A round without a matrix is an error, or with strict=False a NULL place.
    """
    keys = ["fov", "modality", "hybe"]
    m = checked_broadcast(matrices.select(*keys, F.col("h_within").alias("__h")))
    df, h = affine.of("__h").stage(points.join(m, keys, "left"), "__m")
    if inverse:
        df, h = affine.inverse(h).stage(df, "__i")
    missing = F.raise_error(F.concat(F.lit("no alignment matrix for "), F.col("hybe"))).cast("double") if strict else F.lit(None).cast("double")
    y, x = ("raw_y", "raw_x") if inverse else ("ref_y", "ref_x")
    has = F.col("__h").isNotNull()
    return df.select(*points.columns, F.when(has, h.y("y", "x")).otherwise(missing).alias(y), F.when(has, h.x("y", "x")).otherwise(missing).alias(x))
