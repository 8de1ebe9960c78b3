"""How well clouds lie on their references: distances both ways, a further fine motion, leave-one-out spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import apply_pose
from ..operators.descriptors import normals
from ..operators.neighbours import neighbours
from ..operators.prefix import ordered_totals, percentile_of
from ..operators.preprocess import XYZ, voxel_centroid, with_index
from ..operators.rigid import fit_to_planes
from ..session import cut_lineage

# Voxel, reach and iterations of the fine motion, neighbours of a plane.
FINE_VOXEL, FINE_REACH, FINE_ITERATIONS, PLANE_NEIGHBOURS = 0.01, 0.03, 60, 30
SHARES = {"res_med": 0.5, "res_p90": 0.9, "res_p99": 0.99}


def distance_shares(queries: DataFrame, refs: DataFrame, keys: Sequence[str], shares: dict[str, float],
                    q_id: str = "point_idx", r_id: str = "point_idx", exclude: tuple[str, str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of the distance of all queries to their nearest reference, per group ``keys`` and ``by`` (query columns)."""
    keys, by = list(keys), list(by)
    near = cut_lineage(neighbours(queries, refs, 1, keys, q_id, r_id, exclude=exclude, carry=by).select(*keys, *by, "dist"))
    return ordered_totals(near, [*keys, *by], "dist").groupBy(*keys, *by).agg(
        *[percentile_of(p).alias(n) for n, p in shares.items()])


def reverse_shares(surface: DataFrame, clouds: DataFrame, group: Sequence[str], cloud: str, shares: dict[str, float],
                   id_col: str = "point_idx", cloud_id: str = "point_idx") -> DataFrame:
    """Percentiles of the distance of every surface point to each cloud of its group: (group, cloud, shares).

    The surface is asked once per cloud: that many rows are the result's own input.
    """
    group = list(group)
    asked = surface.join(clouds.select(*group, cloud).distinct(), group)
    return distance_shares(asked, clouds, [*group, cloud], shares, id_col, cloud_id)


def leave_one_out(surface: DataFrame, group: Sequence[str], obj: str = "obj", id_col: str = "point_idx") -> DataFrame:
    """How far prototypes lie from each other: mean over objects of median and p90 of the distance to all others."""
    each = distance_shares(surface, surface, group, {"loo_med": 0.5, "loo_p90": 0.9}, id_col, id_col, (obj, obj), [obj])
    return each.groupBy(*group).agg(F.avg("loo_med").alias("loo_med"), F.avg("loo_p90").alias("loo_p90"))


def fine_motion(clouds: DataFrame, surface: DataFrame, group: Sequence[str], cloud: str) -> DataFrame:
    """(group, cloud, pose, ref_rot_deg, ref_trans): what a point-to-plane refinement from the identity would still move.

    Both sides are reduced to the fine voxel first.
    """
    group = list(group)
    keys = [*group, cloud]
    src = cut_lineage(with_index(voxel_centroid(clouds, keys, FINE_VOXEL)))
    held = cut_lineage(with_index(voxel_centroid(surface, group, FINE_VOXEL)))
    held = cut_lineage(normals(held, group, PLANE_NEIGHBOURS, 4 * FINE_VOXEL))
    fits = fit_to_planes(src, held, keys, group, FINE_REACH, FINE_ITERATIONS)
    at = lambda i: F.col("pose")[i]
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (at(0) + at(5) + at(10) - 1) / 2))))
    return fits.select(*keys, "pose", turn.alias("ref_rot_deg"), F.sqrt(at(3) * at(3) + at(7) * at(7) + at(11) * at(11)).alias("ref_trans"))


def alignment_diagnostic(clouds: DataFrame, surface: DataFrame, group: Sequence[str] = ("category",), cloud: str = "cloud_id",
                         obj: str = "obj") -> DataFrame:
    """One row per registered cloud: distances to the prototypes, back from them, after a fine motion, and their spread.

    ``clouds`` (group, cloud, point_idx, x, y, z) stand in the frame of ``surface`` (group, obj, point_idx, x, y, z). All
    points count.
    """
    group = list(group)
    keys = [*group, cloud]
    clouds, surface = cut_lineage(clouds.select(*keys, "point_idx", *XYZ)), cut_lineage(surface.select(*group, obj, "point_idx", *XYZ))
    asked = clouds.withColumn("_q", F.concat_ws("|", cloud, "point_idx"))
    held = surface.withColumn("_r", F.concat_ws("|", obj, "point_idx"))
    forward = distance_shares(asked, held, group, SHARES, "_q", "_r", by=[cloud])
    back = reverse_shares(held, clouds, group, cloud, {"rev_p90": 0.9}, "_r", "point_idx")
    fine = cut_lineage(fine_motion(clouds, surface, group, cloud))
    x, y, z = apply_pose(XYZ, "pose")
    moved = asked.join(fine, keys).select(*keys, "_q", x.alias("x"), y.alias("y"), z.alias("z"))
    again = distance_shares(moved, held, group, {"ref_res_med": 0.5, "ref_res_p90": 0.9}, "_q", "_r", by=[cloud])
    return forward.join(back, keys).join(again, keys).join(fine.drop("pose"), keys).join(
        leave_one_out(held, group, obj, "_r"), group, "left")


def diagnostic_summary(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of the diagnostic columns per group."""
    by = list(by)
    long = cut_lineage(rows.unpivot(by, list(values), "metric", "value"))
    return ordered_totals(long, [*by, "metric"], "value").groupBy(*by, "metric").agg(percentile_of(0.5).alias("median"))
