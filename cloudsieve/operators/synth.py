"""Synthetic surface defects and pseudo-test samples built from normal clouds only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import apply_pose, dbl, dist3, hash01, hash_normal, norm3
from ..session import cut_lineage
from .descriptors import normals
from .preprocess import CAP_THRESHOLD, XYZ, centroid_scale, facing

# Defect radius as a share of the object radius, amplitude as a share of the defect
# radius, share of the radius a displacement must reach to count, neighbours of a surface normal.
RADIUS_RANGE, AMPLITUDE_RANGE = (0.04, 0.12), (0.25, 0.6)
LABEL_SHARE, SURFACE_NEIGHBOURS, MIN_SELECTED = 0.01, 20, 3
POSE_KEEP, POSE_SHIFT = 0.9, 0.05


def _between(u, low: float, high: float):
    return F.lit(low) + u * F.lit(high - low)


def draw_defects(points: DataFrame, keys: Sequence[str], seed: int, id_col: str = "point_idx") -> DataFrame:
    """Parameters of one defect per cloud: centre point, radius, signed amplitude, kind, object scale."""
    keys = list(keys)
    tag = lambda t: hash01(F.lit(str(seed)), *[F.col(k) for k in keys], F.lit(t))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(id_col).cast("string")))
    centre = points.groupBy(*keys).agg(*[F.min_by(dbl(c), order).alias(f"c{c}") for c in XYZ])
    scale = centroid_scale(points, keys).select(
        *keys, F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)).alias("scale"))
    out = centre.join(scale, keys).withColumn("kind", F.when(tag("kind") < 0.5, "bulge").otherwise("dent"))
    out = out.withColumn("r", _between(tag("radius"), *RADIUS_RANGE) * F.col("scale"))
    sign = F.when(F.col("kind") == "bulge", 1.0).otherwise(-1.0)
    return out.withColumn("amp", _between(tag("amplitude"), *AMPLITUDE_RANGE) * F.col("r") * sign)


def displacement_weight(d, r):
    """Smooth profile: 1 at the centre, 0 at the radius."""
    w = F.greatest(F.lit(1.0) - (d / r) * (d / r), F.lit(0.0))
    return w * w


def inject_defect(points: DataFrame, keys: Sequence[str], seed: int, defects: DataFrame | None = None,
                  id_col: str = "point_idx") -> tuple[DataFrame, DataFrame]:
    """Push the surface of every cloud out or in around its drawn centre, along the outward normal.

    Returns (points with gt, defect parameters with the share of anomalous points). A defect that
    touches fewer than three points moves nothing.
    """
    keys = list(keys)
    drawn = defects if defects is not None else draw_defects(points, keys, seed, id_col)
    surf = normals(points, keys, SURFACE_NEIGHBOURS, None, id_col).join(drawn, keys)
    w = displacement_weight(dist3(XYZ, ("cx", "cy", "cz")), F.col("r"))
    surf = cut_lineage(surf.withColumn("_w", w))
    touched = surf.groupBy(*keys).agg(F.count_if(F.col("_w") > 0).alias("_t"))
    surf = surf.join(touched, keys).withColumn(
        "_d", F.when(F.col("_t") >= MIN_SELECTED, F.col("amp") * F.col("_w")).otherwise(F.lit(0.0)))
    moved = {c: dbl(c) + F.col("_d") * F.col(f"n{c}") for c in XYZ}
    out = surf.withColumns(moved).withColumn(
        "gt", (F.abs(F.col("_d")) * norm3("nx", "ny", "nz") > LABEL_SHARE * F.col("r")).cast("float"))
    kept = [c for c in points.columns if c != "gt"]
    result = out.select(*kept, "gt")
    info = drawn.join(result.groupBy(*keys).agg(F.avg("gt").alias("frac")), keys).select(
        *keys, "kind", (F.col("r") / F.col("scale")).alias("radius"),
        (F.abs(F.col("amp")) / F.col("scale")).alias("amplitude"), "frac")
    return result, info


def random_pose(clouds: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """A uniformly random rotation per row (normalised Gaussian quaternion) as a pose array."""
    key = [F.lit(str(seed)), *[F.col(k) for k in keys]]
    out = clouds
    for a in "wxyz":
        out = out.withColumn(f"_{a}", hash_normal(*key, F.lit("q" + a)))
    length = F.sqrt(sum((F.col(f"_{a}") * F.col(f"_{a}") for a in "wxyz"), F.lit(0.0)))
    out = out.withColumn("_l", length)
    w, x, y, z = (F.col(f"_{a}") / F.col("_l") for a in "wxyz")
    one, two, zero = F.lit(1.0), F.lit(2.0), F.lit(0.0)
    entries = [
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w), zero,
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w), zero,
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y), zero,
        zero, zero, zero, one]
    return out.withColumn("pose", F.array(*entries)).drop("_w", "_x", "_y", "_z", "_l")


def pseudo_normals(sources: DataFrame, keys: Sequence[str], n: int, mode: str, seed: int,
                   rank: str = "source_rank") -> DataFrame:
    """n normal samples per group, made from its sources in turn.

    Modes: ``pose`` (random rigid pose and shift, 90 % of the points), ``view`` (single-view cap in a
    random pose), ``as_is``. ``sources`` holds points with a source position 0 .. m-1 in ``rank``.
    """
    keys = list(keys)
    size = sources.groupBy(*keys).agg((F.max(rank) + 1).alias("_m"))
    plan = size.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        rank, F.pmod(F.col("sample"), F.col("_m")))
    rows = sources.join(plan.drop("_m"), [*keys, rank])
    by = [*keys, "sample"]
    if mode == "as_is":
        return rows
    key = [F.lit(str(seed)), *[F.col(k) for k in by]]
    if mode == "pose":
        rows = rows.where(hash01(*key, F.col("point_idx")) < POSE_KEEP)
    elif mode != "view":
        raise ValueError(mode)
    stats = rows.groupBy(*by).agg(
        *[F.avg(dbl(c)).alias(f"m{c}") for c in XYZ],
        F.greatest(*[F.max(dbl(c)) - F.min(dbl(c)) for c in XYZ]).alias("_span"))
    stats = random_pose(stats, by, seed)
    for a in "xyz":
        stats = stats.withColumn(f"_u{a}", hash_normal(*key, F.lit("v" + a))).withColumn(
            f"_s{a}", hash_normal(*key, F.lit("s" + a)) * POSE_SHIFT * F.col("_span"))
    rows = rows.join(stats, by)
    if mode == "view":
        rel = [dbl(c) - F.col(f"m{c}") for c in XYZ]
        length = norm3("_ux", "_uy", "_uz")
        rows = rows.where(facing(*rel, ("_ux", "_uy", "_uz")) / length > CAP_THRESHOLD)
        again = rows.groupBy(*by).agg(*[F.avg(dbl(c)).alias(f"m{c}") for c in XYZ])
        rows = rows.drop("mx", "my", "mz").join(again, by)
    turned = apply_pose([dbl(c) - F.col(f"m{c}") for c in XYZ], "pose")
    shift = [F.col(f"_s{a}") if mode == "pose" else F.lit(0.0) for a in "xyz"]
    rows = rows.withColumns({c: t + F.col(f"m{c}") + s for c, t, s in zip(XYZ, turned, shift)})
    return rows.select(*dict.fromkeys([*by, *sources.columns]))


def pseudo_tests(sources: DataFrame, keys: Sequence[str], n: int, mode: str, seed: int) -> DataFrame:
    """n pseudo-normals and a defective copy of each, as test points (cloud_id, label, path, gt)."""
    keys = list(keys)
    normal = pseudo_normals(sources, keys, n, mode, seed)
    by = [*keys, "sample"]
    base = cut_lineage(normal.select(*by, "point_idx", *XYZ))
    broken, info = inject_defect(base, by, seed)
    name = lambda prefix: F.format_string(f"{prefix}_%02d", F.col("sample"))
    good = base.withColumn("gt", F.lit(0.0).cast("float")).withColumn("label", F.lit(0)).withColumn(
        "path", name("pseudo_normal"))
    bad = broken.join(info.select(*by, "kind", "radius"), by).withColumn("label", F.lit(1)).withColumn(
        "path", F.format_string("pseudo_defect_%02d_%s_r%.3f", F.col("sample"), F.col("kind"), F.col("radius")))
    both = good.unionByName(bad.drop("kind", "radius"))
    return both.withColumn("cloud_id", F.col("path")).drop("sample")
