"""Cleaning and reduction of long point tables. Every function keeps rows keyed by ``point_idx``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import apply_pose, col, dbl, dot3, hash01, hash_normal, is_finite_point, norm3
from ..session import cut_lineage
from .prefix import hash_sample, ordered_totals, percentile_of

XYZ = ("x", "y", "z")
# Directional threshold of a visible cap, smallest usable cut, crop redraws.
CAP_THRESHOLD = 0.15
MIN_CUT_POINTS = 200
CROP_DRAWS = 20


def centroid_scale(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centroid and largest radius of every cloud (keys, mx, my, mz, scale)."""
    keys = list(keys)
    mean = points.groupBy(*keys).agg(*[F.avg(dbl(c)).alias(f"m{c}") for c in XYZ])
    radius = norm3(*[dbl(c) - F.col(f"m{c}") for c in XYZ])
    return points.join(mean, keys).groupBy(*keys).agg(
        *[F.first(f"m{c}").alias(f"m{c}") for c in XYZ], F.max(radius).alias("scale"))


def to_frame(points: DataFrame, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(p - centroid) / scale with a frame table keyed by ``keys``; a zero scale leaves the size alone."""
    s = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    out = points.join(frame, list(keys))
    for c in XYZ:
        out = out.withColumn(c, (dbl(c) - F.col(f"m{c}")) / s)
    return out.drop("mx", "my", "mz", "scale")


def normalize(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre every cloud and divide it by its largest radius."""
    return to_frame(points, centroid_scale(points, keys), keys)


def reference_frame(points: DataFrame, category: str = "category", rank: str = "cloud_rank") -> DataFrame:
    """Centroid and scale of the first prototype of every category."""
    return centroid_scale(points.where(F.col(rank) == 1), [category])


def transform(points: DataFrame, poses: DataFrame, keys: Sequence[str], pose: str = "pose") -> DataFrame:
    """Apply every cloud's rigid pose (row-major array of 16) to its points."""
    out = points.join(poses.select(*keys, pose), list(keys))
    x, y, z = apply_pose(XYZ, pose)
    return out.withColumns({"x": x, "y": y, "z": z}).drop(pose)


def drop_missing(points: DataFrame, organised: bool = True) -> DataFrame:
    """Drop non-finite rows and, in organised scans, the all-zero filler."""
    ok = is_finite_point(*XYZ)
    if organised:
        ok = ok & ((dbl("x") != 0) | (dbl("y") != 0) | (dbl("z") != 0))
    return points.where(ok)


def cell(c: str, voxel: float):
    """Grid index of a coordinate, computed in single precision."""
    v = F.col(c).cast("float") / F.lit(voxel).cast("float")
    # Spark divides in double; both operands are single-precision values, so rounding the quotient
    # back gives the single-precision division
    return F.floor(v.cast("float")).cast("long")


def voxel_first(points: DataFrame, keys: Sequence[str], voxel: float, order: str = "point_idx") -> DataFrame:
    """Keep the first row of every grid cell (smallest ``order``), with all its columns."""
    if not voxel or voxel <= 0:
        return points
    keys = list(keys)
    rest = [c for c in points.columns if c not in [*keys, order]]
    cells = points.select("*", *[cell(c, voxel).alias(f"_{c}") for c in XYZ])
    # one aggregate per column: plain numeric columns keep a hash aggregate, a struct would force a sort
    kept = cells.groupBy(*keys, "_x", "_y", "_z").agg(
        F.min(order).alias(f"_{order}"), *[F.min_by(c, order).alias(f"_{c}_first") for c in rest])
    names = {c: f"_{order}" if c == order else c if c in keys else f"_{c}_first" for c in points.columns}
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def voxel_centroid(points: DataFrame, keys: Sequence[str], voxel: float) -> DataFrame:
    """One averaged point per grid cell; the grid starts half a cell below the cloud's lower corner."""
    if not voxel or voxel <= 0:
        return points.select(*keys, *XYZ)
    keys = list(keys)
    low = points.groupBy(*keys).agg(*[F.min(dbl(c)).alias(f"l{c}") for c in XYZ])
    out = points.join(low, keys)
    cells = [F.floor((dbl(c) - (F.col(f"l{c}") - voxel / 2)) / voxel).cast("long").alias(f"_{c}") for c in XYZ]
    return out.groupBy(*keys, *cells).agg(*[F.avg(dbl(c)).alias(c) for c in XYZ]).select(
        *keys, *XYZ, F.concat_ws("_", "_x", "_y", "_z").alias("cell"))


def with_index(points: DataFrame, name: str = "point_idx", by: str = "cell") -> DataFrame:
    """Stable long id from a text key that is unique within the cloud."""
    return points.withColumn(name, F.xxhash64(by)).drop(by)


def budget(points: DataFrame, keys: Sequence[str], limit: int, seed: int = 0, order: str = "point_idx") -> DataFrame:
    """At most ``limit`` rows per cloud, a uniform choice that depends on seed, cloud and row only."""
    return hash_sample(points, keys, limit, F.lit(str(seed)), *[F.col(k) for k in keys], F.col(order))


def finalize(points: DataFrame, keys: Sequence[str], voxel: float, limit: int, seed: int = 0) -> DataFrame:
    """Voxel reduction and, if ``limit`` is not 0, the budget; ground truth follows its row and defaults to 0."""
    if "gt" not in points.columns:
        points = points.withColumn("gt", F.lit(0.0).cast("float"))
    reduced = voxel_first(points, keys, voxel)
    return budget(reduced, keys, limit, seed) if limit else reduced


def preprocess(points: DataFrame, keys: Sequence[str], voxel: float = 0.01, limit: int = 0,
               seed: int = 0) -> DataFrame:
    return finalize(normalize(points, keys), keys, voxel, limit, seed)


def facing(x, y, z, direction: Sequence):
    """Cosine between a point's direction from the origin and a view direction."""
    return dot3((x, y, z), direction) / F.greatest(norm3(x, y, z), F.lit(1e-9))


def directional_view(points: DataFrame, keys: Sequence[str], direction: Sequence[float],
                     threshold: float = CAP_THRESHOLD) -> DataFrame:
    """Points whose direction from their cloud's centroid faces ``direction``."""
    keys = list(keys)
    mean = points.groupBy(*keys).agg(*[F.avg(dbl(c)).alias(f"m{c}") for c in XYZ])
    out = points.join(mean, keys)
    rel = [dbl(c) - F.col(f"m{c}") for c in XYZ]
    return out.where(facing(*rel, [F.lit(float(d)) for d in direction]) > threshold).drop("mx", "my", "mz")


def unit_vectors(seed: int, n: int, *parts: str) -> list[tuple[float, float, float]]:
    """n repeatable random unit vectors, from hashed normals."""
    import hashlib
    import math
    out = []
    for i in range(n):
        v = []
        for axis in "xyz":
            u = [int(hashlib.md5("|".join([str(seed), *parts, str(i), axis, s]).encode()).hexdigest()[:8], 16) / 2**32
                 for s in "uv"]
            v.append(math.sqrt(-2 * math.log(max(u[0], 1e-12))) * math.cos(2 * math.pi * u[1]))
        length = math.sqrt(sum(a * a for a in v)) or 1.0
        out.append(tuple(a / length for a in v))
    return out


def hashed_directions(clouds: DataFrame, seed: int, n: int, by: Sequence[str], name: str = "draw") -> DataFrame:
    """n unit directions per row of ``clouds`` (ux, uy, uz), hashed from seed, ``by`` columns and draw."""
    out = clouds.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = [F.lit(str(seed)), *[F.col(b) for b in by], F.col(name)]
    for a in "xyz":
        out = out.withColumn(f"u{a}", hash_normal(*key, F.lit(a)))
    length = norm3("ux", "uy", "uz")
    out = out.withColumn("_len", length)
    for a in "xyz":
        out = out.withColumn(f"u{a}", F.col(f"u{a}") / F.col("_len"))
    return out.drop("_len")


def simulated_cuts(points: DataFrame, keys: Sequence[str], cuts: int, seed: int = 0, diverse: bool = True,
                   voxel: float = 0.0, proto: str = "obj", min_points: int = MIN_CUT_POINTS) -> DataFrame:
    """Single-view caps of every prototype, tagged with ``sub``; caps with too few points are dropped.

    ``diverse`` draws other directions for every prototype; without it all share the same ones.
    """
    keys = list(keys)
    clouds = points.select(*keys, proto).distinct()
    views = hashed_directions(clouds, seed + 1234, cuts, [proto] if diverse else [], "sub")
    seen = points.join(views, [*keys, proto])
    seen = seen.where(facing(*XYZ, ("ux", "uy", "uz")) > CAP_THRESHOLD).drop("ux", "uy", "uz")
    by = [*keys, proto, "sub"]
    big = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).drop("_n")
    return voxel_first(seen.join(big, by, "left_semi"), by, voxel)


def thin(points: DataFrame, keys: Sequence[str], share: float, seed: int = 0, order: str = "point_idx") -> DataFrame:
    """Keep every row with probability ``share``."""
    return points.where(hash01(F.lit(str(seed)), *[F.col(k) for k in keys], F.col(order)) < share)


def add_noise(points: DataFrame, keys: Sequence[str], std: float, seed: int = 0, order: str = "point_idx") -> DataFrame:
    """Add independent Gaussian noise of the given standard deviation to every coordinate."""
    key = [F.lit(str(seed)), *[F.col(k) for k in keys], F.col(order)]
    return points.withColumns({c: dbl(c) + std * hash_normal(*key, F.lit(c)) for c in XYZ})


def directional_crop(points: DataFrame, keys: Sequence[str], share: float, seed: int = 0,
                     draws: int = CROP_DRAWS) -> DataFrame:
    """Keep the ``share`` of a cloud that faces a random direction.

    Directions are redrawn up to ``draws`` times until at least half of the defect points stay; if
    none does, the draw that keeps most of them is used (the earliest on ties).
    """
    keys = list(keys)
    first, settled = _cropped(points, keys, share, seed, 1)
    if draws == 1:
        return first
    settled = cut_lineage(settled.where("_good").select(*keys))
    # only clouds whose first draw loses too many defect points are drawn again
    again, _ = _cropped(points.join(settled, keys, "left_anti"), keys, share, seed, draws)
    return first.join(settled, keys, "left_semi").unionByName(again)


def _cropped(points: DataFrame, keys: list[str], share: float, seed: int, draws: int) -> tuple[DataFrame, DataFrame]:
    """The best of ``draws`` crops of every cloud, and whether it keeps half of the defect points (keys, _good)."""
    mean = points.groupBy(*keys).agg(*[F.avg(dbl(c)).alias(f"m{c}") for c in XYZ], F.sum(dbl("gt")).alias("_defects"))
    views = hashed_directions(mean, seed, draws, keys)
    proj = facing(*[dbl(c) - F.col(f"m{c}") for c in XYZ], ("ux", "uy", "uz"))
    tagged = points.join(views, keys).withColumn("_proj", proj)
    cut = ordered_totals(tagged, [*keys, "draw"], "_proj").groupBy(*keys, "draw").agg(
        percentile_of(1.0 - share).alias("_cut"))
    kept = tagged.join(cut, [*keys, "draw"]).where(F.col("_proj") >= F.col("_cut"))
    quality = kept.groupBy(*keys, "draw").agg(F.sum(dbl("gt")).alias("_kept"), F.first("_defects").alias("_defects"))
    good = F.col("_kept") >= 0.5 * F.col("_defects")
    chosen = quality.groupBy(*keys).agg(F.coalesce(
        F.min(F.when(good, F.col("draw"))),
        F.max_by("draw", F.struct("_kept", -F.col("draw")))).alias("draw"), F.coalesce(F.bool_or(good), F.lit(False)).alias("_good"))
    return kept.join(chosen.drop("_good"), [*keys, "draw"], "left_semi").select(*points.columns), chosen.drop("draw")


def stride(df: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """Every s-th row in ``order``, s = max(1, size // most). ``order`` must count from 0 without gaps."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(most)))
    return df.join(n, list(keys)).where(F.pmod(col(order), step) == 0).drop("_n")


def map_sample_plan(clouds: DataFrame, category: str = "category") -> DataFrame:
    """Samples whose score maps are kept: the first two anomalous and the first normal by path."""
    w = Window.partitionBy(category, "label").orderBy("path")
    return clouds.withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= F.when(F.col("label") == 1, 2).otherwise(1)).drop("_r")
