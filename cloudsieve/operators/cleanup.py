"""Background removal of organised scans: support plane and stray clusters."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import dbl, hash01, norm3
from ..session import cut_lineage, rewritten, spread
from .descriptors import smallest_axis
from .neighbours import TILE_ROWS, Block, Summary, _square_distances, codes, neighbours
from .prefix import GROUP_LIMIT, ordered_index, ordered_totals, percentile_of
from .preprocess import XYZ

# Fixed values of the cleaning rule.
MIN_BORDER_POINTS, PLANE_SHARE, PLANE_TRIALS = 100, 0.002, 1000
RESIDUAL_FACTOR, DISTANCE_SHARE = 3.0, 0.0025
MIN_CLUSTER_POINTS, CLUSTER_SHARE = 50, 0.03
CORE_NEIGHBOURS, SIZE_SHARE = 5, 0.05
#: Border points that meet all trials in one task.
BLOCK_ROWS = 1 << 14
#: Points of small clouds that share a call.
LOT_ROWS = 1 << 14


def extents(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Diagonal of every cloud's bounding box, 1 where it is a single place."""
    span = norm3(*[F.max(dbl(c)) - F.min(dbl(c)) for c in XYZ])
    return points.groupBy(*keys).agg(F.when(span > 0, span).otherwise(F.lit(1.0)).alias("extent"))


def _near_plane(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of points to planes given by unit normals and a place each."""
    return np.abs(sum(x[:, [k]] * n[:, k] - p[:, k] * n[:, k] for k in range(3)))


def _hits(keys: list[str], schema: pa.Schema):
    """Points of a block near each hypothesis."""
    def run(points: pa.Table, planes: pa.Table) -> pa.Table:
        if not points.num_rows or not planes.num_rows:
            return schema.empty_table()
        x = np.column_stack([points[c].to_numpy() for c in XYZ])
        n, p = (np.column_stack([planes[c].to_numpy() for c in names]) for names in (_NORMAL, _PLACE))
        limit, hits = planes["_limit"].to_numpy(), np.zeros(len(n), np.int64)
        step = max(1, (1 << 20) // len(n))
        for s in range(0, len(x), step):
            hits += (_near_plane(x[s:s + step], n, p) <= limit).sum(axis=0)
        return pa.table([*[planes[k] for k in keys], planes["_t"], pa.array(hits)], schema=schema)
    return run


_NORMAL, _PLACE = ("_a", "_b", "_c"), ("_px", "_py", "_pz")


def _wide_planes(rows: DataFrame, sizes: DataFrame, keys: list[str], seed: int, block_rows: int, limit: int) -> DataFrame:
    """Planes of clouds with more than ``block_rows`` border points, whose 1,000 trials are few beside their points.

    The trials of a cloud are a small table. Blocks of at most about ``block_rows`` points report how many lie near each of
    them; the best is a grouped maximum and the refit a grouped covariance.
    """
    rows = rows.join(sizes.select(*keys, "_n"), keys)
    rows = cut_lineage(ordered_index(rows, keys, ["z", "y", "x"], "_i", limit=limit))
    trials = sizes.select(*keys, "_n", "_limit", F.explode(F.sequence(F.lit(0), F.lit(PLANE_TRIALS - 1))).alias("_t"))
    corner = lambda j: F.floor(hash01(F.lit(str(seed)), *keys, F.col("_t"), F.lit(j)) * F.col("_n"))
    drawn = trials.select(*keys, "_t", "_limit", F.posexplode(F.array(*[corner(j) for j in range(3)])).alias("_j", "_i"))
    drawn = drawn.join(rows.select(*keys, "_i", *XYZ), [*keys, "_i"])
    at = lambda c, j: F.max(F.when(F.col("_j") == j, F.col(c))).alias(f"_{c}{j}")
    planes = drawn.groupBy(*keys, "_t", "_limit").agg(*[at(c, j) for j in range(3) for c in XYZ])
    side = {f"_{m}{c}": F.col(f"_{c}{j}") - F.col(f"_{c}0") for m, j in (("u", 1), ("v", 2)) for c in XYZ}
    planes = planes.withColumns(side).withColumns({
        "_a": F.col("_uy") * F.col("_vz") - F.col("_uz") * F.col("_vy"), "_b": F.col("_uz") * F.col("_vx") - F.col("_ux") * F.col("_vz"),
        "_c": F.col("_ux") * F.col("_vy") - F.col("_uy") * F.col("_vx")}).withColumn("_l", norm3(*_NORMAL)).where(F.col("_l") > 0)
    planes = cut_lineage(planes.select(*keys, "_t", "_limit", *[(F.col(c) / F.col("_l")).alias(c) for c in _NORMAL],
                                       *[F.col(f"_{c}0").alias(f"_p{c}") for c in XYZ]))
    parts = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    blocks = rows.withColumn("_part", F.pmod("_i", parts).cast("int"))
    asked = planes.join(sizes.select(*keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")), keys)
    on = [*keys, "_part"]
    fresh = lambda d: spread(d.select(*[F.col(c).alias(c) for c in d.columns]), *on).groupBy(*on)
    heads = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = to_arrow_schema(planes.select(*keys, "_t", F.lit(0).cast("long").alias("_hits")).schema)
    hits = fresh(blocks).cogroup(fresh(asked)).applyInArrow(_hits(keys, schema), f"{heads}, _t int, _hits long")
    hits = hits.groupBy(*keys, "_t").agg(F.sum("_hits").alias("_hits"))
    best = hits.groupBy(*keys).agg(F.min_by("_t", F.struct(-F.col("_hits"), F.col("_t"))).alias("_t")).join(planes, [*keys, "_t"])
    off = F.abs(sum((F.col(c) * F.col(n) - F.col(p) * F.col(n) for c, n, p in zip(XYZ, _NORMAL, _PLACE)), F.lit(0.0)))
    inner = rows.join(best, keys).where(off <= F.col("_limit"))
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    fit = inner.groupBy(*keys).agg(F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_m"), *[F.avg(c).alias(f"_m{c}") for c in XYZ])
    fit = fit.withColumn("_n", smallest_axis("_m"))
    axis = [F.col("_n")[i] for i in range(3)]
    return fit.select(*keys, *[a.alias(n) for a, n in zip(axis, ("pa", "pb", "pc"))],
                      (-sum((a * F.col(f"_m{c}") for a, c in zip(axis, XYZ)), F.lit(0.0))).alias("pw"))


def _consensus(x: np.ndarray, head: str, limit: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Normal and centre of the plane of one cloud's ordered border points, from the same trials as :func:`_wide_planes` takes."""
    drawn = [int(md5(f"{head}|{t}|{j}".encode()).hexdigest()[:8], 16) / 4294967296.0 for t in range(PLANE_TRIALS) for j in range(3)]
    corner = x[np.floor(np.array(drawn) * len(x)).astype(np.int64)].reshape(-1, 3, 3)
    n = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    length = np.sqrt((n * n).sum(axis=1))
    good = length > 0
    if not good.any():
        return None
    n, p, hits = n[good] / length[good, None], corner[good, 0], np.zeros(good.sum(), np.int64)
    step = max(1, (1 << 20) // len(n))
    for s in range(0, len(x), step):
        hits += (_near_plane(x[s:s + step], n, p) <= limit).sum(axis=0)
    best = [int(hits.argmax())]
    inner = x[_near_plane(x, n[best], p[best])[:, 0] <= limit]
    centre = inner.mean(axis=0)
    return np.linalg.eigh(np.cov(inner.T, bias=True))[1][:, 0], centre


def _planes_of_clouds(keys: list[str], schema: pa.Schema):
    """Planes of a lot of clouds; points in the order of z, y, x, absent values first."""
    def run(points: pa.Table, clouds: pa.Table) -> pa.Table:
        if not points.num_rows or not clouds.num_rows:
            return schema.empty_table()
        code, of = codes([points, clouds], keys)
        places = [k for c in XYZ for k in (points[c].to_numpy(), points[c].is_valid().to_numpy())]
        order = np.lexsort((*places, code))
        x, code = np.column_stack(places[::2])[order], code[order]
        ends = [np.searchsorted(code, of, side) for side in ("left", "right")]
        found = [_consensus(x[a:b], h, m) for a, b, h, m in zip(*ends, clouds["_head"].to_pylist(), clouds["_limit"].to_pylist())]
        at = pa.array([i for i, f in enumerate(found) if f is not None], pa.int64())
        axis, centre = (np.array([f[i] for f in found if f is not None]).reshape(-1, 3) for i in range(2))
        return pa.table([*[clouds[k].take(at) for k in keys], *axis.T, -(axis * centre).sum(axis=1)], schema=schema)
    return run


def fit_planes(border: DataFrame, extent: DataFrame, keys: Sequence[str], seed: int = 0, block_rows: int = BLOCK_ROWS,
               limit: int = GROUP_LIMIT) -> DataFrame:
    """Plane of every cloud with at least 100 border points, by consensus: keys, pa, pb, pc, pw (unit normal).

    Each trial takes three points by a hash of (seed, keys, trial, corner) in the order of z, y, x; the first trial with
    most points near its plane is refitted to those points. Border points of a cloud of at most ``block_rows`` meet in a task, which
    draws and counts its trials; small clouds are dealt into lots that share a call. Larger ones are counted in blocks.
    """
    keys = list(keys)
    sizes = border.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_BORDER_POINTS)
    sizes = rewritten(sizes.join(extent, keys).select(*keys, "_n", (F.lit(PLANE_SHARE) * F.col("extent")).alias("_limit")))
    total, largest = sizes.agg(F.sum(F.when(F.col("_n") <= block_rows, F.col("_n"))), F.max("_n")).first()
    rows = border.select(*keys, *[dbl(c).alias(c) for c in XYZ])
    small, wide = (sizes.where(c) for c in (F.col("_n") <= block_rows, F.col("_n") > block_rows))
    lots = max(-(-(total or 0) // LOT_ROWS), border.sparkSession.sparkContext.defaultParallelism)
    lot = F.pmod(F.xxhash64(*keys), F.lit(lots)).alias("_lot")
    any_wide = (largest or 0) > block_rows
    dealt = (rows.join(wide, keys, "left_anti") if any_wide else rows).select(lot, *keys, *XYZ)
    head = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).alias("_head")
    found = small.select(*keys, *[F.lit(0.0).alias(c) for c in ("pa", "pb", "pc", "pw")]).schema
    fresh = lambda d: spread(d, "_lot").groupBy("_lot")
    planes = fresh(dealt).cogroup(fresh(small.select(lot, *keys, "_limit", head))).applyInArrow(
        _planes_of_clouds(keys, to_arrow_schema(found)), found)
    if not any_wide:
        return planes
    return planes.unionByName(_wide_planes(rows, wide, keys, seed, block_rows, limit))


def remove_plane(points: DataFrame, keys: Sequence[str], border: str = "border", seed: int = 0) -> DataFrame:
    """Drop points close to the plane of the border points; clouds without a plane stay whole."""
    keys = list(keys)
    extent = extents(points, keys)
    edge = points.where(F.col(border))
    planes = cut_lineage(fit_planes(edge, extent, keys, seed))
    off = F.abs(sum((F.col(p) * dbl(c) for p, c in zip(("pa", "pb", "pc"), XYZ)), F.col("pw")))
    res = edge.join(planes, keys).withColumn("_r", off)
    med = ordered_totals(res, keys, "_r").groupBy(*keys).agg(percentile_of(0.5).alias("_m"))
    limits = med.join(extent, keys).select(
        *keys, F.greatest(RESIDUAL_FACTOR * F.col("_m"), DISTANCE_SHARE * F.col("extent")).alias("_t"))
    joined = points.join(planes.join(limits, keys), keys, "left")
    return joined.where(F.col("pa").isNull() | (off > F.col("_t"))).select(*points.columns)


def _inside(b: Block, radius: float) -> np.ndarray:
    return b.d <= radius * radius * (1 + 1e-12)


def _weight_around(radius: float) -> Summary:
    def fn(b: Block):
        return np.arange(len(b.d)), [_inside(b, radius) @ b.r["_w"].to_numpy()]
    return Summary((("_n", pa.int64()),), fn)


def _cells_around(radius: float) -> Summary:
    """Pairs of cells that hold points within the radius of each other, each pair once per block."""
    def fn(b: Block):
        rows, cols = np.nonzero(_inside(b, radius))
        mine, other = b.q["_mine"].to_numpy()[rows], b.r["_cell"].to_numpy()[cols]
        _, first = np.unique(np.stack([mine, other]), axis=1, return_index=True)
        return rows[first], [mine[first], other[first]]
    return Summary((("_a", pa.int64()), ("_b", pa.int64())), fn)


def _least_around(radius: float) -> Summary:
    def fn(b: Block):
        inside = _inside(b, radius)
        rows = np.flatnonzero(inside.any(axis=1))
        return rows, [np.where(inside[rows], b.r["cluster"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)]
    return Summary((("_t", pa.int64()),), fn)


def _clustered(x: np.ndarray, ids: np.ndarray, radius: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """Density clusters of one cloud whose ids ascend: rows that belong to one, and its smallest core id."""
    inside = _square_distances(x, x) <= radius * radius * (1 + 1e-12)
    core = inside.sum(axis=1) >= min_points
    name = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        edge = np.array([i]) if name[i] < 0 else np.zeros(0, int)
        while len(edge):
            name[edge] = i
            edge = np.flatnonzero(inside[edge].any(axis=0) & core & (name < 0))
    # names are places in ascending ids, so the least name is the least id
    touch = np.where(inside[:, core], name[core], len(x)).min(axis=1, initial=len(x))
    name = np.where(core, name, touch)
    rows = np.flatnonzero(name < len(x))
    return rows, ids[name[rows]]


def _clusters_of_lot(keys: list[str], id_col: str, radius: float, min_points: int, schema: pa.Schema):
    def run(points: pa.Table) -> pa.Table:
        code, ids = codes([points], keys)[0], points[id_col].to_numpy()
        order = np.lexsort((ids, code))
        x, ids = np.column_stack([points[c].to_numpy() for c in XYZ])[order], ids[order]
        ends = [*np.flatnonzero(np.diff(code[order], prepend=-1)), len(order)]
        found = [(rows + s, name) for s, e in zip(ends, ends[1:]) for rows, name in [_clustered(x[s:e], ids[s:e], radius, min_points)]]
        at = pa.array(order[np.concatenate([rows for rows, _ in found])])
        cluster = pa.array(np.concatenate([name for _, name in found]))
        return pa.table([*[points[c].take(at) for c in (*keys, id_col)], cluster], schema=schema)
    return run


def density_clusters(points: DataFrame, keys: Sequence[str], radius_share: float = CLUSTER_SHARE,
                     min_points: int = CORE_NEIGHBOURS, id_col: str = "point_idx", limit: int = TILE_ROWS) -> DataFrame:
    """Density clusters (keys, id, cluster) with the radius a share of the cloud's extent; noise is absent.

    Core points have at least ``min_points`` points within the radius (themselves included). Connected
    core points share a cluster, named by its smallest id; other points join a core point they touch.

    Clouds of at most ``limit`` points are clustered whole, many in one call. No pairs of points are made of larger ones:
    points are put in cells whose diagonal is the radius. A cell with ``min_points`` points
    is core throughout, other points are counted inside the blocks of the radius join; core points of a cell belong together,
    so the graph to be labelled joins cells, at most 124 per cell.
    """
    keys = list(keys)
    # NaN is no place a block could compare, cells take it as one
    odd = F.count_if(F.isnan(dbl("x")) | F.isnan(dbl("y")) | F.isnan(dbl("z")) | F.col(id_col).isNull())
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), odd.alias("_odd"))
    sizes = sizes.select(*keys, ((F.col("_n") <= limit) & (F.col("_odd") == 0)).alias("_small"), "_n")
    known = extents(points, keys).join(sizes, keys)
    # dividing by the extent makes one radius fit all clouds
    scaled = cut_lineage(points.join(known, keys).select(
        *keys, id_col, *[(dbl(c) / F.col("extent")).alias(c) for c in XYZ], "_small"))
    counts = {r["_small"]: r["count"] for r in scaled.groupBy("_small").count().collect()}
    small, large = scaled.where("_small").drop("_small"), scaled.where("NOT _small").drop("_small")
    lots = max(scaled.sparkSession.sparkContext.defaultParallelism, -(-counts.get(True, 0) // LOT_ROWS))
    schema = to_arrow_schema(small.select(*keys, id_col, F.col(id_col).alias("cluster")).schema)
    dealt = small.dropna(subset=list(XYZ)).withColumn("_lot", F.pmod(F.xxhash64(*keys), F.lit(lots)))
    run = _clusters_of_lot(keys, id_col, radius_share, min_points, schema)
    out = spread(dealt, "_lot").groupBy("_lot").applyInArrow(run, small.select(*keys, id_col, F.col(id_col).alias("cluster")).schema)
    return out.unionByName(_cell_clusters(large, keys, radius_share, min_points, id_col)) if counts.get(False) else out


def _cell_clusters(scaled: DataFrame, keys: list[str], radius_share: float, min_points: int, id_col: str) -> DataFrame:
    """Density clusters of large clouds over a graph of cells."""
    # equal positions act as one point with a weight, so copies cannot blow up the work
    places = scaled.groupBy(*keys, *XYZ).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("_w"))
    side = radius_share / 3 ** 0.5
    cell = [f"_g{c}" for c in XYZ]
    places = places.withColumns({g: F.floor(F.col(c) / side) for g, c in zip(cell, XYZ)})
    full = places.groupBy(*keys, *cell).agg(F.sum("_w").alias("_full"))
    places = cut_lineage(places.join(full, [*keys, *cell]))
    sparse = places.where(F.col("_full") < min_points)
    count = neighbours(sparse, places, None, keys, id_col, id_col, radius=radius_share, payload=["_w"],
                       custom=_weight_around(radius_share)).groupBy(*keys, "qid").agg(F.sum("_n").alias("_n"))
    some = count.where(F.col("_n") >= min_points).select(*keys, F.col("qid").alias(id_col))
    core = places.where(F.col("_full") >= min_points).unionByName(places.join(some, [*keys, id_col], "left_semi"))
    named = core.groupBy(*keys, *cell).agg(F.min(id_col).alias("_cell"))
    core = cut_lineage(core.join(named, [*keys, *cell]).select(*keys, id_col, *XYZ, "_cell"))
    met = neighbours(core.withColumn("_mine", F.col("_cell")), core, None, keys, id_col, id_col, radius=radius_share,
                     payload=["_cell"], carry=["_mine"], custom=_cells_around(radius_share))
    edges = cut_lineage(met.select(*keys, "_a", "_b").distinct())
    label = cut_lineage(core.select(*keys, F.col("_cell").alias("_a"), F.col("_cell").alias("cluster")).distinct())
    while True:
        # smallest label among the cells around, then the label of that label
        near = edges.join(label.withColumnRenamed("_a", "_b"), [*keys, "_b"]).groupBy(*keys, "_a").agg(F.min("cluster").alias("_c"))
        hop = near.select(*keys, F.col("_a").alias("_c"), F.col("_c").alias("_d"))
        new = label.join(near, [*keys, "_a"]).join(hop, [*keys, "_c"], "left")
        new = rewritten(new.select(*keys, "_a", F.least("cluster", "_c", F.coalesce("_d", "_c")).alias("_new"), "cluster"))
        moved = new.where(F.col("_new") != F.col("cluster")).limit(1).count()
        label = new.select(*keys, "_a", F.col("_new").alias("cluster"))
        if not moved:
            break
    core = cut_lineage(core.join(label.withColumnRenamed("_a", "_cell"), [*keys, "_cell"]).select(*keys, id_col, *XYZ, "cluster"))
    rest = places.join(core, [*keys, id_col], "left_anti")
    touch = neighbours(rest, core, None, keys, id_col, id_col, radius=radius_share, payload=["cluster"],
                       custom=_least_around(radius_share)).groupBy(*keys, F.col("qid").alias(id_col)).agg(F.min("_t").alias("cluster"))
    touch = places.join(touch, [*keys, id_col]).select(*keys, *XYZ, "cluster")
    return scaled.join(core.select(*keys, *XYZ, "cluster").unionByName(touch), [*keys, *XYZ]).select(*keys, id_col, "cluster")


def drop_small_clusters(points: DataFrame, keys: Sequence[str], id_col: str = "point_idx",
                        radius_share: float = CLUSTER_SHARE) -> DataFrame:
    """Keep points of clusters with at least 5 % of the largest one's points; all points are clustered.

    Clouds of 50 points or fewer, and clouds that are all noise, stay whole.
    """
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = cut_lineage(points.join(size.where(F.col("_n") > MIN_CLUSTER_POINTS), keys, "left_semi"))
    named = cut_lineage(density_clusters(big, keys, radius_share, id_col=id_col))
    count = named.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_c"))
    top = count.groupBy(*keys).agg(F.max("_c").alias("_m"))
    keep = count.join(top, keys).where(F.col("_c") >= SIZE_SHARE * F.col("_m")).select(*keys, "cluster")
    rows = named.join(keep, [*keys, "cluster"], "left_semi").select(*keys, id_col)
    cleaned = named.select(*keys).distinct()
    inside = points.join(rows, [*keys, id_col], "left_semi")
    untouched = points.join(cleaned, keys, "left_anti")
    return inside.unionByName(untouched)


def clean_scan(points: DataFrame, keys: Sequence[str], border: str = "border", seed: int = 0) -> DataFrame:
    """Plane removal, then cluster clean-up; a cloud left without points raises."""
    keys = list(keys)
    out = cut_lineage(drop_small_clusters(remove_plane(points, keys, border, seed), keys))
    lost = points.select(*keys).distinct().join(out.select(*keys).distinct(), keys, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"empty point cloud after background removal: {[tuple(r) for r in lost]}")
    return out
