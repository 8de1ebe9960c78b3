"""Exact nearest-neighbour and radius joins without cross joins.

References of a group are packed into spatial tiles by quantile cuts (x, then y within an x slab,
then z), so a tile holds about ``tile_rows`` rows however the data clusters. A query is first
answered inside its home tile; the distance of its k-th hit there bounds the true one, and only
tiles whose bounding box lies within that bound are visited afterwards. Tiles and query sets larger
than ``tile_rows`` (equal positions cannot be cut apart) are split by a hash of the id, so no task
ever holds more than ``tile_rows`` rows of either side. Groups that fit one tile skip all of this;
small ones are dealt into lots of about ``tile_rows`` rows that share a call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..functions.expr import dbl
from ..session import rewritten, spread

TILE_ROWS = 4096
_CELLS = 1 << 22


@dataclass(frozen=True)
class Block:
    """Queries by references of one block: squared position and feature distances (infinite where excluded)."""

    d: np.ndarray
    f: np.ndarray | None
    q_feat: np.ndarray | None
    r_feat: np.ndarray | None
    q: pa.Table
    r: pa.Table

    def nearest(self, value: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Column of the smallest finite value per query, and its feature distance taken by differences."""
        at = value.argmin(axis=1)
        good = np.isfinite(value[np.arange(len(at)), at])
        diff = self.q_feat - self.r_feat[at]
        return at, pa.array(np.sqrt((diff * diff).sum(axis=1)), mask=~good)


@dataclass(frozen=True)
class Summary:
    """What a block reports instead of pairs: ``fn`` returns query rows and the columns named in ``fields``.

    A ``direct`` one takes the two tables instead of their distances.
    """

    fields: tuple[tuple[str, pa.DataType], ...]
    fn: Callable[..., tuple[np.ndarray, list]]
    direct: bool = False


@dataclass(frozen=True)
class Spec:
    """What one block kernel needs to know; positions are always ``_p0.._pN``."""

    k: int | None
    dims: int
    metric_vec: bool
    with_feat: bool
    exclude: bool
    radius: float | None
    payload: tuple[str, ...]
    own_id: bool = False
    carry: tuple[str, ...] = ()
    summary: bool = False
    custom: Summary | None = None


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of equal-length vectors as a 2-d double array."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    n = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1)


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; by differences in few dimensions, by a matrix product in many."""
    if a.shape[1] <= 4:
        out = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            d = a[:, i, None] - b[None, :, i]
            out += d * d
        return out
    c = b.mean(axis=0)
    a, b = a - c, b - c
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0)


def smallest_k(d: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k smallest entries per row, ascending, ties by column index."""
    n = d.shape[1]
    if k == 1:
        return d.argmin(axis=1)[:, None]
    if k >= n:
        return np.argsort(d, axis=1, kind="stable")
    part = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    val = np.take_along_axis(d, part, axis=1)
    tied = np.nonzero((d <= val.max(axis=1)[:, None]).sum(axis=1) > k)[0]
    idx = np.take_along_axis(part, np.argsort(val, axis=1, kind="stable"), axis=1)
    if len(tied):
        idx[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return idx


def _block_kernel(spec: Spec, group: Sequence[str], schema: pa.Schema):
    def reported(q: pa.Table, r: pa.Table, rows: list[np.ndarray], made: list[list]) -> pa.Table:
        at = pa.array(np.concatenate(rows))
        cols = {g: q[g].take(at) for g in group}
        cols["qid"], cols["_part"] = q["_qid"].take(at), pa.repeat(r["_part"][0], len(at))
        for i, (name, kind) in enumerate(spec.custom.fields):
            cols[name] = pa.chunked_array([pa.array(m[i], kind) for m in made], kind)
        return pa.table([cols[f.name].cast(f.type) for f in schema], schema=schema)

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if q.num_rows == 0 or r.num_rows == 0:
            return schema.empty_table()
        if spec.custom is not None and spec.custom.direct:
            rows, found = spec.custom.fn(q, r)
            return reported(q, r, [rows], [found])
        r = r.take(pa.array(np.argsort(r["_rid"].to_numpy(), kind="stable")))
        pos = lambda t: np.array([t[f"_p{i}"].to_numpy() for i in range(spec.dims)]).T.reshape(t.num_rows, spec.dims)
        qx, rx = (_matrix(q["_vec"]), _matrix(r["_vec"])) if spec.metric_vec else (pos(q), pos(r))
        qf, rf = (_matrix(q["_feat"]), _matrix(r["_feat"])) if spec.with_feat else (None, None)
        if spec.exclude:
            code = pa.chunked_array([*q["_excl"].chunks, *r["_excl"].chunks]).combine_chunks().dictionary_encode().indices
            code = code.fill_null(-1).to_numpy(zero_copy_only=False)
            qe, re_ = code[:q.num_rows], code[q.num_rows:]
        qi, ri, rank, dist, feat, count, made = [], [], [], [], [], [], []
        step = max(1, _CELLS // max(1, r.num_rows))
        for s in range(0, q.num_rows, step):
            d = _square_distances(qx[s:s + step], rx)
            if spec.exclude:
                d[qe[s:s + step, None] == re_[None, :]] = np.inf
            if spec.radius is not None:
                d[d > spec.radius * spec.radius * (1 + 1e-12)] = np.inf
            if spec.custom is not None:
                f = _square_distances(qf[s:s + step], rf) if spec.with_feat else None
                if f is not None:
                    f[np.isinf(d)] = np.inf
                rows, found = spec.custom.fn(Block(
                    d, f, qf[s:s + step] if spec.with_feat else None, rf, q.slice(s, step), r))
                qi.append(rows + s)
                made.append(found)
                continue
            if spec.summary:
                # one row per query: how many, the farthest, and the nearest feature among them
                inside = np.isfinite(d)
                n = inside.sum(axis=1)
                rows = np.nonzero(n)[0]
                near = _square_distances(qf[s:s + step], rf) if spec.with_feat else d
                near = np.where(inside, near, np.inf)[rows]
                cols = near.argmin(axis=1)
                qi.append(rows + s)
                ri.append(cols)
                rank.append(np.zeros(len(rows), dtype=np.int64))
                dist.append(np.sqrt(np.where(inside, d, -1.0)[rows].max(axis=1)) if len(rows) else np.zeros(0))
                feat.append(np.sqrt(near[np.arange(len(rows)), cols]))
                count.append(n[rows])
                continue
            if spec.k is None:
                rows, cols = np.nonzero(np.isfinite(d))
                ranks = np.zeros(len(rows), dtype=np.int64)
            else:
                idx = smallest_k(d, spec.k)
                rows = np.repeat(np.arange(idx.shape[0]), idx.shape[1])
                ranks = np.tile(np.arange(1, idx.shape[1] + 1), idx.shape[0])
                cols = idx.ravel()
                ok = np.isfinite(d[rows, cols])
                rows, cols, ranks = rows[ok], cols[ok], ranks[ok]
            if spec.metric_vec and spec.k is not None and spec.k <= 32:
                diff = qx[s + rows] - rx[cols]
                dist.append(np.sqrt((diff * diff).sum(axis=1)))
            else:
                dist.append(np.sqrt(d[rows, cols]))
            if spec.with_feat:
                feat.append(np.sqrt(_square_distances(qf[s:s + step], rf)[rows, cols]))
            qi.append(rows + s)
            ri.append(cols)
            rank.append(ranks)
        if spec.custom is not None:
            return reported(q, r, qi, made)
        qi, ri = pa.array(np.concatenate(qi)), pa.array(np.concatenate(ri))
        cols = {g: q[g].take(qi) for g in group}
        cols["qid"], cols["rid"] = q["_qid"].take(qi), r["_rid"].take(ri)
        cols["rank"] = pa.array(np.concatenate(rank).astype(np.int32))
        cols["dist"] = pa.array(np.concatenate(dist))
        if spec.with_feat:
            cols["dfeat"] = pa.array(np.concatenate(feat))
        for p in spec.payload:
            cols[p] = r[p].take(ri)
        for p in spec.carry:
            cols[p] = q[p].take(qi)
        if spec.summary:
            cols["n"] = pa.array(np.concatenate(count))
        cols["_part"] = r["_part"].take(ri)
        return pa.table([cols[f.name].cast(f.type) for f in schema], schema=schema)
    return run


def codes(tables: Sequence[pa.Table], names: Sequence[str]) -> list[np.ndarray]:
    """Numbers, from 0, of the distinct rows of ``names`` over all tables; two NULLs are equal."""
    each = [pa.chunked_array([c for t in tables for c in t[n].chunks]).combine_chunks().dictionary_encode().indices for n in names]
    rows = np.column_stack([e.fill_null(-1).to_numpy(zero_copy_only=False) for e in each])
    code = np.unique(rows, axis=0, return_inverse=True)[1].ravel().astype(np.int64)
    return np.split(code, np.cumsum([t.num_rows for t in tables])[:-1])


def _per_block(kernel, on: Sequence[str], schema: pa.Schema):
    """Run ``kernel`` on every block of a lot."""
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if q.num_rows == 0 or r.num_rows == 0:
            return schema.empty_table()
        (q, qc), (r, rc) = ((t.take(pa.array(at)).combine_chunks(), c[at]) for t, c in zip((q, r), codes([q, r], on))
                            for at in [np.argsort(c, kind="stable")])
        both = np.intersect1d(qc, rc)
        ends = [np.searchsorted(c, both, side) for c in (qc, rc) for side in ("left", "right")]
        return pa.concat_tables([schema.empty_table(), *[kernel(q.slice(a, b - a), r.slice(c, d - c)) for a, b, c, d in zip(*ends)]])
    return run


def _split(df: DataFrame, keys: list[str], id_col: str, tile_rows: int) -> DataFrame:
    """Number of hash parts per key so that a part holds about ``tile_rows`` rows."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias(f"_n{id_col}"))


def _block_join(q: DataFrame, r: DataFrame, keys: list[str], group: list[str], spec: Spec,
                tile_rows: int, small_refs: bool, small_queries: bool = False, query_rows: int | None = None, lots: int | None = None) -> DataFrame:
    """Cogroup both sides on ``keys`` in blocks of bounded size and run the kernel on each block; ``lots`` of blocks share a call."""
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    repeat = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if small_queries:
        q, r = q.withColumn("_qpart", F.lit(0)), r.withColumn("_n_qid", F.lit(1))
    else:
        nq = _split(q, keys, "_qid", query_rows or tile_rows)
        q = q.join(nq, keys).withColumn("_qpart", part("_qid", "_n_qid"))
        r = r.join(nq, keys)
    if small_refs:
        q, r = q.withColumn("_part", F.lit(0)), r.withColumn("_part", F.lit(0))
    else:
        nr = _split(r.drop("_n_qid"), keys, "_rid", tile_rows)
        q = q.join(nr, keys).withColumn("_part", repeat("_n_rid"))
        r = r.join(nr, keys).withColumn("_part", part("_rid", "_n_rid"))
    r = r.withColumn("_qpart", F.lit(0) if small_queries else repeat("_n_qid"))
    # constant columns would hide the partitioning from the planner
    on = [*keys, *([] if small_refs else ["_part"]), *([] if small_queries else ["_qpart"])]
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns if c not in ("_n_qid", "_n_rid", "_ub")])
    q, r = fresh(q), fresh(r)
    schema = _result_schema(q.schema, r.schema, group, spec)
    kernel = _block_kernel(spec, group, schema)
    if lots is not None:
        lot = F.pmod(F.xxhash64(*on), F.lit(lots))
        q, r, kernel, on = q.withColumn("_lot", lot), r.withColumn("_lot", lot), _per_block(kernel, on, schema), ["_lot"]
    q, r = spread(q, *on), spread(r, *on)
    return q.groupBy(*on).cogroup(r.groupBy(*on)).applyInArrow(kernel, from_arrow_schema(schema))


def _result_schema(q: StructType, r: StructType, group: Sequence[str], spec: Spec) -> pa.Schema:
    of = lambda side, name: to_arrow_type(side[name].dataType)
    fields = [pa.field(g, of(q, g)) for g in group]
    if spec.custom is not None:
        return pa.schema([*fields, pa.field("qid", of(q, "_qid")), *[pa.field(*f) for f in spec.custom.fields],
                          pa.field("_part", pa.int32())])
    fields += [pa.field("qid", of(q, "_qid")), pa.field("rid", of(r, "_rid")),
               pa.field("rank", pa.int32()), pa.field("dist", pa.float64())]
    if spec.with_feat:
        fields.append(pa.field("dfeat", pa.float64()))
    fields += [pa.field(p, of(r, p)) for p in spec.payload]
    fields += [pa.field(p, of(q, p)) for p in spec.carry]
    if spec.summary:
        fields.append(pa.field("n", pa.int64()))
    fields.append(pa.field("_part", pa.int32()))
    return pa.schema(fields)


def neighbours(
    queries: DataFrame,
    refs: DataFrame,
    k: int | None,
    group: Sequence[str] = (),
    q_id: str = "point_idx",
    r_id: str = "point_idx",
    pos: Sequence[str] = ("x", "y", "z"),
    r_pos: Sequence[str] | None = None,
    vec: tuple[str, str] | None = None,
    feat: tuple[str, str] | None = None,
    exclude: tuple[str, str] | None = None,
    payload: Sequence[str] = (),
    carry: Sequence[str] = (),
    radius: float | str | None = None,
    tile_rows: int = TILE_ROWS,
    summary: bool = False,
    custom: Summary | None = None,
    query_rows: int | None = None,
    tiled: bool = True,
) -> DataFrame:
    """The k nearest references of every query inside its group, or all within ``radius``.

    ``pos`` names the position columns the tiles are cut on. With ``vec`` the neighbours are ranked
    by the distance of two array columns instead, whose first three entries cut the tiles. ``feat``
    adds the distance of two further array columns as ``dfeat``. ``exclude`` drops pairs with equal
    values (own id, own object). Ties go to the smaller reference id. Result: group columns, qid,
    rid, rank, dist, [dfeat], payload columns of the reference, carry columns of the query.

    With ``custom`` blocks report what its function says, which a caller merges by qid; ``radius`` then only says
    which tiles to visit, and may name a column of the queries (infinite: all). Without ``pos`` every block is visited.
    ``query_rows`` sets how many queries meet in a task where that is to differ from ``tile_rows``. Unless ``tiled``, blocks are
    parts by a hash and every one is visited, whose function looks at the positions itself.
    """
    if k is None and radius is None:
        raise ValueError("either k or radius is needed")
    group = list(group)
    r_pos = list(r_pos or pos)
    if vec is not None:
        axes = [F.element_at(F.col(vec[0]), i) for i in (1, 2, 3)], [F.element_at(F.col(vec[1]), i) for i in (1, 2, 3)]
    else:
        axes = [F.col(c) for c in pos], [F.col(c) for c in r_pos]
    dims = len(axes[0])

    def side(df, id_name, out_id, which, extra):
        cols = [F.col(g) for g in group] + [F.col(id_name).alias(out_id)]
        cols += [dbl(c).alias(f"_p{i}") for i, c in enumerate(axes[which])]
        if vec is not None:
            cols.append(F.col(vec[which]).alias("_vec"))
        if feat is not None:
            cols.append(F.col(feat[which]).alias("_feat"))
        if exclude is not None:
            cols.append(F.col(exclude[which]).alias("_excl"))
        return df.select(*cols, *extra)

    reach = [dbl(radius).alias("_ub")] if isinstance(radius, str) else []
    q = side(queries, q_id, "_qid", 0, [*[F.col(c) for c in carry], *reach])
    r = side(refs, r_id, "_rid", 1, [F.col(p) for p in payload])
    own_id = exclude is not None and exclude[1] == r_id
    within = radius if custom is None else None
    spec = Spec(k, dims, vec is not None, feat is not None, exclude is not None, within, tuple(payload), own_id,
                tuple(carry), summary, custom)
    if not group:
        q, r = q.withColumn("_g", F.lit(0)), r.withColumn("_g", F.lit(0))
    by = group or ["_g"]
    # a few numbers decide whether any group needs tiles, splitting or company at all
    sides = q.select(*by, F.lit("q").alias("_side")).unionByName(r.select(*by, F.lit("r").alias("_side")))
    sizes = sides.groupBy(*by, "_side").count().groupBy("_side").agg(F.max("count").alias("n"), F.sum("count").alias("all"))
    sizes = sizes.collect()
    most = {row["_side"]: row["n"] for row in sizes}
    largest = most.get("r", 0)
    if largest <= tile_rows:
        whole = most.get("q", 0) <= (query_rows or tile_rows)
        lots = -(-sum(row["all"] for row in sizes) // tile_rows) if whole and largest + most.get("q", 0) < tile_rows else None
        if lots is not None:
            lots = max(lots, q.sparkSession.sparkContext.defaultParallelism)
        return _block_join(q, r, by, group, spec, tile_rows, True, whole, query_rows, lots).drop("_part")
    if not dims or not tiled:
        return _block_join(q, r, by, group, spec, tile_rows, False, query_rows=query_rows).drop("_part")
    if custom is not None and not reach:
        q = q.withColumn("_ub", F.lit(float(radius) * (1 + 1e-9)))
    return _tiled(q, r, by, group, spec, tile_rows, largest)


def _tiled(q, r, by, group, spec: Spec, tile_rows, largest) -> DataFrame:
    dims = spec.dims
    k = spec.k
    if k is not None:
        # of references at one position only the k first can be an answer (one more if own id is out)
        same = [*by, *(["_vec"] if spec.metric_vec else [f"_p{i}" for i in range(dims)])]
        if spec.exclude and not spec.own_id:
            same.append("_excl")
        first = F.row_number().over(Window.partitionBy(*same).orderBy("_rid"))
        r = r.withColumn("_c", first).where(F.col("_c") <= k + 1).drop("_c")
    most = max(2, int(np.ceil((largest / tile_rows) ** (1.0 / dims))))
    per_group = r.groupBy(*by).agg(
        F.ceil(F.pow(F.count(F.lit(1)) / F.lit(float(tile_rows)), F.lit(1.0 / dims)) - 1e-9).cast("int").alias("_s"))
    q, r = q.join(per_group, by), r.join(per_group, by)
    probs = F.array(*[F.lit(i / most) for i in range(1, most)])
    slabs: list[str] = []
    for i in range(dims):
        cuts = rewritten(r.groupBy(*by, *slabs).agg(F.percentile_approx(f"_p{i}", probs, F.lit(most * 50)).alias("_cuts")))
        below = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(f"_p{i}")))
        slab = F.floor(below * F.col("_s") / F.lit(most)).cast("int")
        name = f"_t{i}"
        q = q.join(cuts, [*by, *slabs], "left").withColumn(name, F.coalesce(slab, F.lit(-1))).drop("_cuts")
        r = r.join(cuts, [*by, *slabs]).withColumn(name, slab).drop("_cuts")
        slabs.append(name)
    q, r = q.drop("_s"), r.drop("_s")
    # both sides are read several times below: their plans must not be repeated there
    q, r = rewritten(q), rewritten(r)
    keys = [*by, *slabs]
    # boxes of whole slabs and of tiles, from one pass over the references
    box = lambda names, i: r.groupBy(*by, *names).agg(
        *[f(f"_p{j}").alias(f"_{n}{j}") for j in range(i) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    gap = lambda j: F.greatest(F.lit(0.0), F.col(f"_lo{j}") - F.col(f"_p{j}"), F.col(f"_p{j}") - F.col(f"_hi{j}"))
    home = None
    if k is not None:
        home = rewritten(_block_join(q, r, keys, [*group] if group else [], spec, tile_rows, False))
        id_by = [*group, "qid"]
        full = home.groupBy(*id_by, "_part").agg(F.max("dist").alias("_m"), F.count(F.lit(1)).alias("_n"))
        bound = full.where(F.col("_n") >= k).groupBy(*id_by).agg((F.min("_m") * (1 + 1e-9) + 1e-12).alias("_ub"))
        bound = bound.withColumnRenamed("qid", "_qid")
        q = q.join(bound, [*group, "_qid"], "left").withColumn("_ub", F.coalesce("_ub", F.lit(float("inf"))))
    elif spec.custom is None:
        q = q.withColumn("_ub", F.lit(float(spec.radius) * (1 + 1e-9)))
    far = q.select("*", *[F.col(t).alias(f"_h{i}") for i, t in enumerate(slabs)]).drop(*slabs)
    for i in range(dims):
        reach = far.join(box(slabs[:i + 1], i + 1), [*by, *slabs[:i]])
        lower = F.sqrt(sum((gap(j) * gap(j) for j in range(i + 1)), F.lit(0.0)))
        far = reach.where(lower <= F.col("_ub")).drop(*[f"_{n}{j}" for j in range(i + 1) for n in ("lo", "hi")])
    if k is not None:
        same_tile = F.lit(True)
        for i, t in enumerate(slabs):
            same_tile = same_tile & (F.col(t) == F.col(f"_h{i}"))
        far = far.where(~same_tile)
    far = far.drop("_ub", *[f"_h{i}" for i in range(dims)])
    rest = _block_join(far, r, keys, group, spec, tile_rows, False)
    if k is None:
        return rest.drop("_part")
    both = home.unionByName(rest).drop("_part", "rank")
    w = Window.partitionBy(*group, "qid").orderBy("dist", "rid")
    ranked = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lead = [*group, "qid", "rid", "rank", "dist"]
    return ranked.select(*lead, *[c for c in ranked.columns if c not in lead])


def radius_summary(queries: DataFrame, refs: DataFrame, radius: float, group: Sequence[str], q_id: str, r_id: str,
                   pos: Sequence[str] = ("x", "y", "z"), feat: tuple[str, str] | None = None,
                   exclude: tuple[str, str] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """What lies within ``radius`` of every query: n, reach (the farthest), nearest (smallest feature distance).

    Blocks report one row per query, so no pair ever leaves its task. Queries with nothing around are absent.
    """
    part = neighbours(queries, refs, None, group, q_id, r_id, pos, feat=feat, exclude=exclude, radius=radius,
                      tile_rows=tile_rows, summary=True)
    nearest = F.min("dfeat").alias("nearest") if feat is not None else F.lit(None).cast("double").alias("nearest")
    return part.groupBy(*group, "qid").agg(F.sum("n").alias("n"), F.max("dist").alias("reach"), nearest)


def smooth(scores: DataFrame, near: DataFrame, group: Sequence[str], r_id: str, values: Sequence[str],
           q_id: str = "point_idx") -> DataFrame:
    """Mean of ``values`` over the neighbours of every query (point interpolation, self-smoothing)."""
    joined = near.join(scores.withColumnRenamed(r_id, "rid"), [*group, "rid"])
    return joined.groupBy(*group, "qid").agg(*[F.avg(dbl(v)).alias(v) for v in values]).withColumnRenamed("qid", q_id)
