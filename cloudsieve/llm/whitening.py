"""Embedding whitening by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Magnitude from which a scaled entry is no exact double and so has no exact long.
TOO_LARGE = float(1 << 53)
#: Gram passes end when the rows are orthonormal to this; a third pass normally is.
ORTHONORMAL = 1e-12
MOST_PASSES = 8
#: Gram eigenvalues up to this are directions without any spread.
NOTHING = 1e-28
#: Rows that one step of a task turns into doubles.
ROWS = 8192
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Whitening:
    """What the fit knows: ``n`` vectors of ``dims`` entries with exact sums, and the factor R of the centred rows.

    ``axes`` holds one unit eigenvector per column, by falling ``eigenvalues`` of the covariance. Beyond ``rank`` the
    eigenvalues are zero within rounding. ``passes`` counts Gram passes and ``departure`` is the largest distance
    of the last one's eigenvalues from 1, directions without spread apart.
    """

    n: int
    dims: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    total: float
    rank: int
    passes: int
    departure: float


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums`` per entry, in 64-bit integers where these hold it and in Python integers otherwise."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max(map(abs, sums), default=0) // n)
    if n * (top + 1) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, by substitution over the columns."""
    q = np.ascontiguousarray(rows.T)
    for r in factors:
        for j in range(len(r)):
            if j:
                q[j] -= r[:j, j] @ q[:j]
            q[j] /= r[j, j]
    return q.T


def _centred(column: pa.Array, n: int, dims: int, sums: tuple[int, ...]):
    """Centred rows as doubles, by steps: the difference is exact before it is divided."""
    for at in range(0, len(column), ROWS):
        yield exact_deviations(_integers(column.slice(at, ROWS), dims), n, sums).astype(np.float64) / n


def _gram(rows: DataFrame, dims: int, transform, shape: int) -> np.ndarray:
    """Sum over all rows of q q', q being what ``transform`` makes of a batch; each task sends one triangle."""
    upper = np.triu_indices(shape)

    def run(batches):
        total = np.zeros((shape, shape))
        for batch in batches:
            for q in transform(batch.column(0)):
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])],
                                         names=["place", "value"])
    parts = rows.select("x").mapInArrow(run, "place int, value double")
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((shape, shape))
    places = found["place"].to_numpy()
    out[upper[0][places], upper[1][places]] = found["value"]
    return out + np.triu(out, 1).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows`` (x array<long>, all of one length); None without rows.

    Shifted Cholesky QR: the Gram matrix G of the centred rows, shifted by s = 11 (n d + d (d + 1)) u |G|, has a Cholesky factor
    whatever the condition; later passes take the Gram matrix of the rows after the triangular solves, without a shift once it
    is near the identity. The product R of the factors has the rows' singular values and right singular vectors, so its SVD
    gives components to double precision where eigenvectors of G would lose half the digits. Directions without any
    spread (constant or dependent entries) keep a singular Gram matrix; its symmetric root then takes the last factor's place.
    The driver holds matrices of entries x entries only.
    """
    at = F.posexplode("x").alias("place", "value")
    sums = rows.select(at).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sorted((r["place"], int(r["s"]), r["n"]) for r in sums.collect())
    if not found:
        return None
    n, dims = found[0][2], len(found)
    exact = tuple(s for _, s, _ in found)
    r, factors, departure, passes, last = np.eye(dims), [], np.inf, 0, np.eye(dims)
    for passes in range(1, MOST_PASSES + 1):
        def orthogonal(column, factors=tuple(factors)):
            for a in _centred(column, n, dims, exact):
                yield solved(a, factors)
        gram = _gram(rows, dims, orthogonal, dims)
        values, vectors = np.linalg.eigh(gram)
        spread = values[values > NOTHING]
        departure = float(np.abs(spread - 1).max(initial=0))
        if passes == MOST_PASSES or not len(spread) or (passes > 1 and departure <= ORTHONORMAL):
            if len(spread) < dims or departure > ORTHONORMAL:
                last = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
            break
        size = float(values[-1])
        shift = 11 * (n * dims + dims * (dims + 1)) * _EPS / 2 * size
        near = passes > 1 and len(spread) == dims and departure < 0.5
        factor = np.linalg.cholesky(gram if near else gram + min(shift, size) * np.eye(dims)).T
        factors.append(np.ascontiguousarray(factor))
        r = factor @ r
    _, values, axes = np.linalg.svd(last @ r)
    rank = int((values > max(n, dims) * _EPS * values[0]).sum()) if values[0] > 0 else 0
    kept = min(components, dims)
    eigenvalues = np.square(values) / n
    return Whitening(n, dims, exact, np.ascontiguousarray(axes[:kept].T), eigenvalues[:kept], float(eigenvalues.sum()),
                     min(rank, kept), passes, departure)


def _projected(model: Whitening):
    """Whitened rows of a batch, by steps; only components with any spread."""
    directions = model.axes[:, :model.rank] / np.sqrt(model.eigenvalues[:model.rank])
    n, dims, sums = model.n, model.dims, model.sums

    def transform(column):
        for a in _centred(column, n, dims, sums):
            yield a @ directions
    return transform


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    if not model.rank:
        return 0.0
    whiten, k = _projected(model), model.rank

    def with_one(column):
        for z in whiten(column):
            yield np.hstack([z, np.ones((len(z), 1))])
    gram = _gram(rows, model.dims, with_one, k + 1) / model.n
    mean = gram[:k, k]
    return float(np.abs(gram[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _output(model: Whitening):
    whiten, kept, rank = _projected(model), model.axes.shape[1], model.rank
    n, dims, sums = model.n, model.dims, model.sums

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = exact_deviations(_integers(part.column(1), dims), n, sums)
                if d.dtype != object and d.size and dims * max(int(d.max()), -int(d.min())) ** 2 >= 1 << 63:
                    d = d.astype(object)
                deviation = pa.array([str(int(v)) for v in np.square(d).sum(1)], pa.string())
                z = np.full((len(d), kept), np.nan)
                z[:, :rank] = np.concatenate([*whiten(part.column(1))]) if len(d) else 0
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * kept, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, lists], names=["id", "deviation", "z"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component.

    Entries become x = floor(scale * c) + offset. Vectors that are null, or hold a null, a non-finite entry or one whose scaled
    magnitude is 2^53 or more, are left out: no exact long stands for the last. The vectors of the commonest length (ties:
    the longer) are the fit list; one of another length, or without entries, comes back once with null in all columns but id.
    ``deviation`` is decimal(38, 0), the exact sum of (n x - S)^2; ``whitened`` is null for components without spread (constant or
    dependent entries, a single vector) and ``explained`` is null where nothing varies. Repeated rows and ids count and come
    back each; an empty table gives no rows; other columns are not read.

    The table of integers is written once. Every pass over it is a map with one short triangle per task, summed per place.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(quoted(vector_col))
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < TOO_LARGE))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))
    table = written(vectors.where(usable).select(F.col(quoted(id_col)).alias("id"), x.alias("x")))
    sizes = table.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head()
    dims = sizes["dims"] if sizes else 0
    rows = table.where(F.size("x") == dims)
    model = fit(rows, components) if dims else None
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [kind, "int", "long", "decimal(38,0)", "double", "double", "double"]
    others = table.where(F.size("x") != dims) if model else table
    others = others.select(F.col("id").alias("vec_id"), *[F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], types[1:])])
    if model is None:
        return others
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(e / model.total) if model.total > 0 else None).cast("double") for e in model.eigenvalues])
    done = rows.mapInArrow(_output(model), f"id {kind}, deviation string, z array<double>")
    out = done.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
    return out.unionByName(others)
