"""Exact top-k search by inner product: columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import quoted

#: Candidates and queries that meet in one task.
CANDIDATES = 4096
QUERIES = 1024
#: Dimensions accumulated between two compactions.
DIMENSIONS = 8
SCALE = 256


def _columns(table: pa.Table, name: str) -> np.ndarray:
    """Vectors of equal length as a matrix with one row per dimension."""
    lists = table.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).T


def best_of_block(query: np.ndarray, own: np.ndarray, vectors: np.ndarray, rows: np.ndarray, order: np.ndarray,
                  k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (column of ``query``) the positions and scores of its ``k`` best candidates in the block.

    ``vectors`` is dimension by candidate, integers. Partial products grow by blocks of dimensions; by
    Cauchy-Schwarz what is still missing is at most the product of both remaining masses. A candidate whose upper
    bound is below the k-th best lower bound is dropped and the survivors are compacted. ``order`` breaks ties.
    """
    dims, n = vectors.shape
    big = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(dims, 1)
    exact = big < 1 << 53  # then every sum of products is exact in a double
    kind = np.float64 if exact else object
    heavy = np.argsort(-np.square(vectors.astype(np.float64)).sum(1), kind="stable")
    vectors, query = np.ascontiguousarray(vectors[heavy]).astype(kind), np.ascontiguousarray(query[heavy]).astype(kind)
    steps = list(range(0, dims, DIMENSIONS)) or [0]

    def masses(m):
        squares = np.square(m.astype(np.float64))
        return [np.sqrt(squares[at + DIMENSIONS:].sum(0)) for at in steps]
    left_v, left_q = masses(vectors), masses(query)
    first = query[:DIMENSIONS].T @ vectors[:DIMENSIONS]
    out = []
    for j in range(query.shape[1]):
        alive, part = np.arange(n), first[j]
        for i, at in enumerate(steps):
            if i:
                part = part + query[at:at + DIMENSIONS, j] @ vectors[at:at + DIMENSIONS, alive]
            if not i:
                alive = np.flatnonzero(rows != own[j])
                part = part[alive]
            if len(alive) > k:
                slack = left_q[i][j] * left_v[i][alive] * (1 + 1e-9) + (1e-6 if exact else 1.0)
                near = part.astype(np.float64)
                floor = np.partition(near - slack, len(alive) - k)[len(alive) - k]
                keep = near + slack >= floor
                alive, part = alive[keep], part[keep]
        best = sorted(range(len(alive)), key=lambda a: (-part[a], order[alive[a]]))[:k] if len(alive) > 4 * k or not exact \
            else np.lexsort((order[alive], -part.astype(np.float64)))[:k]
        best = np.asarray(best, np.int64)
        out.append((alive[best], np.array([int(x) for x in part[best]], dtype=object)))
    return out


def _block(k: int):
    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        kind = (queries if len(queries) else candidates).schema.field("id").type
        schema = pa.schema([("query_row", pa.int64()), ("query_id", kind), ("vec_id", kind), ("score", pa.int64())])
        if not len(candidates) or not len(queries):
            return schema.empty_table()
        ids = candidates.column("id").combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[np.array(pc.sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
        found = best_of_block(_columns(queries, "v"), queries.column("row").to_numpy(), _columns(candidates, "v"),
                              candidates.column("row").to_numpy(), order, k)
        sizes = np.array([len(at) for at, _ in found])
        again = pa.array(np.repeat(np.arange(len(found)), sizes))
        places = np.concatenate([at for at, _ in found])
        scores = [s for _, x in found for s in x]
        return pa.Table.from_arrays([
            queries.column("row").take(again), queries.column("id").take(again), ids.take(pa.array(places)),
            pa.array(scores, pa.int64())], schema=schema)
    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v): floor(256 x) of every component; vectors that are null or hold a null or non-finite one go."""
    v = F.col(quoted(vector_col))
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), ints.alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` best other rows.

    Scores are exact integer inner products; ties go to the smaller id, null ids last. Queries are dealt into blocks and
    so are candidates; every pair of blocks is one task of bounded size that returns ``k`` rows per query, and
    the best of these are taken per query. The own row is no candidate; other rows that repeat its id are. Repeated query
    rows are queries of their own. Only vectors of the query's length are compared. Fewer candidates than ``k`` are all
    returned; an empty table gives no rows. Extra columns are not read.
    """
    rows = cut_lineage(quantised(vectors, id_col, vector_col).withColumn("dims", F.size("v")))
    asked = rows.where(F.col("id") % every == 0)
    c_blocks = 1 + rows.count() // CANDIDATES
    q_blocks = 1 + asked.count() // QUERIES
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    there = rows.withColumn("c", block(c_blocks)).withColumn("q", spread(q_blocks))
    # columns of their own: the two sides of a cogroup must not share attributes
    asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in asked.columns]).toDF(*asked.columns)
    asked = asked.withColumn("q", block(q_blocks)).withColumn("c", spread(c_blocks))
    kind = rows.schema["id"].dataType.simpleString()
    keys = ["c", "q", "dims"]
    found = there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _block(k), f"query_row long, query_id {kind}, vec_id {kind}, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
