"""Hard-negative mining: branch and bound over vertically stored dimensions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fleeting, quoted, shared_folder, written

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's score.
LEAST, MOST = 50, 95
#: Candidates stored vertically and scanned together.
BLOCK = 16_384
#: Bytes and rows of the anchors that one pass over all candidates sends to every executor.
ANCHOR_BYTES = 8 << 20
ANCHORS = 16_384
#: Dimensions read between two shrinks of the candidate bitmap.
DIMENSIONS = 8
#: A vector whose squared length reaches this is left out: below, every score and every partial one is a long.
LONGEST = float(1 << 61)
_LIMIT = 1 << 62


@dataclass(frozen=True)
class Anchor:
    """An anchor with what bounds its search: a floor below which no score counts, or the windows of its positives."""

    row: int
    label: object
    v: np.ndarray
    floor: int | None = None
    windows: tuple[tuple[int, int], ...] = ()


class Block:
    """Candidates of one dimension count, one contiguous array per dimension, sorted by label; rows break ties by ``order``."""

    def __init__(self, rows: np.ndarray, labels: list, vectors: np.ndarray, order: np.ndarray):
        self.names = sorted(set(labels), key=str)
        number = {n: i for i, n in enumerate(self.names)}
        codes = np.array([number[n] for n in labels], np.int64)
        at = np.argsort(codes, kind="stable")
        self.rows, self.order, self.source = rows[at], order[at], at
        self.columns = np.ascontiguousarray(vectors[at].T)
        ends = np.searchsorted(codes[at], np.arange(len(self.names) + 1))
        self.spans = {n: (int(ends[i]), int(ends[i + 1])) for i, n in enumerate(self.names)}
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def __len__(self) -> int:
        return len(self.rows)

    def candidates(self, anchor: Anchor, same: bool) -> np.ndarray:
        """Places of the other rows with the anchor's label, or of all rows with another one."""
        a, b = self.spans.get(anchor.label, (0, 0))
        if same:
            alive = np.arange(a, b)
            return alive[self.rows[a:b] != anchor.row]
        return np.concatenate([np.arange(a), np.arange(b, len(self))])


def _contributions(v: np.ndarray, block: Block, order: np.ndarray) -> tuple[list[int], list[int]]:
    """Least and greatest total that the dimensions from each step on can still add to any score, as Python integers."""
    low, high = [0], [0]
    for d in order[::-1]:
        ends = sorted((int(v[d]) * int(block.low[d]), int(v[d]) * int(block.high[d])))
        low.append(low[-1] + ends[0])
        high.append(high[-1] + ends[1])
    clamp = lambda x: max(-_LIMIT, min(_LIMIT, x))  # noqa: E731  by Cauchy-Schwarz no true remainder is beyond
    return [clamp(x) for x in low[::-1]], [clamp(x) for x in high[::-1]]


def scan(anchor: Anchor, block: Block, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the block's candidates that can matter to the anchor.

    Dimensions are read in the order of the anchor's falling magnitudes. After every few of them the bitmap of candidates
    shrinks: what the rest can add lies between the sums of its least and greatest products. Without windows a candidate goes whose
    upper bound is below the floor or below the k-th best lower bound. With windows it stays while it may lie in one of them
    and is not below the lower bounds of k candidates that certainly do.
    """
    alive = block.candidates(anchor, same)
    if not len(alive):
        return alive, np.zeros(0, np.int64)
    order = np.argsort(-np.abs(anchor.v), kind="stable")
    low, high = _contributions(anchor.v, block, order)
    part = np.zeros(len(alive), np.int64)
    for at in range(0, max(len(order), 1), DIMENSIONS):
        for d in order[at:at + DIMENSIONS]:
            if anchor.v[d]:
                part += anchor.v[d] * block.columns[d][alive]
        step = min(at + DIMENSIONS, len(order))
        keep = _possible(anchor, part, low[step], high[step], k)
        if not keep.all():
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
    return alive, part


def _possible(anchor: Anchor, part: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    least, most = part + low, part + high

    def kth(values):
        return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None
    if not anchor.windows:
        keep = np.ones(len(part), bool) if anchor.floor is None else most >= anchor.floor
        best = kth(least)
        return keep if best is None else keep & (most >= best)
    keep = np.zeros(len(part), bool)
    for a, b in anchor.windows:
        if a > b:
            continue
        may = (most >= a) & (least <= b)
        best = kth(least[(least >= a) & (most <= b)])
        keep |= may if best is None else may & (most >= best)
    return keep


def _first(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then order."""
    return np.lexsort((order, -scores))[:k]


def window_of(score: int) -> tuple[int, int]:
    """Scores s with LEAST * score <= 100 * s <= MOST * score; empty (first above last) for negative scores."""
    return -((-LEAST * score) // 100), MOST * score // 100


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _blocks(batches):
    """Blocks of up to ``BLOCK`` candidates with their ids, one dimension count at a time."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def block(dims):
        table = pa.Table.from_batches(held.pop(dims)).combine_chunks()
        ids = table["id"].combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[np.array(pc.sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
        vectors = np.concatenate([_vectors(b, dims) for b in table.to_batches()])
        return dims, Block(table["row"].to_numpy(), table["label"].to_pylist(), vectors, order), ids
    for batch in batches:
        sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            part = batch if (sizes == dims).all() else batch.filter(pa.array(sizes == dims))
            for at in range(0, part.num_rows, BLOCK):
                held.setdefault(dims, []).append(part.slice(at, BLOCK))
                if sum(b.num_rows for b in held[dims]) >= BLOCK:
                    yield block(dims)
        while sum(b.num_rows for bs in held.values() for b in bs) >= BLOCK:  # many rare dimension counts
            yield block(max(held, key=lambda d: sum(b.num_rows for b in held[d])))
    for dims in list(held):
        yield block(dims)


def _results(schema: pa.Schema, found: list[tuple]):
    """(anchor row, window number, score, id) of what a task keeps, as one batch."""
    rows, windows, scores, ids = zip(*found) if found else ((), (), (), ())
    ids = pa.concat_arrays(ids) if ids else pa.array([], schema.field("vec_id").type)
    sizes = [len(s) for s in scores]
    scores = np.concatenate(scores) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), sizes)), pa.array(np.repeat(np.array(windows, np.int32), sizes)),
                                       ids, pa.array(scores, pa.int64())], schema=schema)


def _search(anchors, same: bool, k: int):
    """A map over candidates: the k first per anchor (and window) of a task; they bound what the task still looks at."""
    def run(batches):
        schema = None
        best: dict[tuple[int, int], tuple[np.ndarray, pa.Array]] = {}
        floors: dict[tuple[int, int], int] = {}
        for dims, block, ids in _blocks(batches):
            if schema is None:
                schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("vec_id", ids.type), ("score", pa.int64())])
            for anchor in anchors.value:
                if len(anchor.v) != dims:
                    continue
                raised = [(max(a, floors.get((anchor.row, w), a)), b) for w, (a, b) in enumerate(anchor.windows)]
                bound = Anchor(anchor.row, anchor.label, anchor.v, floors.get((anchor.row, 0)), tuple(raised))
                places, scores = scan(bound, block, same, k)
                for w, (a, b) in enumerate(raised or [(None, None)]):
                    inside = np.arange(len(places)) if a is None else np.flatnonzero((scores >= a) & (scores <= b))
                    if not len(inside):
                        continue
                    inside = inside[_first(scores[inside], block.order[places[inside]], k)]
                    kept = scores[inside], ids.take(pa.array(block.source[places[inside]]))
                    old = best.get((anchor.row, w))
                    if old is not None:
                        both = pa.table({"s": np.concatenate([old[0], kept[0]]), "i": pa.concat_arrays([old[1], kept[1]])})
                        both = both.take(pc.sort_indices(both, [("s", "descending"), ("i", "ascending")], null_placement="at_end")[:k])
                        kept = both["s"].to_numpy(), both["i"].combine_chunks()
                    best[anchor.row, w] = kept
                    if len(kept[0]) == k:
                        floors[anchor.row, w] = int(kept[0][-1])
        if best:
            yield _results(schema, [(r, w, s, i) for (r, w), (s, i) in best.items()])
    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, v): quantised vectors that take part, each with a number of its own."""
    v = F.col(quoted(vector_col))
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    length = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    return vectors.where(F.col(quoted(label_col)).isNotNull() & whole).where(length < LONGEST).select(
        F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"), scaled.alias("v"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor's positives.

    Anchors are rows whose id is divisible by ``every``. Positives are an anchor's first other rows of its label, negatives the first
    rows of other labels whose score lies in the positive's window (``LEAST`` to ``MOST`` per cent). Scores are exact integer inner
    products of floor(256 x); higher ones come first, ties by smaller id, null ids last. Rows with a null label, a null vector or a
    null or non-finite component take no part, nor do vectors so long that a score would leave 64 bits. Only vectors of
    the anchor's length are compared. Repeated rows and ids are rows of their own, so a repeated anchor gives its rows again; a
    pair without negatives gives none, and so does an empty table. Other columns are not read.

    The quantised table is written once. Anchors are taken in hashed portions of about ``ANCHOR_BYTES`` and ``ANCHORS`` rows at most, which
    every executor holds; for each portion the candidates stream through the tasks twice, positives first, in vertical
    blocks, and only the first few rows per anchor and task are shuffled. No candidate is copied or moved. The work is anchors
    times rows, which is what exact windows ask for. Portions append to a table in the shared folder.
    """
    spark = vectors.sparkSession
    table = written(usable(vectors, id_col, vector_col, label_col).withColumn("dims", F.size("v")))
    kind = table.schema["id"].dataType.simpleString()
    asked = table.where(F.col("id") % every == 0)
    found = asked.agg(F.max("dims"), F.count("*")).head()
    many = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(found[0] or 1, 1))))
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not found[1]:
        return spark.createDataFrame([], schema)
    portions = -(-found[1] // many)
    part = F.pmod(F.xxhash64("row"), F.lit(portions)).cast("int")
    dealt = written(asked.withColumn("portion", part)) if portions > 1 else asked.withColumn("portion", F.lit(0))
    path = fleeting(spark, f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}")
    out = f"anchor long, window int, vec_id {kind}, score long"
    candidates = table.select("row", "id", "label", "v")
    for number in range(portions):
        chosen = dealt.where(F.col("portion") == number).select("row", "id", "label", "v").toArrow()
        ids = dict(zip(chosen["row"].to_pylist(), chosen["id"].to_pylist()))
        anchors = [Anchor(r, n, np.array(v, np.int64)) for r, n, v in zip(*(chosen[c].to_pylist() for c in ("row", "label", "v")))]
        first = spark.sparkContext.broadcast(anchors)
        near = _ranked(candidates.mapInArrow(_search(first, True, positives), out), ["anchor"], positives)
        near = near.select("anchor", (F.col("rank") - 1).alias("window"), "vec_id", "score").collect()
        first.unpersist()
        scores: dict[int, list] = {}
        for r in sorted(near, key=lambda r: (r["anchor"], r["window"])):
            scores.setdefault(r["anchor"], []).append(r)
        second = spark.sparkContext.broadcast([
            Anchor(a.row, a.label, a.v, None, tuple(window_of(r["score"]) for r in scores[a.row])) for a in anchors if a.row in scores])
        hard = _ranked(candidates.mapInArrow(_search(second, False, negatives), out), ["anchor", "window"], negatives)
        pairs = spark.createDataFrame([(r["anchor"], r["window"], ids[r["anchor"]], r["vec_id"], r["score"]) for r in near],
                                      f"anchor long, window int, anchor_id {kind}, positive_id {kind}, positive_score long")
        hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "window"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        second.unpersist()
    return spark.read.schema(schema).parquet(path)
