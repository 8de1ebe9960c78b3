"""Paired stratified bootstrap: hashed draws become weights, replicates are columns, not rows.

How often a member of a stratum is drawn is its weight in a replicate, one byte per replicate, and the same weights serve every
channel and seed, which is what makes the comparison paired. A stratum of n members is drawn n times. Small strata turn a hash of
(seed, replicate, stratum, draw) into the drawn position. The member range of a large one is halved until the parts are small:
how many draws fall into the left half is binomial, from a generator that the node's number seeds, so every part derives
its own draws, and no task sees a stratum. Scores are sorted once per series and value range; all replicates of a block are
summed in that one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import hash_index, range_cuts, with_range
from ..session import cut_lineage, spread

#: Replicates that travel in one row, and rows of a value range that meet in one task.
BLOCK = 250
RANGE_ROWS = 50_000
#: Members of a part that draws by itself.
PART_MEMBERS = 4096
_ROWS = 4096
# Multipliers of the 32-bit mixer and of what it mixes.
MIX = (2246822507, 3266489909)
STEPS = {"b": 2654435769, "node": 3266489917, "draw": 2246822519}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit numbers (held in 64 bits)."""
    h = h ^ (h >> np.uint64(16))
    h = h * np.uint64(MIX[0]) & np.uint64(0xFFFFFFFF)
    h = h ^ (h >> np.uint64(13))
    h = h * np.uint64(MIX[1]) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(16))


def _stepped(h: np.ndarray, name: str, number: np.ndarray) -> np.ndarray:
    return mixed(h + np.uint64(STEPS[name]) * number.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def start_of(text: str, seed: int) -> int:
    """First 32 bits of the md5 of seed and stratum."""
    return int.from_bytes(md5(f"{seed}|{text}".encode()).digest()[:4], "big")


def parts_of(n: int, members: int = PART_MEMBERS) -> int:
    """Parts of a stratum, a power of two."""
    return 1 if n <= members else 1 << (-(-n // members) - 1).bit_length()


def _edge(n: int, parts: int, at: int) -> int:
    return at * n // parts


def draws_of_part(text: str, n: int, part: int, first: int, last: int, seed: int, members: int = PART_MEMBERS) -> np.ndarray:
    """How many of a stratum's n draws fall into one of its parts, per replicate: binomials on the way down from the root."""
    parts, h = parts_of(n, members), start_of(text, seed)
    count = np.full(last - first + 1, n, np.int64)
    node, low, high = 1, 0, parts
    while high - low > 1:
        middle = (low + high) // 2
        left = _edge(n, parts, middle) - _edge(n, parts, low)
        size = _edge(n, parts, high) - _edge(n, parts, low)
        fallen = np.random.Generator(np.random.Philox(key=[h, node << 32 | first])).binomial(count, left / size)
        if part < middle:
            count, node, high = fallen, 2 * node, middle
        else:
            count, node, low = count - fallen, 2 * node + 1, middle
    return count


def draw_weights(text: str, n: int, first: int, last: int, seed: int, part: int = 0, members: int = PART_MEMBERS) -> np.ndarray:
    """Weights (members x replicates ``first`` .. ``last``) of one part of the stratum named by ``text``."""
    parts = parts_of(n, members)
    size = _edge(n, parts, part + 1) - _edge(n, parts, part)
    counts = draws_of_part(text, n, part, first, last, seed, members)
    h = _stepped(np.full(len(counts), start_of(text, seed), np.uint64), "b", np.arange(first, last + 1))
    if parts > 1:
        h = _stepped(h, "node", np.full(len(h), parts + part))
    out = np.zeros((size, len(counts)), np.uint8)
    step = max(1, (1 << 20) // max(1, int(counts.max(initial=0))))
    for at in range(0, len(counts), step):
        many = counts[at:at + step]
        draw = np.arange(many.max(initial=0))
        u = _stepped(h[at:at + step, None], "draw", draw[None, :]) / 4294967296.0
        there = draw[None, :] < many[:, None]
        place = np.floor(u * size).astype(np.int64) * len(many) + np.arange(len(many))[:, None]
        w = np.bincount(place[there], minlength=size * len(many)).reshape(size, -1)
        if w.max(initial=0) > 255:
            raise OverflowError("a member is drawn more than 255 times in one replicate")
        out[:, at:at + step] = w
    return out


def _packed(row: bytes) -> bytes:
    """Weights with their byte frequencies coded: they are small numbers, so about a third is left."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(row) + coder.flush()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(r, -15) for r in rows), np.uint8).reshape(len(rows), -1)


def _weight_batches(seed: int, members: int, packed: bool):
    code = _packed if packed else bytes

    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("_text", "_n", "_last", "_p")]
            get = lambda name, i: batch.column(batch.schema.names.index(name))[i].as_py()
            for i in range(batch.num_rows):
                n, part = get("_n", i), get("_p", i)
                w = draw_weights(get("_text", i), n, get("_first", i), get("_last", i), seed, part, members)
                base = _edge(n, parts_of(n, members), part)
                for at in range(0, len(w), _ROWS):
                    rows = w[at:at + _ROWS]
                    same = pa.array(np.full(len(rows), i))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(batch.schema.names.index(c)).take(same) for c in names],
                         pa.array(np.arange(base + at, base + at + len(rows))), pa.array([code(r.tobytes()) for r in rows], pa.binary())],
                        names=[*names, "idx", "w"])
    return run


def weight_blocks(strata: DataFrame, keys: Sequence[str], replicates: int, seed: int = 0, block: int = BLOCK,
                  hashed: Sequence[str] | None = None, part_members: int = PART_MEMBERS, packed: bool = False) -> DataFrame:
    """(keys, _first, idx, w) from strata (keys, n): ``w`` has a byte per replicate from ``_first`` on, coded if ``packed``.

    ``hashed`` names the key columns that the draws depend on (default: all); strata of one size that agree in them
    share their draws.
    """
    keys = list(keys)
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"), F.lit(block).cast("long")))
    n = F.col("n").cast("long")
    halvings = F.ceil(F.log2(F.ceil(n / F.lit(part_members))) - 1e-12)
    parts = F.when(n <= part_members, F.lit(1)).otherwise(F.pow(F.lit(2.0), halvings)).cast("long")
    rows = strata.select(*keys, F.concat_ws("|", *[F.col(k).cast("string") for k in (keys if hashed is None else hashed)]).alias("_text"),
                         n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_p"))
    rows = rows.select("*", starts.alias("_first")).withColumn("_last", F.least(F.col("_first") + block - 1, F.lit(replicates)))
    rows = spread(rows, *keys, "_first", "_p")
    schema = ", ".join([*(f"{k} {strata.schema[k].dataType.simpleString()}" for k in keys), "_first long, idx long, w binary"])
    return rows.mapInArrow(_weight_batches(seed, part_members, packed), schema)


def _range_sums(by: Sequence[str]):
    def run(t: pa.Table) -> pa.Table:
        score, positive = t["score"].to_numpy(), t["label"].to_numpy() > 0
        w = _unpacked(t["w"].to_pylist())
        size = w.shape[1]
        neg = np.flatnonzero(~positive)
        neg = neg[np.argsort(score[neg], kind="stable")]
        below = np.zeros((len(neg) + 1, size), np.int32)  # weight of the negatives up to a place
        np.cumsum(w[neg], axis=0, dtype=np.int32, out=below[1:])
        pos = np.flatnonzero(positive)
        u, p, n = np.zeros(size), np.zeros(size), below[-1].astype(float)
        for at in range(0, len(pos), _ROWS):
            rows = pos[at:at + _ROWS]
            lower, upper = (np.searchsorted(score[neg], score[rows], side) for side in ("left", "right"))
            part = w[rows].astype(float)
            u += np.einsum("ij,ij->j", part, (below[lower] + below[upper]) / 2)
            p += part.sum(0)
        head = t.slice(0, 1)
        arrays = [head[c].combine_chunks() for c in (*by, "_range", "_first")]
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (u, p, n)]
        return pa.Table.from_arrays([*arrays, *lists], names=[*by, "_range", "_first", "u", "p", "n"])
    return run


def same_samples(scores: DataFrame, sample: Sequence[str], series: Sequence[str]) -> None:
    """Raise if a sample is missing in one of the series: its strata would not be the same in all."""
    expected = scores.select(*series).distinct().count()
    least = scores.select(*sample, *series).distinct().groupBy(*sample).count().agg(F.min("count")).first()[0]
    if least is not None and least != expected:
        raise ValueError(f"a sample has only {least} of {expected} series")


def bootstrap_auroc(scores: DataFrame, replicates: int, seed: int = 0, category: str = "category",
                    series: Sequence[str] = ("seed", "channel")) -> DataFrame:
    """AUROC of every series and category in every replicate (b, series, category, auroc)."""
    series = list(series)
    strata = [category, "label"]
    same_samples(scores, [*strata, "file"], series)
    members = cut_lineage(hash_index(scores.select(*strata, "file").distinct(), strata, "file"))
    weights = weight_blocks(members.groupBy(*strata).agg(F.max("n").alias("n")), strata, replicates, seed, packed=True)
    by = [*series, category]
    base = scores.where(F.col("score").isNotNull()).select(*by, "label", "file", F.col("score").cast("double").alias("score"))
    base = with_range(base, range_cuts(base, by, "score", RANGE_ROWS), by, "score")
    # a weight row is many times the size of the stratum row that the planner sees, so weights are never broadcast
    rows = base.join(members.select(*strata, "file", "idx"), [*strata, "file"]).join(weights.hint("merge"), [*strata, "idx"])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    rows = rows.select(*by, "_range", "_first", "label", "score", "w")
    sums = spread(rows, *by, "_range", "_first").groupBy(*by, "_range", "_first").applyInArrow(
        _range_sums(by), f"{kinds}, _range long, _first long, u array<double>, p array<double>, n array<double>")
    part = sums.select(*by, "_range", "_first", F.posexplode(F.arrays_zip("u", "p", "n")).alias("_k", "_s")).select(
        (F.col("_first") + F.col("_k")).cast("int").alias("b"), *by, "_range", "_s.u", "_s.p", "_s.n")
    ahead = Window.partitionBy("b", *by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_o", F.coalesce(F.sum("n").over(ahead), F.lit(0.0)))
    return part.groupBy("b", *by).agg(
        F.try_divide(F.sum(F.col("u") + F.col("p") * F.col("_o")), F.sum("p") * F.sum("n")).alias("auroc"))


def interval(c: str, level: float = 0.95) -> list:
    """Lower and upper percentile bounds over replicates (one value per replicate, so bounded)."""
    t = (1 - level) / 2
    return [F.percentile(c, F.lit(t)).alias("lo"), F.percentile(c, F.lit(1 - t)).alias("hi")]


def _weighted_sums(by: Sequence[str]):
    """Partial sums of a task: per group and block, value times weight and weight of every replicate."""
    def run(batches):
        kept: dict[tuple, list] = {}
        for batch in batches:
            values = batch.column("value").to_numpy()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in (*by, "_first")])):
                groups.setdefault(key, []).append(i)
            raw = batch.column("w").to_pylist()
            for key, rows in groups.items():
                w = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), -1).astype(float)
                sums = kept.setdefault(key, [np.zeros(w.shape[1]), np.zeros(w.shape[1])])
                sums[0] += values[rows] @ w
                sums[1] += w.sum(0)
        names = [*by, "_first", "s", "c"]
        if kept:
            heads = list(zip(*kept))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(h) for h in heads], *[pa.array([v[i].tolist() for v in kept.values()], pa.list_(pa.float64())) for i in (0, 1)]], names=names)
    return run


def unit_bootstrap(values: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of the mean of ``diff`` when whole units are redrawn inside every dataset.

    ``values``: option, dataset, unit, diff. The mean runs over the units of a dataset, then over datasets.
    All options share their draws. Members meet their weights once; no row is copied per replicate.
    """
    strata = ["option", "dataset"]
    members = cut_lineage(hash_index(values.select(*strata, "unit", "diff"), strata, "unit"))
    weights = weight_blocks(members.groupBy(*strata).agg(F.max("n").alias("n")), strata, replicates, seed, hashed=["dataset"])
    rows = members.select(*strata, "idx", F.col("diff").cast("double").alias("value")).join(weights.hint("merge"), [*strata, "idx"])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in strata)
    sums = rows.select(*strata, "_first", "value", "w").mapInArrow(
        _weighted_sums(strata), f"{kinds}, _first long, s array<double>, c array<double>")
    part = sums.select(*strata, "_first", F.posexplode(F.arrays_zip("s", "c")).alias("_k", "_s")).select(
        (F.col("_first") + F.col("_k")).cast("int").alias("b"), *strata, "_s.s", "_s.c")
    each = part.groupBy("b", *strata).agg((F.sum("s") / F.sum("c") * 100).alias("m"))
    return each.groupBy("b", "option").agg(F.avg("m").alias("m")).groupBy("option").agg(*interval("m"))
