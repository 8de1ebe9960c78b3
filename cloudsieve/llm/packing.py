"""Packing documents into fixed-length sequences by a configuration linear program."""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import quoted, text_of

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Pricing rounds of the multiplicative-weights solver; each costs one knapsack table, whatever the corpus size.
ROUNDS = 1200
STEP = 1.0
BONUS = 0.05
#: Shares of the fractional solution that rounding tries.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Pieces that are ranked together, about.
STRATUM = 20_000
#: Texts above this many characters go to the tokenizer whose cost is linear in the length of a single word.
LONG = 1_000_000


def encoder(name: str = TOKENIZER):
    """text -> ids of the named public tokenizer, without added special tokens.

    The same vocabulary as ranks is about five times faster in the other public library; both give equal ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(public_tokenizers.path(name))
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        if len(text) > LONG:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special=allowed)
    return encode


def _piece_batches(capacity: int, name: str):
    def run(batches):
        encode = encoder(name)
        for batch in batches:
            out = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), END], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                ends = [*starts[1:], len(ids)]
                out[0] += [i] * len(starts)
                out[1] += range(len(starts))
                out[2] += starts
                out[3] += [e - s for s, e in zip(starts, ends)]
                out[4] += [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
            arrays = [batch.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()),
                      *[pa.array(x, pa.int64()) for x in out[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut only above ``capacity``.

    All pieces but the first are ``capacity`` long. Texts are encoded where they are read; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(quoted(id_col)).alias("id"), text_of(text_col).alias("text"))
    return src.mapInArrow(_piece_batches(capacity, tokenizer),
                          f"id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Plan:
    """Slots by length: from rank ``first`` on, ``many`` pieces per sequence starting at sequence ``base``."""

    length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def _best_configuration(worth: np.ndarray, limit: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per length of a most valuable content of one sequence (knapsack over lengths, repeats allowed)."""
    gains = np.where(worth > 0, worth, -np.inf)
    back = np.zeros(capacity + 1)  # value of c tokens at place capacity - c
    taken = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        trial = back[capacity - c + 1:] + gains[1:c + 1]
        length = int(trial.argmax())
        if trial[length] > back[capacity - c + 1]:
            back[capacity - c], taken[c] = trial[length], length + 1
        else:
            back[capacity - c] = back[capacity - c + 1]
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        counts[taken[c]] += taken[c] > 0
        c -= max(int(taken[c]), 1)
    return np.minimum(counts, limit)


def _fill_best_fit(counts: np.ndarray, left: np.ndarray, room: int) -> int:
    """Add the longest remaining piece that fits, again and again; the room left over."""
    while room > 0:
        fits = np.flatnonzero(left[:room + 1] > counts[:room + 1])
        if not len(fits):
            break
        length = int(fits[-1])
        n = min(room // length, int(left[length] - counts[length]))
        counts[length] += n
        room -= n * length
    return room


def covering_program(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations (counts per length) with fractional use, from multiplicative weights.

    The covering program minimises the number of sequences subject to every length being covered as often as it
    occurs. The weights are its dual prices, size times a factor that falls exponentially with the share of the
    length that is covered; longer pieces win ties by a small bonus. The next configuration is the most valuable one
    at these prices, found by a knapsack table, and is used until it covers one of its lengths.
    """
    need = np.maximum(histogram, 1).astype(float)
    left = histogram.astype(float)
    tokens = np.arange(capacity + 1)
    size, price = tokens / capacity, np.ones(capacity + 1)
    found: dict[bytes, float] = {}
    for _ in range(rounds):
        open_ = left > 1e-9
        if not open_.any():
            break
        limit = np.where(open_, np.ceil(left), 0).astype(np.int64)
        counts = _best_configuration(np.where(open_, size * price * (1 + BONUS * size), 0.0), limit, capacity)
        _fill_best_fit(counts, limit, capacity - int(counts @ tokens))
        used = counts > 0
        times = float((left[used] / counts[used]).min())
        found[counts.tobytes()] = found.get(counts.tobytes(), 0.0) + times
        left -= counts * times
        price[used] *= np.exp(-STEP * counts[used] * times / need[used])
    return [(np.frombuffer(k, np.int64), t) for k, t in found.items()]


def best_fit(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Best-fit configurations, longest piece first, each used until one of its lengths runs out."""
    left, out = histogram.copy(), []
    while left.any():
        counts, top = np.zeros(capacity + 1, np.int64), int(np.flatnonzero(left)[-1])
        counts[top] = 1
        _fill_best_fit(counts, left, capacity - top)
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        out.append((counts, times))
        left -= counts * times
    return out


def solve(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, covering ``histogram`` (counts by length, 0 to capacity) exactly.

    Full pieces need no program. The fractional uses of the others, times each of ``SHARES``, are rounded down; what is
    left goes to best fit; the rounding with the fewest sequences wins. The number of configurations is at most
    ``rounds`` plus the number of lengths, however large the corpus.
    """
    left = histogram.astype(np.int64).copy()
    full = np.zeros(capacity + 1, np.int64)
    full[capacity] = 1
    out = [(full, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    program = covering_program(left, capacity, rounds)
    best = None
    for share in SHARES:
        whole = [(c, int(t * share + 1e-9)) for c, t in program]
        whole = [(c, t) for c, t in whole if t]
        rest = left - sum((c * t for c, t in whole), np.zeros_like(left))
        trial = whole + best_fit(rest, capacity)
        if best is None or sum(t for _, t in trial) < sum(t for _, t in best):
            best = trial
    return out + best


def plan(configurations: list[tuple[np.ndarray, int]]) -> Plan:
    rows, base, seen = [], 0, {}
    for counts, times in configurations:
        offset = 0
        for length in np.flatnonzero(counts)[::-1].tolist():
            many = int(counts[length])
            rows.append((length, seen.get(length, 0), many, base, offset))
            seen[length] = seen.get(length, 0) + many * times
            offset += many * length
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, base)


def _place_batches(shared):
    def run(batches):
        slots = shared.value
        begins = np.searchsorted(slots.length, np.arange(slots.length.max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                lo, hi = begins[length[rows[0]]], begins[length[rows[0]] + 1]
                at[rows] = lo + np.searchsorted(slots.first[lo:hi], rank[rows], "right") - 1
            k = rank - slots.first[at]
            keep = [n for n in batch.schema.names if n != "rank"]
            arrays = [*[batch.column(batch.schema.names.index(n)) for n in keep],
                      pa.array(slots.base[at] + k // slots.many[at]), pa.array(slots.offset[at] + k % slots.many[at] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and its ``offset`` there, gapless from 0.

    The configuration program runs on the length histogram (at most ``capacity`` numbers) on the driver; its plan
    has a bounded number of slots whatever the corpus size and is broadcast. A piece finds its place from its rank
    among pieces of its length; ranks are counted in strata of the id's hash, so that no length meets in one task.

    Null and empty texts are the end id alone. Null ids are one more id; repeated rows are packed as often as they
    occur; equal rows share their places in any order. An empty table gives no rows. Extra columns are not read.
    """
    cut = cut_lineage(pieces(docs, id_col, text_col, capacity, tokenizer))
    strata = 1 + cut.count() // STRATUM
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(strata)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).toPandas().itertuples(index=False):
        histogram[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(plan(solve(histogram, capacity)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("k", F.row_number().over(within) - 1).join(before, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).cast("long").alias("rank"))
    kind = cut.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(_place_batches(shared), f"id {kind}, piece int, start long, length long, "
                               "ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
