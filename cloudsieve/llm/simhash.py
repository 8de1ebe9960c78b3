"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code. A fingerprint is two halves of 32 bits; the code of a half is the
perfect [31, 26] Hamming code on its low 31 bits with the last bit free, so every half has a codeword within one
bit (its home). Fingerprints within three bits agree in one half up to one bit; in that half the other fingerprint
lies within radius 1 + threshold 1 of the home anchor. Every fingerprint is therefore copied to all anchors within
two bits of either half (34 at most), and homes are compared with copies anchor by anchor, on all 64 bits.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, quoted, text_of
from .components import components

MAX_BITS = 3
SEED = 42
#: Homes of one anchor that one task holds; an anchor with more is cut into slices.
SLICE = 4096
#: Bytes of text that are split into words at once.
CHUNK = 1 << 20
PAIRS = 1 << 21

#: Masks of the positions 1 to 31 whose number has bit k set: the parity checks of the Hamming code.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def _word_blocks(text: bytes):
    """Lists of words of about a chunk each; a block starts with the last two words of the one before."""
    at, tail = 0, []
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
            end = gap.start() if gap else len(text)
        words = text[at:end].split()
        at = end
        if words:
            yield tail + words
            tail = (tail + words)[-2:]


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included; 0 for a text without words."""
    import xxhash
    h = xxhash.xxh64_intdigest
    ones, n, words = np.zeros(64, np.int64), 0, []
    for words in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        if len(words) < 3:
            continue
        hashes = np.fromiter(map(h, map(b" ".join, zip(words, words[1:], words[2:])), repeat(SEED)), np.uint64)
        for at in range(0, len(hashes), 32768):
            part = hashes[at:at + 32768]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    if not n:  # under three words, so the last block has them all
        return h(b" ".join(words), SEED) if words else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "_print"])


def fingerprints(docs: DataFrame, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the signed 64-bit fingerprint as ``name``; one pass, no shuffle."""
    src = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], text_of(text_col).alias("_text"))
    kinds = [(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = ", ".join([*(f"{c} {k.simpleString()}" for c, k in kinds), "_print long"])
    out = src.mapInArrow(_fingerprint_batches, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("_print").alias(name))


def _half(half: int) -> list[tuple[str, str]]:
    """Columns of one half of ``fp`` in SQL; the last is its array of (anchor, is home)."""
    syndrome = " + ".join(f"(bit_count(y & {m}L) % 2) * {1 << k}" for k, m in enumerate(CHECKS))
    key = lambda c, top: f"shiftleft({half}L, 32) | shiftleft({top}, 31) | ({c})"
    at = lambda i: f"shiftleft(1L, {i} - 1)"
    return [
        (f"_y{half}", f"shiftrightunsigned(fp, {32 * half}) & 2147483647L"),
        (f"_t{half}", f"shiftrightunsigned(fp, {32 * half + 31}) & 1L"),
        (f"_s{half}", "cast(" + syndrome.replace("(y &", f"(_y{half} &") + " as int)"),
        (f"_c{half}", f"if(_s{half} = 0, _y{half}, _y{half} ^ {at(f'greatest(_s{half}, 1)')})"),
        (f"_a{half}", f"""concat(
            array(struct({key(f'_c{half}', f'_t{half}')} as anchor, true as home),
                  struct({key(f'_c{half}', f'_t{half} ^ 1L')} as anchor, false as home)),
            transform(filter(sequence(1, 31), i -> i < (i ^ _s{half})),
                      i -> struct({key(f"_y{half} ^ {at('i')} ^ {at(f'(i ^ _s{half})')}", f'_t{half}')} as anchor, false as home)))"""),
    ]


def covered(prints: DataFrame) -> DataFrame:
    """``prints`` (fp) copied to its anchors: (anchor, home, fp)."""
    for half in (0, 1):
        for name, sql in _half(half):
            prints = prints.withColumn(name, F.expr(sql))
    return prints.select("fp", F.explode(F.concat("_a0", "_a1")).alias("at")).select("at.anchor", "at.home", "fp")


class _Forest:
    """Union-find over the linked fingerprints of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _compare_batches(batches):
    """Rows sorted by (slice key, homes first): compare each row with the homes of its key; emit a forest of links."""
    forest, held_key, held = _Forest(), None, np.empty(0, np.uint64)
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        home = batch.column(2).to_numpy(zero_copy_only=False)
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fp):
            continue
        same = held_key is not None and (key[:, 0] == held_key).all()
        carry = len(held) if same else 0
        if carry:  # the homes of a key that began in an earlier batch
            key = np.concatenate([np.repeat(key[:, :1], carry, 1), key], 1)
            home, fp = np.concatenate([np.ones(carry, bool), home]), np.concatenate([held, fp])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        sizes = np.diff(np.append(starts, len(fp)))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        row_start, row_homes = np.repeat(starts, sizes), np.repeat(homes, sizes)
        row_homes[:carry] = 0  # compared before
        upto = np.cumsum(row_homes)
        at = 0
        while at < len(fp):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = row_homes[at:stop]
            rows = np.repeat(np.arange(at, stop), n)
            other = row_start[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            x, y = fp[other], fp[rows]
            # homes of one batch meet both ways, a held home meets a later one only here
            near = ((x < y) | (other < carry)) & (x != y) & (np.bitwise_count(x ^ y) <= MAX_BITS)
            for a, b in zip(x[near].view(np.int64).tolist(), y[near].view(np.int64).tolist()):
                forest.link(a, b)
            at = stop
        last = starts[-1]
        held_key, held = key[:, -1].copy(), fp[last:last + homes[-1]].copy()
    links = [(x, forest.root(x)) for x in list(forest.up)]
    links = [p for p in links if p[0] != p[1]]
    for at in range(0, len(links), 65536):
        part = links[at:at + 65536]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (``fp``, distinct) within three bits of each other.

    A task returns a spanning forest of the links it finds, so a dense group gives no more rows than it has
    members in that task. An anchor with over ``SLICE`` homes is cut into slices of homes by a hash; copies go to each.
    """
    rows = covered(prints)
    hot = rows.where("home").groupBy("anchor").count().where(F.col("count") > SLICE).select(
        "anchor", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    if hot.isEmpty():
        rows = rows.withColumn("slice", F.lit(0))
    else:
        rows = rows.join(hot, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        every = F.sequence(F.lit(0), F.col("slices") - 1)
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
        # a home meets the homes of the other slices too, so it is also copied like any other fingerprint
        copies = rows.where(~F.col("home") | (F.col("slices") > 1)).withColumn("slice", F.explode(every)).withColumn(
            "home", F.lit(False))
        rows = rows.where("home").withColumn("slice", F.explode(own)).unionByName(copies)
    rows = rows.select("anchor", "slice", "home", "fp").repartition("anchor", "slice")
    return rows.sortWithinPartitions("anchor", "slice", F.desc("home")).mapInArrow(_compare_batches, "a long, b long")


def _found(docs: DataFrame, id_col: str, text_col: str, tags: list[str]) -> DataFrame:
    """Rows (id, tags, fp, component_id, root); the fingerprints and the table of distinct ones are written once."""
    rows = cut_lineage(fingerprints(docs, text_col, "fp", [id_col, *tags]).withColumnRenamed(id_col, "id"))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(prints.select("fp")), "a", "b")
    named = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits), ``component_id`` and ``root``.

    ``component_id`` is the smallest id reachable over links of at most three differing bits, itself included;
    ``root`` (the least signed fingerprint) names the component even where ids are null. Null or wordless texts have
    fingerprint zero and are linked like others. A null id is larger than any other. Equal fingerprints are collapsed
    before the search. Repeated rows stay rows; an empty table gives none. Extra columns are not read.
    """
    return _found(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))), id_col, text_col, []).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of every component one row with the smallest id stays, with all its columns.

    Of several rows with that id (or of rows without id, where no row has one) the least hash of the text decides;
    of rows repeated in id and text any one stays. Texts are shuffled once, by (hash of text, hash of id).
    """
    a, b = fresh(docs, "_text_hash", "_id_hash")
    keyed = docs.withColumn(a, F.xxhash64(text_of(text_col))).withColumn(b, F.xxhash64(F.col(quoted(id_col))))
    found = _found(keyed.select(F.col(quoted(id_col)), F.col(quoted(text_col)), a, b), id_col, text_col, [a, b])
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct(a, b)).alias("at")).select(F.col(f"at.{a}").alias(a), F.col(f"at.{b}").alias(b))
    place, = fresh(keyed, "_place")
    first = F.row_number().over(Window.partitionBy(a, b).orderBy(a))
    return keyed.join(stay, [a, b]).withColumn(place, first).where(F.col(place) == 1).select(
        *[F.col(quoted(c)) for c in docs.columns])
