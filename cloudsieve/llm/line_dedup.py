"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of lower-cased words. Equal lines are one line at its earliest place. Two different lines are near
if one word substituted, inserted or deleted turns one into the other and the longer has at least five words (so at
least 0.8 of it agrees). Every line gives hashes of itself and of itself without each word. Lines of equal length that
agree without the word at one place, or a line that equals another without one word, meet under one hash; texts are then
compared word by word. A line goes if an earlier line is equal or near; links are not followed further.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, text_of, written

#: The edit bound holds from this length of the longer line on.
LEAST_WORDS = 5
ROWS = 1 << 16
#: Size of the sieve that spares lines without any partner the way to the join.
SIEVE_BITS = 1 << 25

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


#: Lengths at which the size of the compared ends grows: each at least half as long again as the one before.
ENDS = [4]
while ENDS[-1] < 1 << 40:
    ENDS.append(ENDS[-1] * 3 // 2)


def _ends(words: list[bytes]) -> list[int | None]:
    """Hashes of the first and of the last words of a line, as many as half of the class of its length.

    Near lines of one class agree in the first or in the last; a line at the lower end of its class also has the
    hashes of the class below, for partners that are one word shorter.
    """
    import xxhash
    n, out, done = len(words), [], 0
    for m in (n, n - 1):
        size = ENDS[bisect.bisect_right(ENDS, m) - 1] // 2 if m >= ENDS[0] else 0
        if not size or size == done:
            out += [None, None]
            continue
        done = size
        for side, part in enumerate((words[:size], words[n - size:])):
            out.append(xxhash.xxh3_64_intdigest(b" ".join(part), 2 * size + side) - (1 << 63))
    return out


_LINE = "id {kind}, text_hash long, line_no int, n int, blank int, digest binary, h0 long, h1 long, h2 long, h3 long"


def _line_batches(batches):
    import xxhash
    for batch in batches:
        kind, ids, hashes = batch.column(0).type, batch.column(0), batch.column(1)
        doc, number, n, blank, digest, halves = [], [], [], [], [], []

        def flush():
            at = pa.array(doc, pa.int32())
            columns = [ids.take(at), hashes.take(at), pa.array(number, pa.int32()), pa.array(n, pa.int32()),
                       pa.array(blank, pa.int32()), pa.array(digest, pa.binary()),
                       *[pa.array([h[k] for h in halves], pa.int64()) for k in range(4)]]
            for x in (doc, number, n, blank, digest, halves):
                x.clear()
            return pa.RecordBatch.from_arrays(
                columns, names=["id", "text_hash", "line_no", "n", "blank", "digest", "h0", "h1", "h2", "h3"])
        for i, text in enumerate(batch.column(2)):
            empty, count = 0, 0
            for count, line in enumerate(text.as_py().split("\n"), 1):
                words = words_of(line)
                empty += not words
                if words:
                    doc.append(i)
                    number.append(count - 1)
                    n.append(len(words))
                    blank.append(0)
                    digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    halves.append(_ends(words))
            # one more row tells the number of lines
            doc.append(i)
            number.append(None)
            n.append(count)
            blank.append(empty)
            digest.append(None)
            halves.append([None] * 4)
            if len(doc) >= ROWS:
                yield flush()
        if doc:
            yield flush()


def _text_batches(shared):
    def run(batches):
        import xxhash
        sieve = shared.value
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    words = words_of(line)
                    if len(words) >= LEAST_WORDS - 1:
                        joined = b" ".join(words)
                        digest = xxhash.xxh3_128_digest(joined)
                        bit = int.from_bytes(digest[:8], "big") % SIEVE_BITS
                        if sieve[bit >> 3] >> (bit & 7) & 1:
                            seen[digest] = joined
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "line"])
    return run


def _sieve(digests: DataFrame) -> np.ndarray:
    """Bits of the given digests, by byte: a sieve that lets all of them pass and, of few, little else.

    It has a fixed size; the driver gets at most one row for each of its 64-bit words.
    """
    number = F.conv(F.substring(F.hex("digest"), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(SIEVE_BITS)
    bit = number.cast("long")
    words = digests.withColumn("b", bit).groupBy(F.shiftright("b", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def neighbourhood(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Hashes of the line without each of its words, and of the line itself; all in one pass over word hashes."""
    import xxhash
    with np.errstate(over="ignore"):
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        powers = np.cumprod(np.full(len(words), _BASE, np.uint64))
        upto = np.append(np.uint64(0), np.cumsum(w * powers))
        return upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(_INVERSE), int(upto[-1])


def _mixed(h: np.ndarray, a: int, b: np.ndarray | int) -> np.ndarray:
    """Hashes told apart by two small numbers, as signed 64-bit keys."""
    with np.errstate(over="ignore"):
        x = h ^ (np.uint64(a) * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(b, np.uint64) * np.uint64(0x165667B19E3779F9))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


#: Roles of a row under its key: agrees without the word at one place; is the shorter line; is the longer one.
SUBSTITUTED, WHOLE, DELETED = 0, 1, 2


def _variant_batches(batches):
    for batch in batches:
        places, keys, roles = [], [], []

        def flush():
            at = np.repeat([p for p, _ in places], [c for _, c in places])
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), batch.column(0).take(pa.array(at))],
                names=["key", "role", "number"])
            for x in (places, keys, roles):
                x.clear()
            return out
        size = 0
        for i, line in enumerate(batch.column(1)):
            words = line.as_py().split(b" ")
            n = len(words)
            without, whole = neighbourhood(words)
            keys.append(_mixed(np.array([whole], np.uint64), n, 0))
            roles.append(np.array([WHOLE], np.int8))
            count = 1
            if n >= LEAST_WORDS:
                keys += [_mixed(without, n - 1, 0), _mixed(without, n, np.arange(1, n + 1))]
                roles += [np.full(n, DELETED, np.int8), np.full(n, SUBSTITUTED, np.int8)]
                count += 2 * n
            places.append((i, count))
            size += count
            if size >= ROWS:
                yield flush()
                size = 0
        if places:
            yield flush()


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one substitution, insertion or deletion of a word at most lies between the lines."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    return a[head + (len(a) == len(b)):] == b[head + 1:]


def _near_batches(batches):
    for batch in batches:
        good = [near(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["place"]).filter(pa.array(good, pa.bool_()))


def _neighbours(first: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Places of lines that have a near line before them, from the first places of all distinct lines."""
    wide = first.where(F.col("n") >= LEAST_WORDS - 1)
    ends = wide.select(F.explode(F.array("h0", "h1", "h2", "h3")).alias("end"), "digest").where("end IS NOT NULL")
    met = ends.groupBy("end").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("end")
    # exact: near lines share an end, so lines that share none have no neighbour
    some = written(ends.join(met, "end", "left_semi").select("digest").distinct())
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(some))
    texts = docs.select(text_of(text_col).alias("text")).mapInArrow(_text_batches(sieve), "digest binary, line binary")
    texts = texts.join(some, "digest", "left_semi").groupBy("digest").agg(F.min("line").alias("line"))
    placed = texts.join(first.select("digest", "place"), "digest").select("place", "line")
    # numbers in the order of places: a comparison of numbers is one of places
    lines = written(placed.orderBy("place").withColumn("number", F.monotonically_increasing_id()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("number", "line").repartition(n, "number").mapInArrow(_variant_batches, "key long, role byte, number long")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("number")))
    groups = written(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), of(SUBSTITUTED).alias("s"), of(WHOLE).alias("w"), of(DELETED).alias("d")).where("c > 1").drop("c"))
    before = F.when(F.col("role") == SUBSTITUTED, F.col("s")).when(F.col("role") == WHOLE, F.col("d")).otherwise(F.col("w"))
    pairs = rows.join(groups, "key").select("number", before.alias("other")).where("other < number").distinct()
    both = pairs.join(lines.select("number", "place", "line"), "number").join(
        lines.select(F.col("number").alias("other"), F.col("line").alias("before")), "other")
    kind = lines.schema["place"].dataType.simpleString()
    return both.select("place", "line", "before").mapInArrow(_near_batches, f"place {kind}").distinct()


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, lines): line counts per document, and the first place of every distinct line with ``near``.

    ``place`` orders lines by (id, null last; hash of the text; number of the line). ``near``: a near line lies before.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    rows = src.mapInArrow(_line_batches, _LINE.format(kind=kind))
    place = F.struct(F.col("id").isNull().alias("loose"), "id", "text_hash", "line_no")
    # all rows of a line agree in everything but their place; documents' own rows are kept apart by their hash
    grouped = rows.withColumn("doc", F.when(F.col("digest").isNull(), F.struct("id", "text_hash"))).groupBy("digest", "doc").agg(
        F.min(place).alias("place"), F.min("n").alias("n"), F.min("blank").alias("blank"),
        *[F.min(h).alias(h) for h in ("h0", "h1", "h2", "h3")])
    table = written(grouped)
    first = table.where("digest IS NOT NULL").drop("doc", "blank")
    gone = _neighbours(first, docs, text_col).withColumn("near", F.lit(True))
    lines = first.select("place", "n").join(gone, "place", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    return table.where("digest IS NULL").select("doc", "n", "blank"), lines


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``text_hash``, ``n_lines``, ``n_kept``, ``n_near`` and ``kept_lines``.

    Lines end at line feeds. ``kept_lines`` (array, from 0) are the lines with words that stay: at their earliest place and
    with no near line before them; ``n_near`` counts those that only a near line drops. Lines without words always stay and
    count in ``n_kept`` only. Null text is one empty line. Null ids come last; rows that repeat both id and text are one
    document. An empty table gives no rows. Extra columns are not read.
    """
    counts, lines = line_places(docs, id_col, text_col)
    kept = lines.groupBy(F.struct("place.id", "place.text_hash").alias("doc")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("place.line_no")))).alias("kept_lines"),
        F.count_if("near").alias("n_near"))
    met = counts.alias("c").join(kept.alias("k"), F.expr("c.doc.text_hash = k.doc.text_hash AND c.doc.id <=> k.doc.id"), "left")
    found = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return met.select(
        F.col("c.doc.id").alias(id_col), F.col("c.doc.text_hash").alias("text_hash"), F.col("n").cast("long").alias("n_lines"),
        (F.col("blank") + F.size(found)).cast("long").alias("n_kept"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        found.alias("kept_lines"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the lines that stay, in order; all other columns as they are."""
    a, b, kept = fresh(docs, "_text_hash", "_id_hash", "_kept")
    found = line_dedup(docs, id_col, text_col).select(
        F.col("text_hash").alias(a), F.xxhash64(F.col(quoted(id_col))).alias(b), F.col("kept_lines").alias(kept))
    keyed = docs.withColumn(a, F.xxhash64(text_of(text_col))).withColumn(b, F.xxhash64(F.col(quoted(id_col))))
    stays = lambda line, i: ~line.rlike("[^\\x20\\x09-\\x0D]") | F.array_contains(F.col(kept), i)
    text = F.array_join(F.filter(F.split(text_of(text_col), "\n"), stays), "\n")
    return keyed.join(found, [a, b]).withColumn(text_col, text).select(*[F.col(quoted(c)) for c in docs.columns])
