"""Token ids as Parquet list columns that can be read by document, by place in the stream, or without their ids."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fleeting, quoted, shared_folder, text_of

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Bytes of text that become one shard, about; a document is not cut.
SHARD_BYTES = 32 << 20
#: Bytes of a row group and of a page before encoding.
GROUP_BYTES = 8 << 20
PAGE_BYTES = 128 << 10
#: Distinct pieces of text whose ids a Python worker keeps, across its tasks.
PIECES = 1 << 19
# Characters whose normal form, lower case and class are beyond doubt: white space, printable ASCII and Latin-1 letters.
_OTHER = re.compile("[^\x09-\x0d\x20-\x7eÀ-ÿ]")
# The pieces that this vocabulary encodes one by one, after lower-casing, for those characters.
_PIECE = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+")
#: Column encodings: each column by dictionary, or delta encoded without one.
ENCODINGS = ("dictionary", "delta")


class _Known(dict):
    """piece -> its ids as bytes, encoded at first sight; forgets all when ``PIECES`` are reached."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel
        self.merge = tokenizer.model.tokenize
        self.spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        # the vocabulary spells bytes of ASCII as they are
        tokens = self.merge(piece if piece.isascii() else self.spelled(piece)[0][0])
        if len(self) >= PIECES:
            self.clear()
        self[piece] = raw = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return raw


@lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER):
    """text -> ids of the named public tokenizer as little-endian unsigned 32-bit integers, without added special tokens.

    The default vocabulary is lower-case with word ends. It encodes runs of letters, digits, contractions and runs of signs one by
    one, so each distinct piece is encoded once and its ids are kept, ``PIECES`` of them at most. Texts with characters beyond
    printable ASCII and Latin-1 letters, or with what may be a special token, go to the library as a whole, as do all texts
    under another vocabulary.
    """
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    ids_of = _Known(tokenizer).__getitem__

    def encode(text: str) -> bytes:
        if name != TOKENIZER or "<|" in text or _OTHER.search(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(ids_of, _PIECE.findall(text.lower())))
    return encode


def _shard_batches(name: str, end: int):
    """Encodes the ordered documents of one shard and numbers its tokens."""
    def run(batches):
        encode, last = encoder(name), np.array([end], "<u4").tobytes()
        place = 0
        for batch in batches:
            ids, sums = [], []
            for text in batch.column("text"):
                ids.append(encode(text.as_py()) + last)
                sums.append(zlib.crc32(ids[-1]))
            lengths = np.array([len(raw) // 4 for raw in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            while at < len(lengths):  # list offsets are 32-bit
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 28), "right")) - 1)
                flat = pa.array(np.frombuffer(b"".join(ids[at:to]), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array((ends[at:to + 1] - ends[at]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), batch.column("shard").slice(at, to - at), pa.array(place + ends[at:to]),
                     pa.array(lengths[at:to]), pa.array(sums[at:to], pa.int64()), lists],
                    names=["doc_id", "shard", "start_in_shard", "n_tokens", "crc", "ids"])
                at = to
            place += int(ends[-1])
    return run


@dataclass(frozen=True)
class TokenFiles:
    """A written token table: ``tokens`` (one row per document, one file per shard) and ``shards`` (first token of each shard)."""

    spark: SparkSession
    path: str

    def table(self) -> DataFrame:
        """(doc_id, start, n_tokens, crc, ids): only the columns a query uses are read from the files."""
        shards = self.spark.read.parquet(f"{self.path}/shards")
        rows = self.spark.read.parquet(f"{self.path}/tokens")
        return rows.join(shards.select("shard", "first_token"), "shard").select(
            "doc_id", (F.col("first_token") + F.col("start_in_shard")).alias("start"), "n_tokens", "crc", "ids")

    def documents(self, first=None, last=None) -> DataFrame:
        """The rows of documents with first <= doc_id <= last; row groups and pages outside are not read."""
        rows = self.table()
        if first is not None:
            rows = rows.where(F.col("doc_id") >= first)
        return rows if last is None else rows.where(F.col("doc_id") <= last)

    def span(self, start: int, stop: int) -> DataFrame:
        """(doc_id, start, ids): the tokens at places start to stop (end exclusive) of the whole stream, in parts of documents.

        Shards that do not reach into the span are left out by their table, pages by the places stored with the rows.
        """
        shards = self.spark.read.parquet(f"{self.path}/shards").where(
            (F.col("first_token") < stop) & (F.col("first_token") + F.col("tokens") > start))
        hit = [(r["shard"], r["first_token"]) for r in shards.orderBy("shard").collect()]
        rows = self.spark.read.parquet(f"{self.path}/tokens").where(F.col("shard").isin([s for s, _ in hit]))
        if hit:  # within the first shard nothing before the span, within the last nothing after it
            rows = rows.where((F.col("shard") > hit[0][0]) | (F.col("start_in_shard") + F.col("n_tokens") > start - hit[0][1]))
            rows = rows.where((F.col("shard") < hit[-1][0]) | (F.col("start_in_shard") < stop - hit[-1][1]))
        rows = rows.join(shards.select("shard", "first_token"), "shard")
        at = F.col("first_token") + F.col("start_in_shard")
        skip = F.greatest(F.lit(start) - at, F.lit(0))
        take = F.least(F.lit(stop) - at, F.col("n_tokens")) - skip
        return rows.select("doc_id", (at + skip).alias("start"),
                           F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def _options(encoding: str) -> dict[str, str]:
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is none of {', '.join(ENCODINGS)}")
    ids = "ids.list.element"
    return {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false",
            f"parquet.enable.dictionary#{ids}": str(encoding == "dictionary").lower(),
            "parquet.enable.dictionary#shard": "true", "parquet.block.size": str(GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
            "parquet.dictionary.page.size": str(1 << 20), "parquet.page.row.count.limit": "1000"}


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
          end: int = END, encoding: str = "dictionary", shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Write the ids of every whole text, in ascending id order, as token files below ``path`` (default: a place in the shared
    folder that goes with the application).

    Null texts are empty and hold the end id only. Null document ids come first; equal ids keep the order in which their rows are
    read, so repeated rows have places of their own. An empty table gives an empty file. Columns other than id and text are not
    read, whatever their names.

    Texts cross the network once, compressed, to ranges of (id, row): neither one id nor repeated rows gather in a task. A range is
    sorted, encoded, numbered from zero and written by one task. The shards' sizes are then read from the small columns and
    only one row per shard is summed up. Ids take dictionary or delta encoding, the other columns delta; row groups are
    ``GROUP_BYTES`` and pages ``PAGE_BYTES`` of data or 1,000 rows, and the writer adds page indexes, so readers skip by document
    and by place.
    """
    spark = docs.sparkSession
    options = _options(encoding)
    if path is None:
        path = fleeting(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(-(-total // shard_bytes) or 1, *order)
    kind = rows.schema["id"].dataType.simpleString()
    sorted_ = ranged.sortWithinPartitions(*order).select("id", F.spark_partition_id().alias("shard"), "text")
    placed = sorted_.mapInArrow(_shard_batches(tokenizer, end),
                                f"doc_id {kind}, shard int, start_in_shard long, n_tokens long, crc long, ids array<int>")
    placed.write.options(**options).parquet(f"{path}/tokens")
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    known = sorted((r["shard"], r["tokens"], r["documents"]) for r in sizes.collect())
    first = np.concatenate([[0], np.cumsum([t for _, t, _ in known], dtype=np.int64)])
    spark.createDataFrame([(s, int(f), t, d) for (s, t, d), f in zip(known, first)],
                          "shard int, first_token long, tokens long, documents long").coalesce(1).write.parquet(f"{path}/shards")
    return TokenFiles(spark, path)


def _digest_batches(batches):
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): places, counted ids and checksum of the ids as they are read from the files."""
    rows = files.table().select("doc_id", "start", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digest_batches, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
