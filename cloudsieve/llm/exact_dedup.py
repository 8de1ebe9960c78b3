"""Exact deduplication by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, quoted, text_of, without

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Bytes of one digest's copies that one task may sort together.
GROUP_BYTES = 1 << 20
#: Digests that may be split; with the total size this bounds the broadcast list.
MOST_SPLIT = 65_536


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after each run of white space became one space. Rows are range-partitioned
    by sampled splitters over (first 32 characters, SHA-256) of the normalised text and sorted there; a row whose
    full text equals its neighbour's joins the neighbour's group. A digest whose copies weigh more than
    ``group_bytes`` (or a 65,536th of the corpus, if that is more) is dealt over several ranges by a hash of the
    id, compared within each, and its size and smallest id come from a map-side combined count: at most 65,536
    short rows, which are broadcast. Text crosses the network once.

    Null text counts as empty. Null ids sort after all others: ``keep_id`` is null only if every id of the group
    is. Of repeated rows with the smallest id exactly one has ``kept``. An empty table gives no rows. Input columns
    named like an output are replaced; all others pass through.
    """
    docs = without(docs, OUTPUTS)
    head, parts, part, least, many, norm, run, new = fresh(
        docs, "_head", "_parts", "_part", "_least", "_many", "_norm", "_run", "_new")
    text, doc_id, digest = text_of(text_col), F.col(quoted(id_col)), "text_sha256"
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    limit = max(group_bytes, total // MOST_SPLIT)
    keyed = docs.withColumn(norm, normalised(text)).withColumn(digest, F.sha2(F.col(norm).cast("binary"), 256))
    heavy = (
        keyed.groupBy(digest)
        .agg(F.sum(F.octet_length(norm)).alias(parts), F.min(doc_id).alias(least), F.count(F.lit(1)).alias(many))
        .where(F.col(parts) > limit)
        .withColumn(parts, F.ceil(F.col(parts) / F.lit(limit)).cast("int"))
    )
    rows = (
        keyed.withColumn(head, F.substring(norm, 1, 32)).drop(norm)
        .join(F.broadcast(heavy), digest, "left")
        .withColumn(part, F.coalesce(F.pmod(F.xxhash64(doc_id), F.col(parts)), F.lit(0)))
        .repartitionByRange(head, digest, part)
        .withColumn(norm, normalised(text))
    )
    group = [head, digest, part]
    order = Window.partitionBy(*group).orderBy(F.col(norm), doc_id.asc_nulls_last())
    before = F.lag(norm).over(order)
    rows = rows.withColumn(new, before.isNull() | (before != F.col(norm)))
    number = F.sum(F.col(new).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alike = Window.partitionBy(*group, run)
    rows = rows.withColumn(run, number).drop(norm)
    return rows.select(
        *[F.col(quoted(c)) for c in docs.columns],
        F.coalesce(F.col(least), F.min(doc_id).over(alike)).alias("keep_id"),
        F.coalesce(F.col(many), F.count(F.lit(1)).over(alike)).alias("group_size"),
        (F.col(new) & (F.col(least).isNull() | doc_id.eqNullSafe(F.col(least)))).alias("kept"),
        F.col(digest),
    )
