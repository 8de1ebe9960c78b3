"""Ordered running totals that never bring a hot group into one task.

AUROC, average precision, operating points, exact percentiles, medians, top-k means and average
ranks all need "how much lies before this value in my group". Equal values are first collapsed by a
partial aggregate. Groups up to ``GROUP_LIMIT`` rows or distinct values then need one window. The values of larger groups
are cut into ranges, and ranges into ranges again until none is too large. The window runs inside one
range, and the ranges' totals (one short row each) give the offset.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, dbl
from ..session import cut_lineage

GROUP_LIMIT = 1_000_000
#: Parts of a cell a level of cuts makes.
FANOUT = 128
#: Of the cuts of a cell, every so many-th is looked at first.
STRIDE = 12
#: Shares of a table above which a single value's rows are spread; so many values at most are joined by broadcast.
HEAVY_SHARES = 4096


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group: one number, from a map-side combined count."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def range_cuts(df: DataFrame, keys: Sequence[str], value: str, limit: int = GROUP_LIMIT,
               fanout: int = FANOUT) -> list[DataFrame] | None:
    """Cut points of the groups above ``limit`` rows, level by level, or None when there are none.

    A level cuts every cell that is still too large at ``fanout`` - 1 quantiles (keys, ranges so far, ``_cuts``). A quantile is
    a cell of its own, so a frequent value ends alone and all other cells shrink by about ``fanout`` a level.
    """
    keys = list(keys)
    largest = largest_group(df, keys)
    probs = F.array(*[F.lit(i / fanout) for i in range(1, fanout)])
    levels, ranged = [], df.select(*keys, value)
    while largest > limit:
        by = [*keys, *[f"_r{i}" for i in range(len(levels))]]
        sizes = ranged.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        hot = sizes.where((F.col("_c") > limit) & (F.col("_low") < F.col("_high"))).select(*by)
        cuts = ranged.join(hot, by, "left_semi").groupBy(*by).agg(
            F.array_sort(F.array_distinct(F.percentile_approx(F.col(value), probs, F.lit(fanout * 50)))).alias("_cuts"))
        levels.append(cut_lineage(cuts))
        ranged = _next_range(ranged, levels[-1], keys, value, len(levels) - 1)
        open_cells = ranged.groupBy(*by, f"_r{len(levels) - 1}").agg(
            F.count(F.lit(1)).alias("_c"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        largest = open_cells.where(F.col("_low") < F.col("_high")).agg(F.max("_c")).first()[0] or 0
    return levels or None


def _next_range(df: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str, level: int) -> DataFrame:
    """Add ``_r<level>``: even numbers lie between two cuts, odd ones are a cut itself, 0 where the cell is not cut."""
    v, less = F.col(value), lambda c: c < F.col(value)
    # cuts are in order: look among every STRIDE-th of them, then among those that follow it
    ahead = F.size(F.filter(F.col("_strides"), less)) * STRIDE
    found = F.col("_ahead") + F.size(F.filter(F.slice("_cuts", F.col("_ahead") + 1, STRIDE), less))
    equal = F.coalesce(F.get("_cuts", F.col("_below")) == v, F.when(v.isNotNull(), False)).cast("int")
    on = [*keys, *[f"_r{i}" for i in range(level)]]
    cuts = cuts.withColumn("_strides", F.filter("_cuts", lambda c, i: i % STRIDE == STRIDE - 1))
    out = df.join(cuts, on, "left").withColumn("_ahead", ahead).withColumn("_below", found)
    return out.withColumn(f"_r{level}", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_below") * 2 + equal)).drop(
        "_cuts", "_strides", "_ahead", "_below")


def with_range(df: DataFrame, cuts: list[DataFrame] | None, keys: Sequence[str], value: str, fanout: int = FANOUT) -> DataFrame:
    """Add ``_range``, a number that grows with the value range of a row within its group (0 where the group is not cut)."""
    place = F.lit(0).cast("long")
    for level, each in enumerate(cuts or []):
        df = _next_range(df, each, keys, value, level)
        place = place * (2 * fanout) + F.col(f"_r{level}")
    return df.withColumn("_range", place).drop(*[f"_r{i}" for i in range(len(cuts or []))])


def ordered_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    sums: Mapping[str, Column] | None = None,
    descending: bool = True,
    limit: int = GROUP_LIMIT,
    name: str = "v",
) -> DataFrame:
    """One row per group and distinct value, with running totals.

    For ``cnt`` and every named sum ``s`` the result holds the value's own amount ``s``, the amount
    strictly before it in the asked order ``s_before`` and the group's ``s_total``. NULL values are
    left out. ``df`` is read more than once: pass a table or a checkpoint, not a costly plan.
    """
    sums = dict(sums or {})
    keys = list(keys)
    src = df.select(*keys, dbl(value).alias(name), *[c.alias(s) for s, c in sums.items()])
    src = src.where(F.col(name).isNotNull())
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    names = ["cnt", *sums]
    amounts = [F.count(F.lit(1)).cast("double").alias("cnt"), *[F.sum(dbl(s)).alias(s) for s in sums]]
    flat = src.groupBy(*by, name).agg(*amounts)
    cuts = None
    if largest_group(src, by) > limit:
        flat = cut_lineage(flat)  # from here on only distinct values are read
        cuts = range_cuts(flat.select(*by, name), by, name, limit)
    order = F.col(name).desc() if descending else F.col(name).asc()
    before = lambda w: [F.coalesce(F.sum(s).over(w), F.lit(0.0)).alias(f"{s}_before") for s in names]
    if cuts is None:
        whole = Window.partitionBy(*by)
        ahead = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return flat.select(*keys, name, *names, *before(ahead), *[F.sum(s).over(whole).alias(f"{s}_total") for s in names])
    flat = with_range(flat, cuts, by, name)
    # per range and group only totals are left, so this window is short
    totals = flat.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in names])
    whole = Window.partitionBy(*by)
    step = F.col("_range").desc() if descending else F.col("_range").asc()
    ahead = whole.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(s).over(ahead), F.lit(0.0)).alias(f"{s}_offset") for s in names],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in names])
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = flat.select("*", *before(within)).join(offsets, [*by, "_range"])
    return out.select(
        *keys, name, *names, *[(F.col(f"{s}_before") + F.col(f"{s}_offset")).alias(f"{s}_before") for s in names],
        *[f"{s}_total" for s in names])


def percentile_of(p: float, name: str = "v") -> Column:
    """Aggregate over :func:`ordered_totals` (descending): exact percentile, linear interpolation."""
    n, first = F.col("cnt_total"), F.col("cnt_total") - F.col("cnt_before") - F.col("cnt")
    h = (n - 1) * F.lit(float(p))
    low = F.floor(h)
    v_low = F.max(F.when(first <= low, F.col(name)))
    v_high = F.max(F.when(first <= F.least(low + 1, n - 1), F.col(name)))
    return v_low + F.max(h - low) * (v_high - v_low)


def lower_quantile_of(p: float, name: str = "v") -> Column:
    """Aggregate over :func:`ordered_totals` (descending): an element of the data, no interpolation."""
    n, first = F.col("cnt_total"), F.col("cnt_total") - F.col("cnt_before") - F.col("cnt")
    at = F.greatest(F.ceil(n * F.lit(float(p))) - 1, F.lit(0))
    return F.max(F.when(first <= at, F.col(name)))


def top_mean_of(k: Column | int, name: str = "v") -> Column:
    """Aggregate over :func:`ordered_totals` (descending): mean of the k largest values."""
    kk = F.least(k if isinstance(k, Column) else F.lit(k), F.col("cnt_total"))
    take = F.least(F.col("cnt"), F.greatest(kk - F.col("cnt_before"), F.lit(0.0)))
    return F.sum(take * F.col(name)) / F.max(kk)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, limit: int = GROUP_LIMIT, heavy_shares: int = HEAVY_SHARES) -> DataFrame:
    """Attach the ascending average rank of ``value`` within its group (ties share their mean rank).

    Rows of a value meet its rank in one task. Values with more than ``limit`` rows and more than one of ``heavy_shares``
    parts of the table, of which there are fewer than ``heavy_shares``, are broadcast to their rows instead.
    """
    t = ordered_totals(df, keys, value, descending=False, limit=limit)
    t = t.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("v").alias("_v"), F.col("cnt").alias("_cnt"),
                 (F.col("cnt_before") + (F.col("cnt") + 1) / 2).alias("avg_rank"))

    def ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
        on = dbl(rows[value]) == ranks["_v"]
        for k in keys:
            on = on & (rows[k] == ranks[f"_k{k}"])
        return rows.join(ranks, on).select(*df.columns, "avg_rank")

    if largest_group(df, keys) <= limit:
        return ranked(df, t)
    t = cut_lineage(t)
    least = F.col("_cnt") > max(limit, t.agg(F.sum("_cnt")).first()[0] / heavy_shares)
    heavy = t.where(least)
    if heavy.isEmpty():
        return ranked(df, t)
    return ranked(df, F.broadcast(heavy)).unionByName(ranked(df.join(
        F.broadcast(heavy), [dbl(df[value]) == heavy["_v"], *[df[k] == heavy[f"_k{k}"] for k in keys]], "left_anti"), t.where(~least)))


def hash_text(*parts) -> Column:
    """md5 of the '|'-joined parts."""
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else col(p).cast("string") for p in parts]))


def stratum(text: str, strata: int) -> Column:
    """Equal share of the md5 range that a hash falls into."""
    return F.floor(F.conv(F.substring(text, 1, 8), 16, 10).cast("long") * strata / F.lit(4294967296)).cast("int")


def hash_sample(df: DataFrame, keys: Sequence[str], n: Column | int, *parts, limit: int = GROUP_LIMIT) -> DataFrame:
    """Exactly min(n, size) rows of every group, uniform and repeatable, in no particular order.

    Rows are ordered by the md5 of ``parts``. Where a group exceeds ``limit`` rows, the hash range is
    cut into strata: strata wholly inside the sample are kept unsorted, and only the boundary stratum
    of a group is ranked.
    """
    keys = list(keys)
    many = n if isinstance(n, Column) else F.lit(n)
    tagged = df.withColumn("_h", hash_text(*parts))
    largest = largest_group(df, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    if largest <= limit:
        return tagged.withColumn("_r", rank).where(F.col("_r") <= many).drop("_h", "_r")
    tagged = tagged.withColumn("_s", stratum("_h", min(GROUP_LIMIT, 4 * math.ceil(largest / limit))))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = tagged.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    joined = tagged.join(upto, [*keys, "_s"]).withColumn("_limit", many).withColumn("_before", F.col("_upto") - F.col("_n"))
    joined = joined.where(F.col("_before") < F.col("_limit"))
    whole = F.col("_upto") <= F.col("_limit")
    edge = joined.where(~whole).withColumn("_r", rank).where(F.col("_r") <= F.col("_limit") - F.col("_before"))
    return joined.where(whole).select(*df.columns).unionByName(edge.select(*df.columns))


def hash_index(df: DataFrame, keys: Sequence[str], id_col: str, name: str = "idx", limit: int = GROUP_LIMIT) -> DataFrame:
    """Number the rows of every group 0 .. n-1 in md5 order of their id, with the group size as ``n``.

    Only one hash stratum of a large group is ever sorted in one task.
    """
    keys = list(keys)
    strata = min(GROUP_LIMIT, max(1, 4 * math.ceil(largest_group(df, keys) / limit) - 4))
    tagged = df.withColumn("_h", hash_text(id_col)).withColumn("_s", stratum("_h", strata))
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c")).select(
        *keys, "_s", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"), F.sum("_c").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", id_col)) - 1
    return tagged.withColumn("_i", inside).join(sizes, [*keys, "_s"]).withColumn(
        name, F.col("_o") + F.col("_i")).drop("_h", "_s", "_i", "_o")


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", first: int = 0,
                  limit: int = GROUP_LIMIT) -> DataFrame:
    """Number the rows of every group ``first``, ``first`` + 1 .. in the order of the columns ``order``.

    Groups up to ``limit`` rows need one window. Otherwise rows are dealt by ranges of (keys, order) and sorted inside them; a row's
    number is its place in the range plus what lies in the group's earlier ranges, one short row per range and group.
    Rows that are equal in ``order`` come in any order.
    """
    keys, order = list(keys), list(order)
    if largest_group(df, keys) <= limit:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1 + first)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / limit))
    placed = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(placed.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id()))
    ends = placed.groupBy(*keys, "_p").agg(F.min("_m").alias("_f"), F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_o", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).withColumnsRenamed({k: f"_k{k}" for k in keys} | {"_p": "_q"})
    on = F.col("_p") == F.col("_q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    return placed.join(ends, on).withColumn(name, F.col("_m") - F.col("_f") + F.col("_o") + first).select(*df.columns, name)
