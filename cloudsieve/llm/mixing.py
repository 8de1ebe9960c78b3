"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, fresh, quoted, text_of

#: No document, and so no source, is repeated more often.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Steps after which balancing gives up; one constraint with equal tilts takes about seven, mixed ones rarely over 40.
MOST_STEPS = 200
#: Relative error at which a source's target is met.
MOST_ERROR = 1e-10
#: Rates are rounded to this part of a copy.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
#: Passes that mend what rounding left over.
REPAIRS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share the whole size; a target stops at
    ``most`` times its source's size and the excess is shared by weight among the rest: the level at which
    the capped shares sum to the whole. One row per source is ordered in one task; rows are summed before.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    sizes = sizes.withColumn("cap", F.col("source_size") * float(most))
    everyone = Window.partitionBy()
    filled = everyone.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    share = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    sizes = sizes.withColumn("level", rest / share)
    open_level = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))
    sizes = sizes.withColumn("at", F.min(open_level).over(everyone)["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return sizes.select("source", "source_size", target.alias("target"))


def _rate(multiplier: str, tilt: str, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col(multiplier) * F.col(tilt), F.lit(math.log(most) + 1))))


def entropy_balance(masses: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``targets`` with ``multiplier``, the dual variable of each source's token constraint.

    ``masses`` (source, tilt, mass): documents with equal tilt are summed beforehand. Of all rates between 0 and
    ``most`` that meet the token targets, exp(multiplier * tilt) is nearest to 1 in token-weighted relative
    entropy. The convex dual is separable by source; all sources take damped Newton steps together, each step
    one grouped sum of gradient and curvature over ``masses``; the state is one short row per source. The total grows
    with the multiplier, so the multipliers seen on either side of the target bracket the solution: a step that leaves
    the bracket is replaced by its middle. Where every rate is at the cap the step goes back to the nearest multiplier
    at which one leaves it. Only the largest remaining error reaches the driver; a target that cannot be met raises.
    """
    none = F.lit(None).cast("double")
    state = targets.withColumn("multiplier", F.lit(0.0)).withColumn("low", none).withColumn("high", none)
    summed = cut_lineage(masses.groupBy("source", "tilt").agg(F.sum("mass").cast("double").alias("mass")))
    at, error = F.col("multiplier"), F.col("error")
    for _ in range(MOST_STEPS):
        met = summed.alias("m").join(state.alias("s"), F.expr("m.source <=> s.source")).select("s.*", "tilt", "mass")
        rate = _rate("multiplier", "tilt", most)
        moved = F.col("mass") * F.col("tilt")
        free = F.when(at * F.col("tilt") <= math.log(most), moved * F.col("tilt") * rate).otherwise(0.0)
        capped_from = F.when(F.col("tilt") != 0, F.lit(math.log(most)) / F.col("tilt"))
        sums = met.groupBy("source", "source_size", "target", "multiplier", "low", "high").agg(
            F.sum(moved * rate).alias("got"), F.sum(free).alias("curve"), F.max(F.abs("tilt")).alias("scale"),
            F.max(F.when(capped_from < at, capped_from)).alias("before"),
            F.min(F.when(capped_from > at, capped_from)).alias("after"))
        above = F.col("got") > F.col("target")
        sums = sums.withColumn("low", F.when(above, F.col("low")).otherwise(at)).withColumn(
            "high", F.when(above, at).otherwise(F.col("high")))
        sums = sums.withColumn("error", F.abs(F.col("target") - F.col("got")) / F.greatest(F.abs("target"), F.lit(1.0)))
        newton = F.when(F.col("curve") > 0, (F.col("target") - F.col("got")) / F.col("curve"))
        far = F.greatest(F.lit(2.0) / F.when(F.col("scale") > 0, F.col("scale")), F.abs(at))
        damped = at + F.greatest(-far, F.least(far, newton))
        free_again = F.coalesce(F.when(above, F.col("before")).otherwise(F.col("after")), at)
        to = F.when(F.col("curve") > 0, damped).otherwise(free_again)
        inside = F.coalesce((to > F.col("low")) & (to < F.col("high")), F.lit(True))
        to = F.when(error < MOST_ERROR, at + F.coalesce(newton, F.lit(0.0))).when(
            inside, to).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut_lineage(sums.select(
            "source", "source_size", "target", to.alias("multiplier"), "low", "high", "error", (to == at).alias("still")).coalesce(1))
        left, stuck = state.agg(F.max("error"), F.max(F.when(F.col("still") & (error >= MOST_ERROR), error))).first()
        if (left or 0.0) < MOST_ERROR:
            break
        if stuck is not None:
            raise ValueError(f"a source's target is not met at any multiplier: relative error {stuck:.3g}")
        state = state.drop("error", "still")
    else:
        raise ValueError(f"targets are not met after {MOST_STEPS} steps: relative error {left:.3g}")
    return state.select("source", "source_size", "target", "multiplier")


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Add ``copies`` to rows (source, size, target, units, tag...): rates rounded in descending order of size.

    Rates are whole ``UNIT``s, so sums are exact however rows are dealt. A running sum of rates is rounded at each row, so a source's copies are never off by more than one half row of its
    current size. Rows are range-partitioned by (source, size, hash of the tag), whatever is hot; a running sum within a
    partition and the totals of (partition, source) before it give the place in the source.
    """
    tag = F.xxhash64("tag")
    dealt = rows.repartitionByRange(F.col("source"), F.desc("size"), tag, F.col("tag")).withColumn("at", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    order = Window.partitionBy("at", "source").orderBy(F.desc("size"), tag, "tag")
    dealt = dealt.withColumn("place", F.row_number().over(order)).withColumn(
        "upto", F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("at", "source").agg(F.sum("units").alias("rates")).select(
        "at", "source", F.coalesce(F.sum("rates").over(ahead), F.lit(0)).alias("before"))
    joined = dealt.alias("d").join(totals.alias("t"), F.expr("d.at = t.at AND d.source <=> t.source")).select("d.*", "before")
    upto = F.col("before") + F.col("upto")
    rounded = lambda x: F.shiftright(x + UNIT // 2, UNIT_BITS)
    count = rounded(upto) - rounded(upto - F.col("units"))
    return joined.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(most), count)).cast("int"))


def _repairs(rows: DataFrame, most: int) -> DataFrame:
    """(source, at, place, by): single copies to give or take, per source and pass one of the document nearest in size to what is off.

    Passes carry only what each source is off by and its changes so far: a few short rows per source.
    """
    off = cut_lineage(rows.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"),
        F.array().cast("array<struct<at: int, place: int, by: int>>").alias("done")).coalesce(1))
    for _ in range(REPAIRS):
        met = rows.alias("r").join(off.alias("o"), F.expr("r.source <=> o.source")).select("r.*", "off", "done")
        may = F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        fresh_row = ~F.exists("done", lambda d: (d["at"] == F.col("at")) & (d["place"] == F.col("place")))
        left = F.abs(F.abs("off") - F.col("size"))
        pick = met.where(may & fresh_row & (left < F.abs("off"))).groupBy("source").agg(F.min(F.struct(
            left.alias("left"), "at", "place", F.signum("off").cast("int").alias("by"), "size")).alias("x"))
        both = off.alias("o").join(pick.alias("p"), F.expr("o.source <=> p.source"), "left")
        change = F.array(F.struct("x.at", "x.place", "x.by"))
        off = cut_lineage(both.select(
            "o.source", (F.col("off") - F.coalesce(F.col("x.by") * F.col("x.size"), F.lit(0))).alias("off"),
            F.when(F.col("x").isNull(), F.col("done")).otherwise(F.concat("done", change)).alias("done")).coalesce(1))
    return off.select("source", F.explode("done").alias("d")).select("source", "d.*")


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows (source, size, tag[, tilt]) with ``source_size``, ``target``, ``copies`` and ``taken``.

    ``tilt`` (default 1) is the statistic whose token-weighted total is constrained; with 1 every document of a source
    has the same rate. ``tag`` identifies a document; rows equal in all three are interchangeable.
    """
    if "tilt" not in rows.columns:
        rows = rows.withColumn("tilt", F.lit(1.0))
    rows = cut_lineage(rows)
    targets = cut_lineage(source_targets(rows, weights, most))
    state = entropy_balance(rows.select("source", "tilt", F.col("size").alias("mass")), targets, most)
    rated = rows.alias("r").join(state.alias("s"), F.expr("r.source <=> s.source")).select(
        "r.*", "source_size", "target", F.round(_rate("multiplier", "tilt", most) * UNIT).cast("long").alias("units"))
    done = cut_lineage(_copies(rated, most))
    mended = _repairs(done, most).select(
        F.col("at").alias("_at"), F.col("place").alias("_place"), F.col("source").alias("_source"), "by")
    done = done.join(mended, F.expr("at = _at AND place = _place AND source <=> _source"), "left")
    done = done.withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("_at", "_place", "_source", "by")
    return done.withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: the id, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken``.

    Null text has size 0; null sources form one source, last in order. A source without words has target 0. Repeated
    rows count as documents of their own. Reruns agree: order and ties come from sizes and hashes. An empty table gives
    no rows. Extra columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(quoted(source_col)).cast("string").alias("source"), word_count(text).alias("size"),
        F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text")).alias("tag"))
    return mix_rows(rows).select(
        F.col("tag.id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken", F.col("tag.text").alias("text_hash"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it has copies, with all its columns.

    Rows equal in id, text and source are interchangeable: of each such group it is counted how many rows have at least
    1, 2, ... copies, and rows take copies by their turn. Their work grows with their number, but they meet in one task.
    """
    a, b, c, n, m, copy = fresh(docs, "_id_hash", "_text_hash", "_source_hash", "_turn", "_at_least", "_copy")
    turn = F.row_number().over(Window.partitionBy(a, b, c).orderBy(a))
    found = mix_sources(docs, id_col, text_col, source_col).where(F.col("copies") > 0).groupBy(
        F.xxhash64(F.col(quoted(id_col))).alias(a), F.col("text_hash").alias(b), F.xxhash64("source").alias(c)).agg(
        F.array(*[F.count_if(F.col("copies") >= i) for i in range(1, MOST_COPIES + 1)]).alias(m))
    keyed = docs.select(
        *[F.col(quoted(x)) for x in docs.columns], F.xxhash64(F.col(quoted(id_col))).alias(a),
        F.xxhash64(text_of(text_col)).alias(b), F.xxhash64(F.col(quoted(source_col)).cast("string")).alias(c)).withColumn(n, turn)
    # texts are dealt once, by the window's three hashes: the turn must not become a key of the join
    met = keyed.alias("l").join(found.alias("r"), [F.col(f"l.{x}") == F.col(f"r.{x}") for x in (a, b, c)])
    met = met.withColumn(copy, F.size(F.filter(m, lambda rows: rows >= F.col(n)))).where(F.col(copy) > 0)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(
        *[F.col("l." + quoted(x)) for x in docs.columns])
