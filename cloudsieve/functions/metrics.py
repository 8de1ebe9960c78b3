"""Detection metrics as aggregates over ordered running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dbl
from ..session import cut_lineage
from ..operators.prefix import GROUP_LIMIT, ordered_totals


def roc_table(df, keys: Sequence[str], label: str, score: str, weight: Column | None = None,
              limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per group and distinct score with the counts of both classes at and above it."""
    y = dbl(label)
    w = weight if weight is not None else F.lit(1.0)
    return ordered_totals(df, keys, score, {"pos": y * w, "neg": (1 - y) * w}, descending=True, limit=limit)


def _both(e: Column) -> Column:
    ok = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    return F.when(ok, e)


def auroc_agg() -> Column:
    below = F.col("neg_total") - F.col("neg_before") - F.col("neg") / 2
    return _both(F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("pos_total") * F.col("neg_total"))))


def average_precision_agg() -> Column:
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    return _both(F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_total")))


def fpr_at_tpr_agg(target: float = 0.95) -> Column:
    tpr = F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total"))
    fpr = F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total"))
    return _both(F.coalesce(F.min(F.when(tpr >= target, fpr)), F.lit(1.0)))


def tpr_at_fpr_agg(target: float = 0.05) -> Column:
    tpr = F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total"))
    fpr = F.try_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total"))
    return _both(F.coalesce(F.max(F.when(fpr <= target, tpr)), F.lit(0.0)))


def detection_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str,
                      operating_points: bool = False) -> DataFrame:
    """AUROC and average precision per group; NULL where a group holds one class only."""
    t = roc_table(df, keys, label, score)
    aggs = [auroc_agg().alias("auroc"), average_precision_agg().alias("aupr")]
    if operating_points:
        aggs += [fpr_at_tpr_agg().alias("fpr_at_95tpr"), tpr_at_fpr_agg().alias("tpr_at_5fpr")]
    return t.groupBy(*keys).agg(*aggs)


def compute_metrics(samples: DataFrame, points: DataFrame, category: str = "category", cloud: str = "cloud_id",
                    label: str = "label", object_score: str = "object_score", gt: str = "gt",
                    point_score: str = "score") -> DataFrame:
    """Object metrics, per-sample mean point metrics and pooled point metrics per category.

    The per-sample mean runs over the samples that hold both classes, as NULL rows drop out of avg.
    """
    # one row per sample, read three times
    samples = cut_lineage(samples)
    obj = detection_metrics(samples, [category], label, object_score).select(
        category, F.col("auroc").alias("o_auroc"), F.col("aupr").alias("o_aupr"))
    counts = samples.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col(label).cast("long")).alias("n_anom"))
    each = detection_metrics(points, [category, cloud], gt, point_score).groupBy(category).agg(
        F.avg("auroc").alias("p_auroc"), F.avg("aupr").alias("p_aupr"))
    pooled = detection_metrics(points, [category], gt, point_score).select(
        category, F.col("auroc").alias("p_auroc_pooled"), F.col("aupr").alias("p_aupr_pooled"))
    return (counts.join(obj, category, "left").join(each, category, "left").join(pooled, category, "left"))


def with_mean_row(df: DataFrame, category: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Append the ``__mean__`` row: plain mean of the per-category values, NULLs skipped."""
    keys = [*by, category]
    rolled = df.rollup(*keys) if not by else None
    if rolled is not None:
        out = rolled.agg(F.grouping(category).alias("_g"), *[F.avg(v).alias(v) for v in values])
        return out.select(
            F.when(F.col("_g") == 1, F.lit("__mean__")).otherwise(F.col(category).cast("string")).alias(category),
            *values)
    mean = df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values]).withColumn(category, F.lit("__mean__"))
    return df.select(*by, F.col(category).cast("string").alias(category), *values).unionByName(
        mean.select(*by, category, *values))
