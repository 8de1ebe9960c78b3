"""Queries over tables of sample scores and results.

``scores``: seed, category, file, label, n_points, n_anom_points, channel, score (long form).
``results``: tag, seed, file, category, metric values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.expr import defect_fraction
from ..operators.prefix import ordered_index, ordered_totals, percentile_of
from ..session import cut_lineage
from .bootstrap import bootstrap_auroc, interval


def common_categories(scores: DataFrame) -> DataFrame:
    """Keep the categories that every seed has."""
    seeds = scores.select("seed").distinct().agg(F.count(F.lit(1)).alias("_s"))
    per = scores.groupBy("category").agg(F.countDistinct("seed").alias("_n"))
    # one aggregate row against one row per category
    full = per.join(F.broadcast(seeds), F.col("_n") == F.col("_s")).select("category")
    return scores.join(full, "category", "left_semi")


def keyed(records: DataFrame, listing: Sequence[str], position: str, name: str) -> DataFrame:
    """Sample key: the file name, or position and name if any name repeats in the same list."""
    names = records.groupBy(*listing).agg((F.count(name) != F.countDistinct(name)).alias("_dup"))
    key = F.when(F.col("_dup"), F.format_string("%05d|%s", F.col(position), F.col(name))).otherwise(F.col(name))
    return records.join(names, list(listing)).withColumn("key", key).drop("_dup")


def auroc_by(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return M.roc_table(scores, keys, "label", "score").groupBy(*keys).agg(M.auroc_agg().alias("auroc"))


def seed_table(scores: DataFrame) -> DataFrame:
    """AUROC (%) per channel and seed, mean over categories, with both deviations over seeds."""
    per = auroc_by(common_categories(scores), ["seed", "category", "channel"])
    m = per.groupBy("channel", "seed").agg((F.avg("auroc") * 100).alias("auroc"))
    return m, m.groupBy("channel").agg(
        F.avg("auroc").alias("mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("std_sample"),
        F.stddev_pop("auroc").alias("std_population"), F.count(F.lit(1)).alias("n_seeds"))


def category_report(scores: DataFrame) -> DataFrame:
    """AUROC per channel, category and seed with the per-seed mean row."""
    per = auroc_by(scores, ["seed", "category", "channel"])
    return M.with_mean_row(per, "category", ["auroc"], by=["seed", "channel"])


def bootstrap_summary(scores: DataFrame, a: str, b: str, replicates: int, seed: int = 0) -> DataFrame:
    """Estimate and 95 % interval per channel and for a - b, with the one-sided share p of the latter."""
    scores = cut_lineage(common_categories(scores))
    boot = bootstrap_auroc(scores, replicates, seed)
    per = boot.groupBy("b", "category", "channel").agg(F.avg("auroc").alias("m")).groupBy("b", "channel").agg(
        (F.avg("m") * 100).alias("m"))
    per = cut_lineage(per)  # read for the channels and for their difference
    point = seed_table(scores)[0].groupBy("channel").agg(F.avg("auroc").alias("estimate"))
    by_channel = per.groupBy("channel").agg(*interval("m")).join(point, "channel")
    only = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    diff = per.groupBy("b").agg((only(a, "m") - only(b, "m")).alias("d"))
    est = point.agg((only(a, "estimate") - only(b, "estimate")).alias("estimate"))
    low, high = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    pair = diff.agg(*interval("d"), low.alias("_l"), high.alias("_h")).join(F.broadcast(est), F.lit(True))
    pair = pair.select(F.lit(f"{a} - {b}").alias("channel"), "estimate", "lo", "hi",
                       F.when(F.col("estimate") > 0, F.col("_l")).otherwise(F.col("_h")).alias("p"))
    return by_channel.select("channel", "estimate", "lo", "hi", F.lit(None).cast("double").alias("p")).unionByName(pair)


def category_differences(scores: DataFrame, a: str, b: str, replicates: int, seed: int = 0) -> DataFrame:
    """Paired difference a - b per category (AUROC %, mean over seeds) with its bootstrap interval."""
    scores = cut_lineage(common_categories(scores).where(F.col("channel").isin(a, b)))
    only = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    boot = bootstrap_auroc(scores, replicates, seed).groupBy("b", "category", "channel").agg(F.avg("auroc").alias("m"))
    d = boot.groupBy("b", "category").agg(((only(a, "m") - only(b, "m")) * 100).alias("d"))
    ci = d.groupBy("category").agg(*interval("d"))
    point = auroc_by(scores, ["seed", "category", "channel"]).groupBy("category", "channel").agg(
        (F.avg("auroc") * 100).alias("m"))
    point = point.groupBy("category").agg(only(a, "m").alias("a"), only(b, "m").alias("b"))
    files = scores.select("category", "label", "file").distinct().groupBy("category").agg(
        F.count_if(F.col("label") == 0).alias("n_normal"), F.count_if(F.col("label") == 1).alias("n_anomalous"))
    return files.join(point, "category").withColumn("diff", F.col("a") - F.col("b")).join(ci, "category")


def ranked_differences(differences: DataFrame, value: str = "diff", name: str = "category") -> DataFrame:
    """Differences with their place in the report: largest first, ties by name, undefined ones last. One row per category."""
    return differences.withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), name)))


def choose_metrics(metrics: DataFrame, pattern: str) -> DataFrame:
    """Rows of the long metric table whose whole name matches a regular expression."""
    return metrics.where(F.col("metric").rlike(f"^(?:{pattern})$"))


def significance_counts(differences: DataFrame) -> DataFrame:
    above, below = F.count_if(F.col("lo") > 0), F.count_if(F.col("hi") < 0)
    return differences.agg(above.alias("above"), below.alias("below"),
                           (F.count(F.lit(1)) - above - below).alias("overlapping"))


def operating_points(scores: DataFrame) -> DataFrame:
    """FPR at 95 % TPR and TPR at 5 % FPR per channel (%), mean over categories and seeds."""
    keys = ["seed", "category", "channel"]
    per = M.roc_table(scores, keys, "label", "score").groupBy(*keys).agg(
        M.fpr_at_tpr_agg().alias("fpr"), M.tpr_at_fpr_agg().alias("tpr"))
    return per.groupBy("channel").agg((F.avg("fpr") * 100).alias("fpr_at_95tpr"), (F.avg("tpr") * 100).alias("tpr_at_5fpr"))


def size_strata(scores: DataFrame) -> DataFrame:
    """AUROC (%) of every channel on normals plus one tertile of the defect sizes."""
    frac = scores.withColumn("frac", defect_fraction("n_anom_points", "n_points"))
    anomalous = frac.where("label = 1").select("seed", "category", "file", "frac").distinct()
    q = ordered_totals(anomalous, [], "frac").agg(
        percentile_of(1 / 3).alias("_q1"), percentile_of(2 / 3).alias("_q2"))
    tagged = frac.join(F.broadcast(q), F.lit(True))
    f = F.col("frac")
    name = F.when(f < F.col("_q1"), "small").when(f < F.col("_q2"), "medium").otherwise("large")
    strata = F.when(F.col("label") == 1, F.array(name)).otherwise(F.array(*[F.lit(s) for s in ("small", "medium", "large")]))
    rows = tagged.withColumn("stratum", F.explode(strata))
    per = auroc_by(rows, ["seed", "category", "channel", "stratum"])
    return per.groupBy("channel", "stratum").agg((F.avg("auroc") * 100).alias("auroc"))


def rule_comparison(samples: DataFrame, keys: Sequence[str], label: str, rules: Sequence[str]) -> DataFrame:
    """AUROC per category and pooling rule, with the mean row over categories."""
    long = samples.unpivot([*keys, label], list(rules), "rule", "score").withColumnRenamed(label, "label")
    per = auroc_by(cut_lineage(long), [*keys, "rule"]).where(F.col("auroc").isNotNull())
    return M.with_mean_row(per, keys[0], ["auroc"], by=["rule"])


def normalise_to_training(scores: DataFrame, ref: DataFrame, how: str, keys: Sequence[str]) -> DataFrame:
    """Put scores of different runs on one scale with their training reference (z, ratio or none)."""
    if how == "none":
        return scores
    out = scores.join(ref, list(keys))
    e: Column
    if how == "z":
        e = (F.col("score") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-12))
    elif how == "ratio":
        e = F.col("score") / F.greatest(F.col("p99"), F.lit(1e-12))
    else:
        raise ValueError(how)
    return out.withColumn("score", e).drop("mean", "std", "p50", "p90", "p99")


def subset_fusion(scores: DataFrame, runs: Sequence[str], run: str = "run", by: Sequence[str] = ()) -> DataFrame:
    """AUROC of the mean score over every non-empty subset of the named runs, separately for every value of ``by``.

    Samples must be the same in all runs: a (category, file) without all runs raises.
    """
    by = list(by)
    wide = scores.groupBy(*by, "category", "file", "label").agg(
        *[F.max(F.when(F.col(run) == r, F.col("score"))).alias(f"_r{i}") for i, r in enumerate(runs)])
    whole = reduce(lambda x, y: x & y, [F.col(f"_r{i}").isNotNull() for i in range(len(runs))])
    wide = wide.where(F.when(whole, F.lit(True)).otherwise(
        F.raise_error(F.lit("sample sets of the runs differ")).cast("boolean")))
    parts = []
    for mask in range(1, 2 ** len(runs)):
        inside = [i for i in range(len(runs)) if mask >> i & 1]
        score = reduce(lambda x, y: x + y, [F.col(f"_r{i}") for i in inside]) / len(inside)
        parts.append(F.struct(F.lit("+".join(runs[i] for i in inside)).alias("combo"), score.alias("score")))
    long = wide.select(*by, "category", "label", F.explode(F.array(*parts)).alias("_c")).select(
        *by, "category", "label", "_c.combo", "_c.score")
    return M.with_mean_row(auroc_by(long, [*by, "category", "combo"]), "category", ["auroc"], by=[*by, "combo"])


def latest_runs(results: DataFrame, keys: Sequence[str] = ("tag", "seed"), file: str = "file") -> DataFrame:
    """Rows of the last file per run; earlier files of the same run are superseded."""
    last = results.groupBy(*keys).agg(F.max(file).alias(file))
    return results.join(last, [*keys, file], "left_semi")


def seed_aggregate(runs: DataFrame, value: str = "value") -> DataFrame:
    """Mean and sample deviation over seeds per tag."""
    return runs.groupBy("tag").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg(value).alias("mean"),
                                   F.stddev_samp(value).alias("std"))


def paired_delta(runs: DataFrame, ref: str, value: str = "value") -> DataFrame:
    """Difference to a reference tag over common seeds, and whether it drowns in the seed noise."""
    base = runs.where(F.col("tag") == ref).select("seed", F.col(value).alias("_ref"))
    d = runs.where(F.col("tag") != ref).join(base, "seed").withColumn("_d", F.col(value) - F.col("_ref"))
    n, mean, std = F.count(F.lit(1)), F.avg("_d"), F.stddev_samp("_d")
    noise = (n >= 3) & (F.abs(mean) < 2 * std)
    return d.groupBy("tag").agg(n.alias("n_common"), mean.alias("delta"), std.alias("std"), noise.alias("noise"))


def merge_parts(parts: DataFrame | Sequence[DataFrame], categories: DataFrame, values: Sequence[str],
                allow_partial: bool = False) -> DataFrame:
    """Categories of all parts (one table, or one per part) in official order with the mean row.

    A category in two parts raises, and so does a missing one unless ``allow_partial``. The parts' own mean rows go.
    """
    whole = parts if isinstance(parts, DataFrame) else reduce(DataFrame.unionByName, parts)
    rows = cut_lineage(whole.where(F.col("category") != "__mean__").select("category", *values))
    twice = rows.groupBy("category").count().where(F.col("count") > 1)
    names = [r["category"] for r in twice.limit(20).collect()]
    if names:
        raise ValueError(f"duplicate categories across parts: {names}")
    missing = categories.join(rows, "category", "left_anti")
    names = [r["category"] for r in missing.limit(20).collect()]
    if names and not allow_partial:
        raise ValueError(f"missing categories: {names}")
    kept = rows.join(categories.select("category", "ord"), "category")
    mean = kept.agg(*[F.avg(v).alias(v) for v in values], (F.max("ord") + 1).alias("ord")).withColumn(
        "category", F.lit("__mean__"))
    return kept.select("ord", "category", *values).unionByName(mean.select("ord", "category", *values))


def last_record_wins(records: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the last file."""
    return records.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def error_lines(lines: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """Number of log lines and of those that report a failure."""
    bad = F.col(text).contains("Error") | F.col(text).contains("Traceback")
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_errors"))


def gate(runs: DataFrame, base: str, margin: float, value: str = "value") -> DataFrame:
    """Pivot of tags against a base with PASS or FAIL per tag."""
    ref = runs.where(F.col("tag") == base).agg(F.avg(value).alias("_b"))
    t = runs.groupBy("tag").agg(F.avg(value).alias("mean"), F.count_if(F.lit(True)).alias("n"))
    t = t.join(F.broadcast(ref), F.lit(True)).withColumn("diff", F.col("mean") - F.col("_b"))
    return t.withColumn("gate", F.when(F.col("diff") >= margin, "PASS").otherwise("FAIL")).drop("_b")


def split_counts(listing: DataFrame) -> DataFrame:
    """Files per category and split."""
    return listing.groupBy("category", "split").agg(F.count(F.lit(1)).alias("n_files"))


def round_robin(jobs: DataFrame, order: str, workers: int) -> DataFrame:
    """Worker of every job by its position."""
    return ordered_index(jobs, [], [order], "worker").withColumn("worker", F.pmod("worker", F.lit(workers)).cast("int"))
