"""Choosing a configuration on normal-only development units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .analytics import auroc_by
from .bootstrap import unit_bootstrap

# Options in order of simplicity and the tie margin in AUROC points.
RULES = ("glob_cs", "glob_full", "loc10", "loc05", "loc15", "knn64", "knn256", "soft0p5", "soft1", "soft2",
         "cal10_k0", "cal10", "hyb")
VIEWS = ("V0", "V01", "V02", "M2", "V012")
POOLING = ("p99", "max", "p95", "top1pct", "mean")
SINGLE_POSE_RULES = ("glob_full", "loc05", "loc10", "loc15", "knn64", "knn256", "cal10")
TIE = 0.5


def alias_missing_views(records: DataFrame) -> DataFrame:
    """Fill a view subset that equals the full memory from the full-memory channel of the same sample.

    ``records``: k, dataset, unit, file, label, key, score with key = channel_pooling.
    """
    ids = ["k", "dataset", "unit", "file", "label"]
    fill = []
    for family in ("loc10", "glob_full"):
        for pool in POOLING:
            names = [f"{family}_{v}_{pool}" for v in VIEWS[:-1]]
            fill.append(F.when(F.col("key") == f"{family}_{pool}", F.array(*[F.lit(n) for n in names])))
    names = F.coalesce(*fill)
    made = records.where(names.isNotNull()).select(*ids, F.explode(names).alias("key"), "score")
    missing = made.join(records.select(*ids, "key"), [*ids, "key"], "left_anti")
    return records.unionByName(missing)


def unit_values(records: DataFrame) -> DataFrame:
    """AUROC per scale, dataset, unit and key, for keys that every sample of the unit has."""
    by = ["k", "dataset", "unit"]
    size = records.groupBy(*by).agg(F.countDistinct("file").alias("_n"))
    whole = records.groupBy(*by, "key").agg(F.count("score").alias("_c")).join(size, by).where(
        F.col("_c") == F.col("_n")).select(*by, "key")
    rows = cut_lineage(records.join(whole, [*by, "key"], "left_semi"))
    return auroc_by(rows, [*by, "key"])


def config_scores(units: DataFrame) -> DataFrame:
    """Mean over datasets of the mean over units (%), per scale and key."""
    per = units.groupBy("k", "key", "dataset").agg((F.avg("auroc") * 100).alias("m"))
    return per.groupBy("k", "key").agg(F.avg("m").alias("mean"))


def pick(options: DataFrame, value: str = "mean", order: str = "ord", tie: float = TIE) -> DataFrame:
    """The first option in order whose value lies within the tie margin of the best."""
    best = options.agg(F.max(value).alias("_best"))
    near = options.join(F.broadcast(best), F.col(value) >= F.col("_best") - tie)
    return near.groupBy().agg(*[F.min_by(c, order).alias(c) for c in options.columns])


def differences_to_best(units: DataFrame, keys: Sequence[str], k: int, replicates: int, seed: int = 0) -> DataFrame:
    """Interval of every option's distance to the best one, redrawing units within datasets."""
    part = units.where((F.col("k") == k) & F.col("key").isin(*keys))
    best = config_scores(part).agg(F.max_by("key", "mean").alias("_best"))
    ref = part.join(F.broadcast(best), F.col("key") == F.col("_best")).select(
        "dataset", "unit", F.col("auroc").alias("_ref"), "_best")
    d = part.join(ref, ["dataset", "unit"]).where(F.col("key") != F.col("_best")).select(
        F.col("key").alias("option"), "dataset", "unit", (F.col("auroc") - F.col("_ref")).alias("diff"))
    return unit_bootstrap(d.where(F.col("diff").isNotNull()), replicates, seed)


@dataclass(frozen=True)
class Selection:
    max_nn: int
    rule: str
    views: str
    pooling: str
    mhr: bool


@dataclass(frozen=True)
class Step:
    """One decision: its options in order of simplicity, each with the key that is scored, as SQL over what is decided so far.

    ``options`` are (value, key expression); the columns ``k``, ``rule``, ``views`` and ``pooling`` hold earlier choices. The
    step is skipped, and ``otherwise`` taken, where ``asked`` is false.
    """

    name: str
    options: tuple[tuple[str, str], ...]
    asked: str = "true"
    otherwise: str | None = None


_ONE_POSE = ", ".join(f"'{r}'" for r in SINGLE_POSE_RULES)
_FAMILY = "CASE WHEN startswith(rule, 'glob') THEN 'glob_full' ELSE 'loc10' END"
#: After the scale, whose options are the scales at hand.
STEPS = (
    Step("rule", tuple((r, f"'{r}_p99'") for r in RULES)),
    Step("views", tuple((v, f"concat({_FAMILY}, '{'' if v == 'V012' else '_' + v}_p99')") for v in VIEWS)),
    Step("pooling", tuple((p, f"concat(rule, '_{p}')") for p in POOLING)),
    Step("mhr", (("false", "concat('h1_', rule, '_', pooling)"), ("true", "concat(rule, '_', pooling)")), f"rule IN ({_ONE_POSE})", "true"),
)


def decide(scores: DataFrame, state: DataFrame, step: Step) -> DataFrame:
    """``state`` (one row of choices) with the choice of ``step`` added, from ``scores`` (k, key, mean)."""
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("option"), F.expr(key).alias("key")) for i, (v, key) in enumerate(step.options)])
    options = state.where(F.expr(step.asked)).select("k", F.inline(listed))
    best = pick(options.join(scores.where(F.col("mean").isNotNull()), ["k", "key"])).select(F.col("option").alias(step.name))
    return state.join(F.broadcast(best), F.lit(True), "left").withColumn(step.name, F.coalesce(step.name, F.lit(step.otherwise)))


def select_configuration(units: DataFrame) -> Selection:
    """Five decisions, each among the scored options that the earlier ones leave open."""
    scores = cut_lineage(config_scores(units))
    scales = scores.where((F.col("key") == "loc10_p99") & F.col("mean").isNotNull()).withColumn("ord", F.col("k"))
    state = cut_lineage(pick(scales).select("k"))
    for step in STEPS:
        state = cut_lineage(decide(scores, state, step))
    row = state.first()
    return Selection(row["k"], row["rule"], row["views"], row["pooling"], row["mhr"] == "true")
