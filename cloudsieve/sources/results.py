"""Readers and writers of result tables, sample records, score maps and logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clouds import list_files, local_path

RECORD = "file string, label int, n_points long, n_anom_points long, fitness double"


def _path():
    return local_path(F.col("_metadata.file_path"))


def read_result_csv(spark: SparkSession, paths: str | Sequence[str], dataset: str) -> DataFrame:
    """Result files in long form: tag, seed, file, category, metric, value (tag and seed from the name).

    Files may hold different metrics, so each is read with its own header; there is one per run.
    """
    listing = [r["path"] for r in list_files(spark, paths).select("path").orderBy("path").collect()]
    pattern = rf"^(.+)-s(\d+)_{dataset}_"
    out = None
    for path in listing:
        name = path.rsplit("/", 1)[-1]
        m = re.match(pattern, name)
        if not m:
            continue
        raw = spark.read.option("header", True).csv(path)
        metrics = raw.columns[1:]
        wide = raw.select(
            F.lit(m.group(1)).alias("tag"), F.lit(int(m.group(2))).alias("seed"), F.lit(name).alias("file"),
            F.col(f"`{raw.columns[0]}`").alias("category"),
            *[F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None)).alias(c) for c in metrics])
        long = wide.unpivot(["tag", "seed", "file", "category"], metrics, "metric", "value")
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise FileNotFoundError(f"no result files of {dataset} match {paths}")
    return out


def read_records_json(spark: SparkSession, paths: str | Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Sample records {category: [record]} as long scores; a later file replaces a category of the same seed.

    The seed stands in the file name (-sN, optionally with a part), 0 where it does not.
    """
    fields = RECORD + "".join(f", `{c}` double" for c in channels)
    text = spark.read.text(paths, wholetext=True).select(
        F.element_at(F.split(_path(), "/"), -1).alias("source"),
        F.from_json("value", f"map<string, array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>>").alias("_m"))
    seed = F.coalesce(F.nullif(F.regexp_extract("source", r"-s(\d+)(?:-part\d+)?_", 1), F.lit("")).cast("int"), F.lit(0))
    rows = text.select("source", seed.alias("seed"), F.explode("_m").alias("category", "_r"))
    last = rows.groupBy("seed", "category").agg(F.max("source").alias("source"))
    rows = rows.join(last, ["seed", "category", "source"], "left_semi")
    flat = rows.select("seed", "category", F.posexplode("_r").alias("position", "_r")).select(
        "seed", "category", "position", "_r.*")
    return flat.unpivot(["seed", "category", "position", "file", "label", "n_points", "n_anom_points"],
                        list(channels), "channel", "score").where(F.col("score").isNotNull() & ~F.isnan("score"))


def read_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Log lines with their file name."""
    return spark.read.text(paths).select(F.element_at(F.split(_path(), "/"), -1).alias("log"), "value")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True,
                           schema="max_nn int, rule string, views string, pooling string, mhr boolean")


def write_result_csv(results: DataFrame, path: str, category: str = "category") -> None:
    """One wide file: a row per category and the mean row (a small table by construction)."""
    results.orderBy(F.col(category) == "__mean__", category).coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)


def write_records_json(scores: DataFrame, path: str) -> None:
    """Sample records as JSON lines, one folder per category."""
    scores.write.mode("overwrite").partitionBy("category").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("category").parquet(path)


def write_maps(points: DataFrame, path: str, limit: int | None = None, keys: Sequence[str] = ("category", "cloud_id")) -> None:
    """Score maps of selected samples, whole; thinned to ``limit`` points each only when asked."""
    from ..operators.prefix import hash_sample
    if limit is not None:
        points = hash_sample(points, list(keys), limit, F.lit("map"), F.col("point_idx").cast("string"))
    points.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_diagnostics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(rows: DataFrame, digits: int = 2) -> str:
    """A small report table as markdown; reports hold one row per channel or category."""
    names = rows.columns
    out = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows.toLocalIterator():
        cells = [("" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)) for v in r]
        out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out) + "\n"
