"""Following append-only logs while jobs run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of log lines with the file they stand in; new files are picked up as they appear."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("log"), "value")


def progress(lines: DataFrame) -> DataFrame:
    """Running count of lines and failure lines per log; the state is one row per log."""
    bad = F.col("value").contains("Error") | F.col("value").contains("Traceback")
    return lines.groupBy("log").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_errors"))


def watch(spark: SparkSession, folder: str, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the progress of all logs under ``name``, a view of files beside the checkpoint.

    Each batch writes the logs that changed; the view shows the last state of every log. Nothing is held by the driver.
    """
    path = f"{checkpoint.rstrip('/')}-progress"

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        latest(spark, path).createOrReplaceTempView(name)
    writer = progress(follow_logs(spark, folder)).writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The progress of every log as of its last change."""
    last = spark.read.parquet(path).groupBy("log").agg(F.max_by(F.struct("n_lines", "n_errors"), "batch").alias("_v"))
    return last.select("log", "_v.*")
