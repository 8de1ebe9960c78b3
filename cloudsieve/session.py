"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cloudsieve", cores: str | None = None) -> SparkSession:
    """Session with the settings the operators assume; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        )
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the folder the session names.

    The folder comes from ``spark.checkpoint.dir``. Only a local session that names none gets a
    temporary one; a cluster must name a shared folder, because executors can be lost.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` as a table beside the checkpoints, gone when the application ends; for what a loop or a long chain of joins makes.

    A checkpoint keeps the planner's size estimate, which every join multiplies: from round to round, and from step to step of a
    chain, its number of digits grows by a factor, until the driver is full of it. A table is as large as its files.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    """Folder of the checkpoints, which all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="cloudsieve-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition small rows that are expensive to process over all cores.

    Adaptive execution merges partitions by their bytes, which would line up compute-heavy groups in
    a few tasks; an explicit partition number is left as it is.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
