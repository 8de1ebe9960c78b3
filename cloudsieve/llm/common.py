"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the text contracts: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A word is a longest run of anything else.
WORD = "[^\\x20\\x09-\\x0D]+"


def text_of(name: str) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns that an operator is about to write under these names."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def partitions(df: DataFrame) -> int:
    """Reducers the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="cloudsieve-tables-")
    return folder.rstrip("/")


def fleeting(spark, path: str) -> str:
    """``path``, to be deleted when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, which cuts its lineage; gone when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(fleeting(spark, path))
