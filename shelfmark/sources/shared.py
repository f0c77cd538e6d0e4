"""Tables written to the folder that driver and executors share: cuts of lineage that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's; one of our own only on a local master."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="shelfmark-"))
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` there and read it back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shelfmark_path = path
    return out


def exists(df: DataFrame) -> bool:
    """Whether a written table is still there."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shelfmark_path)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)


def drop(df: DataFrame) -> None:
    """Delete a written table once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shelfmark_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
