"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder; a cluster has to name one.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage is cut at files every executor can reach, so work that follows
    survives the loss of the executors that made them, and isn't done twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def list_done(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` that Spark has finished writing."""
    files, own = _files(spark, path)
    if not files.exists(own):
        return []
    names = [s.getPath().getName() for s in files.listStatus(own) if s.isDirectory()]
    jvm = spark.sparkContext._jvm
    return sorted(n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, own = _files(spark, path)
    files.delete(own, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)
