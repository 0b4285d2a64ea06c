"""Written intermediate tables, and scans that start in too few tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark delete the shuffle files of an action when it ends; a table that is written has no use for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see. Only a session on one machine may do without and gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-readloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Folders below the shared one in which the tables of the works under way lie.
_WORKS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark).rstrip("/"), "readloom", *_WORKS, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]:
    """All that is written inside lies in one folder, which is deleted at the end, but for tables that the given function is called with."""
    _WORKS.append(f"work-{uuid.uuid4().hex}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    top = hadoop.Path("/".join([shared_dir(spark).rstrip("/"), "readloom", *_WORKS]))
    fs = top.getFileSystem(conf)

    def keep(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        kept, out = hadoop.Path(top.getParent(), f"kept-{uuid.uuid4().hex}"), {}
        for name, df in tables.items():
            made, files = hadoop.Path(kept, name), df.inputFiles()
            fs.mkdirs(kept)
            if not files or not fs.rename(hadoop.Path(files[0].rsplit("/", 1)[0]), made):
                raise OSError(f"the table {name} could not be kept")
            out[name] = spark.read.schema(df.schema).parquet(made.toString())
        return out

    try:
        yield keep
    finally:
        _WORKS.pop()
        fs.delete(top, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` wrote and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by key if the scan has fewer tasks with rows than the session has cores.

    A small file, or a large one with few row groups, otherwise holds all that follows in one task. The count reads
    no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.groupBy(F.spark_partition_id()).count().count() < cores else df
