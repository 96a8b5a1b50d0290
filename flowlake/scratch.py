"""Tables in the folder that driver and executors share, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="flowlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Scratch tables of this process that haven't been dropped.
SCRATCH: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table by Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in SCRATCH:
        SCRATCH.remove(path)


def drop_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch tables made since there were `since` of them, but those in keep.  Results that still read them must be written before."""
    for path in SCRATCH[since:]:
        if path not in keep:
            drop_path(spark, path)


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same rows from a table in the shared folder, and its path: lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    return written_at(df, label)[0]
