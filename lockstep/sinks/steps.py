"""Steps of iterative jobs as tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where Spark runs in one machine without it, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = sc._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="steps-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def step(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: short lineage, and nothing is lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a step that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps: it does so when the driver drops their plans."""
    gc.collect()
    spark._jvm.System.gc()
