"""Tables in the folder that the cluster's machines share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="regmesh-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes df in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/regmesh-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote and that nothing lazy still reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
