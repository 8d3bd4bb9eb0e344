"""Working tables between steps of a batch, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session makes a temporary folder and a cluster is refused."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="paperledger-work-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: plans stay small, and a lost executor costs one step at most."""
    spark = df.sparkSession
    where = f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(file)
    return spark.read.schema(df.schema).parquet(where)
