"""Tables written to the folder that driver and executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 60


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one;
    on a cluster that is an error, as the executors could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="paperledger-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder, in a folder for each value of ``by``, and read it again. The
    files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches(spark: SparkSession, most: int) -> Iterator[None]:
    """While tables are written within, Arrow batches end after about ``most`` bytes, or where the session ends them
    before. The JVM and its worker each hold a batch, and the JVM a vector that doubles as it grows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > most:
            spark.conf.set(name, f"{most}b")
        yield
    finally:
        spark.conf.set(name, before)


def drop(made: DataFrame) -> None:
    """Delete the files of a table made here that nothing reads any more."""
    for file in {f.rpartition("/")[0] for f in made.inputFiles()}:
        there = made.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        there.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def salt(*by: str) -> Column:
    """Deals rows of one join key over ``SALTS`` tasks, by columns that differ between them."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts(own: Column) -> Column:
    """An aggregate: which salts a key's rows have, as bits. A key of one row has one."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), own)).alias("salts")


def each_salt() -> Column:
    """One row for each of ``salts``, as ``salt``: what a hot key's rows join, each salt by itself."""
    one = F.lit(1).cast("long")
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.expr("salts").bitwiseAND(F.call_function("shiftleft", one, s)) != 0)).alias("salt")
