"""Cutting the lineage of iterated tables."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (whose executors are the driver) gets a temporary folder of
    its own; on a cluster there is no folder that could be guessed, so the call fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="coppice-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: lost executors cost no more than the step at hand.

    The table goes when the application ends, as results that are not yet made may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/coppice/{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast (tens of megabytes); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table of a few narrow columns) marked for broadcast if a count says that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
