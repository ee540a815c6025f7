"""Resumable ingestion: a file stream whose batches write only what is not there yet."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_per_key


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], change: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Writes new rows of ``source`` (a folder of parquet) once to ``target``; returns the query, which ends when all is read.

    A key that ``target`` already has is skipped, so a batch that is run again after a failure adds nothing.
    Of several rows of a batch with one key the least is written, so that a rerun writes the same.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = change(df)
        rows = first_per_key(rows, keys, [F.col(c) for c in rows.columns if c not in keys] or [F.lit(0)])
        try:
            done = spark.read.parquet(target).select(*keys)
            rows = rows.join(done, keys, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
