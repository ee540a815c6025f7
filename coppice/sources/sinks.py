"""Sinks: partitioned manifests, conditional writes, derived documents, failure lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import moved_path
from ..operators.relational import running


def big_enough(df: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Rows of groups with at least ``least`` rows: what a conditional sink writes."""
    sizes = df.groupBy(key).count().where(F.col("count") >= least).select(key)
    return df.join(sizes, key, "left_semi")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per combination of keys, each written by few tasks; only folders that have rows are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(df: DataFrame, path: str, old: str, new: str, by: list[str]) -> DataFrame:
    """(source, target) of files to link into folders of ``by``; the source is moved to its new root, NULL if not under the old one."""
    source = moved_path(F.col(path), old, new)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return df.select(*by, source.alias("source"), F.concat_ws("/", *by, name).alias("target"))


def missing(manifest_: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose source is not in a listing."""
    return manifest_.join(listing.select(F.col("path").alias("source")), "source", "left_anti")


def paired_files(left: DataFrame, right: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files of two listings that differ in their extension alone (folder and stem are equal), and how many of the left ones have no partner."""
    key = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    a = left.select(key.alias("key"), F.col(path).alias("left_path"))
    joined = a.join(right.select(key.alias("key"), F.col(path).alias("right_path")), "key", "left")
    return joined.where("right_path is not null"), joined.where("right_path is null").agg(F.count("*").alias("n_missing"))


def override_document(offset: Column, name: Column, parts: dict[str, Column]) -> Column:
    """A derived configuration as JSON."""
    return F.to_json(F.struct(F.struct(name.alias("name"), offset.alias("altitude_offset"), *[c.alias(k) for k, c in parts.items()]).alias("project")))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def numbered(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Ids from 1 within each group; rows are dealt by ranges, so a group may lie in many tasks."""
    return running(df.drop("id"), [key], order).withColumnRenamed("_rank", "id")
