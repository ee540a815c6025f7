"""File scans: delimited text with declared schemas, keys in file names, lists, listings, XML and JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import numbers, stem
from ..operators.relational import first_per_key


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, **options) -> DataFrame:
    """A CSV file with a header. Without a schema every column is a string, so ids keep their zeros."""
    reader = spark.read.options(header=True, inferSchema=False, **options)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_tree(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """All matching files below a folder, as one table."""
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)


def first_rows_by_file_key(spark: SparkSession, path: str, schema: str, pattern: str, key: str) -> DataFrame:
    """The first row of every file whose name matches, with the key that the pattern captures; other files are skipped."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.withColumn(key, F.regexp_extract(F.col("_file"), pattern, 1)).where(F.col(key) != "")
    return first_per_key(rows, ["_file"], [F.col("_at"), F.col("_n")]).drop("_n", "_at", "_file")


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Paths, sizes and times of files; their content is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(root)
    return files.select("path", "length", "modificationTime", stem(F.col("path")).alias("stem"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one path a line: blanks are skipped; ``name`` is the last part without extension."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''")
    return lines.withColumn("name", stem(F.col("path")))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as (key, value) rows; ``value`` is the values' type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_rows(text: Column, value: str) -> Column:
    """Generator of (key, value) from a column of JSON objects."""
    return F.explode(F.from_json(text, f"map<string,{value}>"))


def cameras(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Cameras of XML project documents, grouped or not, that have a transform: label, 16 numbers and the translation.

    Labels and transforms are read by the same path, so they stay aligned.
    """
    found = [f"/document/chunk/cameras/{p}camera[transform]" for p in ("", "group/")]
    pairs = F.concat(*[F.arrays_zip(F.expr(f"xpath({xml}, '{p}/@label')").alias("label"), F.expr(f"xpath({xml}, '{p}/transform/text()')").alias("text")) for p in found])
    keep = [c for c in docs.columns if c != xml]
    rows = docs.select(*keep, F.explode(pairs).alias("_c")).select(*keep, F.col("_c.label").alias("label"), numbers(F.col("_c.text")).alias("transform"))
    at = lambda i: F.element_at("transform", i)
    return rows.where(F.size("transform") == 16).withColumns({"x": at(4), "y": at(8), "z": at(12)})


def chunk_transform(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Rotation, translation and scale of each document's only component; fails where it is not georeferenced."""
    base = "/document/chunk/components/component/transform"
    text = lambda part: F.expr(f"xpath_string({xml}, '{base}/{part}')")
    n = F.size(F.expr(f"xpath({xml}, '/document/chunk/components/component')"))
    checked = F.when(n != 1, F.raise_error(F.lit("exactly one component is needed"))).when(text("rotation") == "", F.raise_error(F.lit("not georeferenced"))).otherwise(text("rotation"))
    keep = [c for c in docs.columns if c != xml]
    return docs.select(*keep, numbers(checked).alias("rotation"), numbers(text("translation")).alias("translation"), text("scale").cast("double").alias("scale"))


def kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML files: name, and the coordinates of their outer ring or point as (x, y) structs."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>, Point struct<coordinates: string>").load(path)
    text = F.coalesce("Polygon.outerBoundaryIs.LinearRing.coordinates", "Point.coordinates")
    part = lambda t, i: F.split(t, ",")[i].cast("double")
    ring = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: F.struct(part(t, 0).alias("x"), part(t, 1).alias("y")))
    return rows.select("name", ring.alias("ring"))


def numbered_names(names: DataFrame, column: str) -> DataFrame:
    """Names of a listing that begin with a digit, without trailing slashes."""
    return names.where(F.col(column).rlike(r"^\d")).withColumn(column, F.regexp_replace(column, "/+$", ""))
