"""GeoPackage layers as a Spark data source (one task per so many rows, Arrow batches, geometry as WKB) and as a sink.

A GeoPackage is an SQLite file, so its path must be readable by the executors. A path may be a folder: then the layer is that of all
its files, which ``write_gpkg_parts`` writes in parallel; only a single file is written by one process.
"""

import os
import sqlite3
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Envelope sizes by the code in the header's flags.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
#: What SQLite holds (a column's values may differ in type) as what the column declares.
PLAIN = {"int64": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode(), "bool": bool}
KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
#: Rows of an Arrow batch, and of an insertion.
BATCH = 4096


@contextmanager
def connected(path: str, mode: str = "ro"):
    """An open GeoPackage, closed in the end; what was written is kept only if nothing failed."""
    db = sqlite3.connect(f"file:{path}?mode={mode}", uri=True)
    try:
        with db:
            yield db
    finally:
        db.close()


def wkb(blob: bytes | None) -> bytes | None:
    """The geometry after the GeoPackage header; NULL for an empty one."""
    if blob is None or blob[:2] != b"GP":
        return None
    flags = blob[3]
    return None if flags & 0b10000 else blob[8 + ENVELOPE[(flags >> 1) & 7] :]


def header(wkb_bytes: bytes, srid: int) -> bytes:
    return b"GP" + bytes([0, 1]) + struct.pack("<i", srid) + wkb_bytes


def files_of(path: str) -> list[str]:
    """The GeoPackages of a folder in order of their names, or the one file."""
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, name) for name in sorted(os.listdir(path)) if name.endswith(".gpkg") and not name.startswith(".")]


class Rows(InputPartition):
    def __init__(self, path: str, low: int, high: int | None):
        self.path, self.low, self.high = path, low, high


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType, geometry: str | None, rows: int):
        self.path, self.layer, self.columns, self.geometry, self.rows = path, layer, [f.name for f in schema.fields], geometry, rows
        self.kinds = [KINDS[f.dataType.typeName()] for f in schema.fields]

    def partitions(self):
        """Ranges of row ids that hold ``rows`` rows each, however sparse the ids are."""
        every = f"select rowid as r, row_number() over (order by rowid) as n from {quoted(self.layer)}"
        out = []
        for path in files_of(self.path):
            with connected(path) as db:
                starts = [r for (r,) in db.execute(f"select r from ({every}) where (n - 1) % ? = 0 order by r", (self.rows,))]
            out += [Rows(path, a, b) for a, b in zip(starts, [*starts, None][1:], strict=True)]
        return out or [Rows(files_of(self.path)[0], 0, 0)]

    def read(self, partition):
        names = ", ".join(map(quoted, self.columns))
        convert = [wkb if n == self.geometry else PLAIN[str(k)] for n, k in zip(self.columns, self.kinds, strict=True)]
        end, bounds = ("", (partition.low,)) if partition.high is None else (" and rowid < ?", (partition.low, partition.high))
        with connected(partition.path) as db:
            rows = db.execute(f"select {names} from {quoted(self.layer)} where rowid >= ?{end} order by rowid", bounds)
            while some := rows.fetchmany(BATCH):
                columns = [[None if v is None else c(v) for v in values] for c, values in zip(convert, zip(*some, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.kinds, strict=True)], names=self.columns)


class GeoPackage(DataSource):
    """Options: path, layer (the first one by default), rows (per task)."""

    @classmethod
    def name(cls):
        return "gpkg"

    def _layer(self):
        with connected(files_of(self.options["path"])[0]) as db:
            layer = self.options.get("layer") or db.execute("select table_name from gpkg_contents order by table_name").fetchone()[0]
            geometry = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
            return layer, geometry and geometry[0], db.execute(f"pragma table_info({quoted(layer)})").fetchall()

    def schema(self):
        _, geometry, columns = self._layer()

        def kind(name: str, declared: str):
            declared = declared.upper()
            if name == geometry or "BLOB" in declared:
                return BinaryType()
            if "BOOL" in declared:
                return BooleanType()
            return LongType() if "INT" in declared else DoubleType() if any(x in declared for x in ("REAL", "DOUBLE", "FLOAT")) else StringType()

        return StructType([StructField(name, kind(name, declared)) for _, name, declared, *_ in columns])

    def reader(self, schema):
        layer, geometry, _ = self._layer()
        return GeoPackageReader(self.options["path"], layer, schema, geometry, int(self.options.get("rows", 100_000)))


def read_gpkg(spark, path: str, layer: str | None = None):
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("gpkg").option("path", path)
    return (reader.option("layer", layer) if layer else reader).load()


def _insertable(df: DataFrame, geometry: str | None, kind: str) -> tuple[DataFrame, list[str]]:
    """The columns as SQLite takes them (what it has no type for as text), and how the layer declares them."""
    declared, columns = [], []
    for f in df.schema.fields:
        name = f.dataType.typeName()
        if f.name == geometry:
            declared.append(f"{quoted(f.name)} {kind}")
        else:
            types = {"double": "DOUBLE", "float": "DOUBLE", "binary": "BLOB", "boolean": "BOOLEAN"}
            declared.append(f"{quoted(f.name)} " + types.get(name, "INTEGER" if name in ("long", "integer", "short", "byte") else "TEXT"))
        plain = name in ("double", "float", "binary", "boolean", "long", "integer", "short", "byte", "string")
        columns.append(df[f"`{f.name}`"] if plain else df[f"`{f.name}`"].cast("string").alias(f.name))
    return df.select(*columns), declared


def _fill(path: str, layer: str, declared: list[str], geometry: str | None, at: int | None, srid: int, kind: str, rows: Iterable) -> None:
    """A layer of a new or existing file, in place of one of that name."""
    with connected(path, "rwc") as db:
        # fixed values: the tables that the format asks for
        db.execute("pragma application_id = 1196444487")
        db.execute("create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)")
        db.execute("create table if not exists gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text, min_x double, min_y double, max_x double, max_y double, srs_id integer)")
        db.execute("create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null)")
        db.execute("insert or ignore into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srid}", srid, srid))
        db.execute(f"drop table if exists {quoted(layer)}")
        db.execute(f"create table {quoted(layer)} ({', '.join(declared)})")
        db.execute("insert or replace into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, ?, ?, ?)", (layer, "features" if geometry else "attributes", layer, srid))
        if geometry:
            db.execute("insert or replace into gpkg_geometry_columns values (?, ?, ?, ?, 0, 0)", (layer, geometry, kind, srid))
        insert = f"insert into {quoted(layer)} values ({', '.join('?' * len(declared))})"
        stored = lambda i, v: None if v is None else header(bytes(v), srid) if i == at else bytes(v) if isinstance(v, bytearray) else v
        db.executemany(insert, ([stored(i, v) for i, v in enumerate(row)] for row in rows))


def write_gpkg_parts(df: DataFrame, folder: str, layer: str, geometry: str | None = None, srid: int = 4326, kind: str = "GEOMETRY") -> DataFrame:
    """A table as a layer in a folder of GeoPackages, a file a partition, written by the executors; returns (path, rows) of the files.

    ``folder`` is one that driver and executors share. A task writes under a hidden name of its own and renames the file in the end, so a
    task that runs again, or twice at once, leaves one whole file. A table without rows leaves one file with an empty layer.
    """
    rows, declared = _insertable(df, geometry, kind)
    at = next((i for i, n in enumerate(df.columns) if n == geometry), None)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        made, n = os.path.join(folder, f".{uuid.uuid4().hex}.gpkg"), 0

        def all_() -> Iterator[tuple]:
            nonlocal n
            for batch in batches:
                n += len(batch)
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        _fill(made, layer, declared, geometry, at, srid, kind, all_())
        path = os.path.join(folder, f"part-{number:05d}.gpkg")
        if n or number == 0:
            os.replace(made, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "rows"])
        else:
            os.remove(made)

    spark = df.sparkSession
    found = rows.mapInArrow(run, "path string, rows long").collect()  # one row a file
    if not found:
        path = os.path.join(folder, "part-00000.gpkg")
        _fill(path, layer, declared, geometry, at, srid, kind, [])
        found = [(path, 0)]
    return spark.createDataFrame(found, "path string, rows long")


def write_gpkg(df: DataFrame, path: str, layer: str, geometry: str | None = None, srid: int = 4326, kind: str = "GEOMETRY") -> None:
    """A table as a layer of a new or existing single GeoPackage; ``geometry`` is a column of WKB. A layer of that name is replaced.

    One file has one writer: the driver, from a stream of partitions, one in memory at a time. That is for small exports to other
    programs; ``write_gpkg_parts`` writes tables of any size. Booleans become 0 and 1, and what SQLite has no type for becomes text.
    """
    rows, declared = _insertable(df, geometry, kind)
    at = next((i for i, n in enumerate(df.columns) if n == geometry), None)
    _fill(path, layer, declared, geometry, at, srid, kind, rows.toLocalIterator())
