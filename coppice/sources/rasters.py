"""Raster and image scans: GeoTIFF files as cells (path, band, row, col, x, y, value), images as Spark's own image source reads them."""

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the TIFF format: sizes and codes of field types, tags, sample formats
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
KIND = {1: "u", 2: "i", 3: "f"}
Window = tuple[int, int, int, int]
ANYWHERE: Window = (0, 0, 1 << 40, 1 << 40)
CELLS = "path string, band int, row long, col long, x double, y double, value double"


class Tiff:
    """The first image of a TIFF or BigTIFF file: strips or tiles, chunky or planar, with a horizontal predictor or none.

    Samples are uncompressed, deflated or LZW. ``data`` is the file's bytes, or a file of which only what is asked for is read.
    """

    def __init__(self, data: bytes | BinaryIO):
        self.data = data
        head = self.bytes_at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack_from(self.order + "H", head, 2)[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        offset, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
        (at,) = struct.unpack_from(self.order + offset, head, 8 if big else 4)
        first = struct.calcsize(count)
        (n,) = struct.unpack(self.order + count, self.bytes_at(at, first))
        directory = self.bytes_at(at + first, entry * n)
        self.tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(self.order + "HH" + offset, directory, entry * k)
            if kind not in FIELDS:
                continue
            form = self.order + FIELDS[kind] * many
            size = struct.calcsize(form)
            there = entry * (k + 1) - inline
            if size > inline:
                raw = self.bytes_at(struct.unpack_from(self.order + offset, directory, there)[0], size)
            else:
                raw = directory[there : there + size]
            values = struct.unpack(form, raw)
            self.tags[tag] = (b"".join(values),) if kind == 2 else values
        self.width, self.height, self.bands = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1)
        bits = self.one(BITS, 1)
        if bits not in (8, 16, 32, 64) or self.one(COMPRESSION, 1) not in (1, 5, 8, 32946):
            raise ValueError("only whole bytes a sample, uncompressed, deflated or LZW, are read")
        self.dtype = np.dtype(f"{self.order}{KIND[self.one(FORMAT, 1)]}{bits // 8}")
        tiled = TILE_AT in self.tags
        self.high, self.wide = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if tiled else (min(self.one(STRIP_ROWS, self.height), self.height), self.width)
        self.tiled, self.depth = tiled, 1 if self.one(PLANAR, 1) == 2 else self.bands
        self.across, self.down = -(-self.width // self.wide), -(-self.height // self.high)
        self.places, self.sizes = (self.tags[TILE_AT], self.tags[TILE_SIZE]) if tiled else (self.tags[STRIP_AT], self.tags[STRIP_SIZE])
        if self.across * self.down * (self.bands // self.depth) != len(self.places):
            raise ValueError("blocks are missing")

    def bytes_at(self, at: int, n: int) -> bytes:
        if isinstance(self.data, bytes):
            return self.data[at : at + n]
        self.data.seek(at)
        return self.data.read(n)

    def one(self, tag: int, default: int | None = None) -> int:
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def nodata(self) -> float | None:
        return float(self.tags[NODATA][0].rstrip(b"\0 ").decode()) if NODATA in self.tags else None

    def corner(self) -> tuple[float, float, float, float] | None:
        """x and y of the upper left corner and a cell's width and height, if the file is georeferenced."""
        if PIXEL_SCALE not in self.tags or TIE_POINT not in self.tags:
            return None
        (dx, dy), (i, j, _, x, y) = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINT][:5]
        return x - i * dx, y + j * dy, dx, dy

    def place(self, k: int) -> tuple[int, int, int]:
        """First band, row and column of a strip or tile."""
        plane, rest = divmod(k, self.across * self.down)
        return plane, rest // self.across * self.high, rest % self.across * self.wide

    def block(self, k: int) -> np.ndarray:
        """The samples by row, column and band of a strip or tile, cut to the image."""
        _, row, col = self.place(k)
        raw = self.bytes_at(self.places[k], self.sizes[k])
        if self.one(COMPRESSION, 1) == 5:
            raw = unpacked(raw)
        elif self.one(COMPRESSION, 1) != 1:
            raw = zlib.decompress(raw)
        rows = self.high if self.tiled else min(self.high, self.height - row)
        block = np.frombuffer(raw, self.dtype, rows * self.wide * self.depth).reshape(rows, self.wide, self.depth)
        if self.one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=self.dtype.newbyteorder("="))
        elif self.one(PREDICTOR, 1) != 1:
            raise ValueError("floating-point predictors are not read")
        return block[: self.height - row, : self.width - col]

    def cells(self, name: str, k: int, masked: bool, window: Window = ANYWHERE) -> pa.RecordBatch:
        """The cells of a strip or tile within a window as rows of CELLS."""
        corner, nodata = self.corner(), self.nodata
        first, row, col = self.place(k)
        low = [max(0, window[0] - row), max(0, window[1] - col)]
        block = self.block(k)[low[0] : max(0, window[2] - row), low[1] : max(0, window[3] - col)]
        rows, cols, bands = (a.ravel() for a in np.indices(block.shape))
        rows, cols, value = rows + row + low[0], cols + col + low[1], block.ravel().astype(np.float64)
        none = np.isnan(value) if masked else np.zeros(len(value), bool)
        if masked and nodata is not None:
            none |= value == nodata
        x0, y0, dx, dy = corner or (0.0, 0.0, 0.0, 0.0)
        where = np.full(len(value), corner is None)
        path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(value), np.int32)), pa.array([name])).cast(pa.string())
        xy = [pa.array(x0 + (cols + 0.5) * dx, mask=where), pa.array(y0 - (rows + 0.5) * dy, mask=where)]
        columns = [path, pa.array((bands + first + 1).astype(np.int32)), pa.array(rows), pa.array(cols), *xy, pa.array(value, mask=none)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELLS.split(", ")])


def unpacked(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits from the highest bit on, 256 starts the table anew, 257 ends."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, last, width = [], list(start), b"", 9
    held = bits = 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if not last:
            now = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
        out.append(now)
        last = now
        # the width grows one code early
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def geotiff(spark: SparkSession, path: str | list[str], masked: bool = True) -> DataFrame:
    """The cells of GeoTIFF files; x and y are cell centres, NULL without georeferencing. With ``masked`` nodata and NaN are NULL.

    For stores that only Spark reads: a file is a row, decoded block by block in one task. ``ranged`` divides a file among many.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                tiff = Tiff(content.as_buffer().to_pybytes())
                for k in range(len(tiff.places)):
                    yield tiff.cells(name, k, masked)

    return files.mapInArrow(run, CELLS)


@dataclass
class Blocks(InputPartition):
    """Strips or tiles of a file that one task reads."""

    path: str
    numbers: list[int]


class TiffReader(DataSourceReader):
    """Plans from the files' directories alone; a task reads the bytes of its own blocks and holds one decoded at a time."""

    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.masked, self.most = options["masked"] == "true", int(options["bytes"])
        self.window = tuple(json.loads(options["window"]))
        self.bands = set(json.loads(options["bands"]))

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                tiff = Tiff(f)
            now, size = [], 0
            each = tiff.high * tiff.wide * tiff.depth * tiff.dtype.itemsize
            for k in range(len(tiff.places)):
                plane, row, col = tiff.place(k)
                off = row >= self.window[2] or row + tiff.high <= self.window[0] or col >= self.window[3] or col + tiff.wide <= self.window[1]
                if off or (self.bands and tiff.depth == 1 and plane + 1 not in self.bands):
                    continue
                if now and size + each > self.most:
                    out.append(Blocks(path, now))
                    now, size = [], 0
                now.append(k)
                size += each
            if now:
                out.append(Blocks(path, now))
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        with open(partition.path, "rb") as f:
            tiff = Tiff(f)
            for k in partition.numbers:
                cells = tiff.cells(partition.path, k, self.masked, self.window)
                yield cells.filter(pa.compute.is_in(cells.column("band"), pa.array(sorted(self.bands), pa.int32()))) if self.bands else cells


class TiffRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_ranges"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def ranged(spark: SparkSession, paths: list[str], masked: bool = True, window: Window = ANYWHERE, bands: Sequence[int] = (), bytes_: int = 64 << 20) -> DataFrame:
    """The same cells, of files that all executors can open: strips and tiles are dealt to tasks by about ``bytes_`` of samples.

    ``window`` is (row, col, end row, end col), ends not included; blocks outside of it, and planes of other ``bands`` (none: all),
    are not read at all. No files give no cells.
    """
    spark.dataSource.register(TiffRanges)
    options = {"paths": json.dumps(list(paths)), "masked": str(masked).lower(), "window": json.dumps(list(window)), "bands": json.dumps(list(bands)), "bytes": str(bytes_)}
    return spark.read.format("tiff_ranges").options(**options).load()


def sample_types(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, type, width, height, bands) of TIFF files, such as uint32 or float64; no cell is decoded."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Tiff(x.as_buffer().to_pybytes()) for x in batch.column("content")]
            columns = [pa.array([t.dtype.newbyteorder("=").name for t in made], pa.string()), *(pa.array([getattr(t, n) for t in made], pa.int32()) for n in ("width", "height", "bands"))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], names=["path", "type", "width", "height", "bands"])

    return files.mapInArrow(run, "path string, type string, width int, height int, bands int")


def of_type(typed: DataFrame, wanted: str = "uint32") -> tuple[DataFrame, DataFrame]:
    """The files of a sample type, and the number of those that are skipped for having another, by type."""
    return typed.where(F.col("type") == wanted), typed.where(F.col("type") != wanted).groupBy("type").agg(F.count("*").alias("n_skipped"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (JPEG, PNG, BMP, GIF): path, width, height, channels and the bytes by row, column and channel (blue first). Files that are no images are skipped."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")
