import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.sources import files, gpkg, rasters, sinks
from coppice.streaming.incremental import ingest


def test_csv_keeps_zeros_and_keys_from_names(spark, tmp_path):
    for name, body in (("000012_altitude_summary.csv", "a,b\n1,x\n2,y\n"), ("000345_altitude_summary.csv", "a,b\n3,z\n"), ("other.csv", "a,b\n9,q\n")):
        (tmp_path / name).write_text(body)
    got = files.first_rows_by_file_key(spark, f"{tmp_path}/*.csv", "a int, b string", r"(\d{6})_altitude_summary\.csv", "mission_id")
    assert sorted((r["mission_id"], r["a"]) for r in got.collect()) == [("000012", 1), ("000345", 3)]
    (tmp_path / "ids.csv").write_text("plot_id,n\n0069,1\n")
    assert files.csv(spark, f"{tmp_path}/ids.csv").first()["plot_id"] == "0069"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/u_metadata.csv").write_text("a,b\n5,w\n")
    assert files.csv_tree(spark, str(tmp_path), "*_metadata.csv", "a int, b string").count() == 1
    assert {r["stem"] for r in files.listing(spark, str(tmp_path), "*.csv").collect()} == {"000012_altitude_summary", "000345_altitude_summary", "other", "ids"}


def test_lists_and_json(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/a/x.yml\n\n  /b/y.z.yml \n")
    assert sorted(r["name"] for r in files.path_list(spark, f"{tmp_path}/list.txt").collect()) == ["x", "y.z"]
    (tmp_path / "m.json").write_text('{"p": [[1.5, 2.0]],\n "q": []}')
    got = {r["key"]: r["value"] for r in files.json_map(spark, f"{tmp_path}/m.json", "array<array<double>>").collect()}
    assert got == {"p": [[1.5, 2.0]], "q": []}


def test_cameras(spark):
    t = "<transform>1 0 0 5 0 1 0 6 0 0 1 7 0 0 0 1</transform>"
    head = "<components><component><transform><rotation>1 0 0 0 1 0 0 0 1</rotation><translation>1 2 3</translation><scale>2</scale></transform></component></components>"
    xml = f'<document><chunk>{head}<cameras><camera label="a"/><camera label="b">{t}</camera><group><camera label="c">{t}</camera></group></cameras></chunk></document>'
    df = spark.createDataFrame([(xml,)], "xml string")
    assert sorted((r["label"], r["x"], r["y"], r["z"]) for r in files.cameras(df).collect()) == [("b", 5.0, 6.0, 7.0), ("c", 5.0, 6.0, 7.0)]
    assert files.chunk_transform(df).first()["scale"] == 2.0
    bare = spark.createDataFrame([("<document><chunk><components><component/></components></chunk></document>",)], "xml string")
    with pytest.raises(Exception, match="georeferenced"):
        files.chunk_transform(bare).collect()


def test_geopackage(spark, tmp_path):
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    path = str(tmp_path / "t.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("insert into gpkg_contents values ('trees')")
        db.execute("insert into gpkg_geometry_columns values ('trees', 'geom')")
        db.execute("create table trees (fid integer primary key, geom blob, species text, height real)")
        db.executemany("insert into trees values (?, ?, ?, ?)", [(i, gpkg.header(point, 32610), "ABCO", i / 2) for i in range(1, 6)])
    got = gpkg.read_gpkg(spark, path).orderBy("fid").collect()
    assert len(got) == 5
    assert bytes(got[0]["geom"]) == point
    assert got[4]["height"] == 2.5


def test_geopackage_round_trip(spark, tmp_path):
    path = str(tmp_path / "out.gpkg")
    point = lambda x: struct.pack("<BIdd", 1, 1, float(x), 4.0)
    rows = [(10**i if i < 12 else -i, bytearray(point(i)), f"s{i}" if i % 3 else None, i / 4, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "n long, geom binary, species string, height double, live boolean").repartition(3)
    gpkg.write_gpkg(df, path, "trees", "geom", 32610)
    gpkg.write_gpkg(df.select("n", "species").limit(2), path, "names")
    gpkg.write_gpkg(df, path, "trees", "geom", 32610)  # replaces the layer
    spark.dataSource.register(gpkg.GeoPackage)
    got = spark.read.format("gpkg").option("path", path).option("layer", "trees").option("rows", 6).load()
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r["n"], bytes(r["geom"]), r["species"] or "", r["height"], r["live"]) for r in got.collect()) == sorted((n, bytes(g), s or "", h, v) for n, g, s, h, v in rows)
    assert gpkg.read_gpkg(spark, path, "names").count() == 2
    gpkg.write_gpkg(df.limit(0), path, "none", "geom")
    assert gpkg.read_gpkg(spark, path, "none").count() == 0
    folder = str(tmp_path / "parts")
    for _ in range(2):  # written again, the same files
        files_ = gpkg.write_gpkg_parts(df.repartition(5, "n"), folder, "trees", "geom", 32610).collect()
    assert sum(r["rows"] for r in files_) == df.count()
    assert len(files_) > 1
    back = gpkg.read_gpkg(spark, folder, "trees")
    assert sorted(map(str, back.select("n", "species", "geom").collect())) == sorted(map(str, gpkg.read_gpkg(spark, path, "trees").select("n", "species", "geom").collect()))
    assert [r["rows"] for r in gpkg.write_gpkg_parts(df.limit(0), str(tmp_path / "empty"), "trees", "geom").collect()] == [0]
    assert gpkg.read_gpkg(spark, str(tmp_path / "empty"), "trees").count() == 0


def packed_codes(raw: bytes) -> bytes:
    """LZW with the codes of TIFF."""
    table, bits, now, width = {bytes([i]): i for i in range(256)}, [], b"", 9
    n = 258

    def put(code):
        bits.append(f"{code:0{width}b}")

    put(256)
    for byte in raw:
        if now + bytes([byte]) in table:
            now += bytes([byte])
            continue
        put(table[now])
        table[now + bytes([byte])] = n
        n, now = n + 1, bytes([byte])
        width = max(width, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)
        if n == 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    if now:
        put(table[now])
        n += 1
        width = max(width, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def tiff(samples, order="<", tile=None, deflate=False, predictor=1, geo=True, nodata=None, big=False, lzw=False, planar=False) -> bytes:
    """A small writer of TIFF files, for the tests."""
    import zlib

    high, wide, bands = samples.shape
    size = samples.dtype.itemsize
    code = {"u": 1, "i": 2, "f": 3}[samples.dtype.kind]
    pieces = []
    if planar:
        pieces = [samples[r : r + 3, :, b : b + 1] for b in range(bands) for r in range(0, high, 3)]
    elif tile:
        for r in range(0, high, tile):
            for c in range(0, wide, tile):
                full = np.zeros((tile, tile, bands), samples.dtype)
                part = samples[r : r + tile, c : c + tile]
                full[: part.shape[0], : part.shape[1]] = part
                pieces.append(full)
    else:
        pieces = [samples[r : r + 3] for r in range(0, high, 3)]
    coded = []
    for x in pieces:
        if predictor == 2:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
        raw = x.astype(x.dtype.newbyteorder(order)).tobytes()
        coded.append(packed_codes(raw) if lzw else zlib.compress(raw) if deflate else raw)
    body, places = b"", []
    for x in coded:
        places.append((16 if big else 8) + len(body))
        body += x + b"\0" * (len(x) % 2)
    at, size_ = ((324, 325), [(322, 3, [tile]), (323, 3, [tile])]) if tile else ((273, 279), [(278, 3, [3])])
    tags = [(256, 4, [wide]), (257, 4, [high]), (258, 3, [8 * size] * bands), (259, 3, [5 if lzw else 8 if deflate else 1]), (284, 3, [2 if planar else 1]), (277, 3, [bands]), (317, 3, [predictor]), (339, 3, [code] * bands), (at[0], 4, places), (at[1], 4, [len(x) for x in coded]), *size_]
    if geo:
        tags += [(33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 500.0, 0.0])]
    if nodata is not None:
        tags.append((42113, 2, f"{nodata}\0".encode()))
    form = {2: "s", 3: "H", 4: "I", 12: "d"}
    tags.sort(key=lambda t: t[0])
    count, long, least = ("Q", "Q", 8) if big else ("H", "I", 4)
    directory, extra = struct.pack(order + count, len(tags)), b""
    start = (16 if big else 8) + len(body)
    after = start + len(directory) + (4 + 2 * least) * len(tags) + least
    for tag, kind, values in tags:
        packed = values if kind == 2 else struct.pack(order + form[kind] * len(values), *values)
        if len(packed) <= least:
            cell = packed.ljust(least, b"\0")
        else:
            cell = struct.pack(order + long, after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        directory += struct.pack(order + "HH" + long, tag, kind, len(values)) + cell
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    return head + body + directory + struct.pack(order + long, 0) + extra


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 60000, (10, 7, 1)).astype(np.uint16)
    two = rng.normal(size=(9, 20, 2)).astype(np.float32)
    two[0, 0, 0], two[1, 1, 1] = -9999, np.nan
    three = rng.integers(0, 2**31, (4, 5, 1)).astype(np.uint32)
    for name, data in (("a.tif", tiff(one, deflate=True, predictor=2)), ("b.tif", tiff(two, order=">", tile=16, nodata=-9999)), ("c.tif", tiff(three, geo=False))):
        (tmp_path / name).write_bytes(data)
    cells = rasters.geotiff(spark, f"{tmp_path}/*.tif").withColumn("name", F.regexp_extract("path", r"(\w)\.tif$", 1)).collect()
    for name, want in (("a", one), ("b", two), ("c", three)):
        got = {(r["row"], r["col"], r["band"] - 1): r for r in cells if r["name"] == name}
        assert len(got) == want.size
        for at, r in got.items():
            v = float(want[at])
            assert r["value"] is None if np.isnan(v) or v == -9999 else r["value"] == v
            assert (r["x"], r["y"]) == ((None, None) if name == "c" else (100 + 2 * at[1] + 1, 500 - 2 * at[0] - 1))
    kept, skipped = rasters.of_type(rasters.sample_types(spark, f"{tmp_path}/*.tif"))
    assert [r["width"] for r in kept.collect()] == [5]
    assert {(r["type"], r["n_skipped"]) for r in skipped.collect()} == {("uint16", 1), ("float32", 1)}


def test_rasters_by_ranges(spark, tmp_path):
    """Many tasks a file, windows and bands that are not read, BigTIFF, LZW and planes."""
    rng = np.random.default_rng(4)
    one = (rng.integers(0, 40, (60, 50, 1)) ** 2).astype(np.uint16)
    two = rng.integers(0, 200, (40, 33, 2)).astype(np.uint8)
    files = {"a": (one, tiff(one, tile=16, lzw=True, predictor=2)), "b": (two, tiff(two, big=True, planar=True, order=">")), "c": (one, tiff(one, big=True, deflate=True, nodata=9))}
    for name, (_, data) in files.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
    paths = [str(tmp_path / f"{name}.tif") for name in files]
    cells = rasters.ranged(spark, paths, bytes_=1500)
    assert cells.rdd.getNumPartitions() > 12
    for name, (want, _) in files.items():
        got = {(r["row"], r["col"], r["band"] - 1): r["value"] for r in cells.where(F.col("path").endswith(f"{name}.tif")).collect()}
        assert got == {(i, j, b): None if name == "c" and v == 9 else float(v) for (i, j, b), v in np.ndenumerate(want)}
    part = rasters.ranged(spark, paths, window=(5, 7, 21, 11), bands=[2], bytes_=1500)
    assert part.rdd.getNumPartitions() < 12
    assert {(r["row"], r["col"], r["band"]): r["value"] for r in part.collect()} == {(i, j, 2): float(two[i, j, 1]) for i in range(5, 21) for j in range(7, 11)}
    assert rasters.ranged(spark, []).count() == 0
    whole = rasters.geotiff(spark, f"{tmp_path}/*.tif")
    assert sorted(whole.select("row", "col", "band", "value").collect(), key=str) == sorted(cells.select("row", "col", "band", "value").collect(), key=str)


def test_images(spark, tmp_path):
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x01\x02\x03\x04\x05\x06")) + chunk(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    (tmp_path / "q.png").write_bytes(b"no image")
    (row,) = rasters.images(spark, str(tmp_path)).collect()
    assert (row["width"], row["height"], row["channels"], bytes(row["data"])) == (2, 1, 3, b"\x03\x02\x01\x06\x05\x04")


def test_paired_files(spark):
    left = spark.createDataFrame([("/m/a.tif",), ("/m/b.x.tif",), ("/m/c.tif",)], "path string")
    right = spark.createDataFrame([("/m/a.JPG",), ("/m/b.x.jpg",), ("/n/c.jpg",)], "path string")
    pairs, missing = sinks.paired_files(left, right)
    assert sorted((r["left_path"], r["right_path"]) for r in pairs.collect()) == [("/m/a.tif", "/m/a.JPG"), ("/m/b.x.tif", "/m/b.x.jpg")]
    assert missing.first()["n_missing"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "/old/1.png"), ("val", "b", "/else/2.png")], "split string, class string, path string")
    listed = sinks.manifest(df, "path", "/old/", "/new/", ["split", "class"])
    assert {(r["source"], r["target"]) for r in listed.collect()} == {("/new/1.png", "train/a/1.png"), (None, "val/b/2.png")}
    there = spark.createDataFrame([("/new/1.png",)], "path string")
    assert sinks.missing(listed.where("source is not null"), there).count() == 0
    sinks.write_partitioned(df, str(tmp_path / "out"), ["split", "class"])
    assert (tmp_path / "out/split=train/class=a").is_dir()
    sinks.write_csv(df, str(tmp_path / "csv"), single=True)
    assert files.csv(spark, str(tmp_path / "csv")).count() == 2
    sinks.write_lines(df, "path", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    many = spark.range(15).select((F.col("id") < 10).alias("k"))
    assert sinks.big_enough(many, "k", 10).count() == 10


def test_ingest_writes_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.parquet(src)
    ingest(spark, src, schema, out, mark, ["k"]).awaitTermination()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, mark, ["k"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_kml_and_names(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>N</name><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4,0\n 1,2,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    row = files.kml(spark, f"{tmp_path}/a.kml").first()
    assert row["name"] == "N"
    assert [tuple(p) for p in row["ring"]] == [(1.0, 2.0), (3.0, 4.0), (1.0, 2.0)]
    names = spark.createDataFrame([("000123/",), ("notes/",)], "name string")
    assert [r["name"] for r in files.numbered_names(names, "name").collect()] == ["000123"]
