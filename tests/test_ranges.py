"""Split readers and the committing sink."""

import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.sources import binary, committed, ranges

FIELDS = [{"name": "height", "type": "f16", "offset": 0}, {"name": "cluster", "type": "u16", "offset": 2}, {"name": "classes", "type": "u8x3", "offset": 4}, {"name": "id", "type": "u32", "offset": 8}]


def test_layer_records_are_split_and_equal_to_a_whole_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 12 * 1000, np.uint8)
    data.reshape(-1, 12)[::7, 2:4] = 255
    (tmp_path / "layers.bin").write_bytes(data.tobytes() + b"tail")
    split = ranges.layer_records(spark, str(tmp_path / "layers.bin"), 12, 1000, FIELDS, split_bytes=1200)
    assert split.rdd.getNumPartitions() == 10
    tell = lambda df: [(r.idx, str(r.height), r.cluster, list(r.classes), r.id) for r in df.orderBy("idx").collect()]
    assert tell(split) == tell(binary.layer_records(spark, str(tmp_path), 12, 1000, FIELDS))
    some = ranges.layer_records(spark, str(tmp_path / "*.bin"), 12, 1000, FIELDS, ["cluster"])
    assert some.columns == ["path", "idx", "cluster"] and some.filter("cluster is null").count() >= 143
    with pytest.raises(Exception, match="fewer than 1002 records"):
        ranges.layer_records(spark, str(tmp_path / "layers.bin"), 12, 1002, FIELDS).count()


def test_only_asked_fields_are_decoded(tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(bytes(24))
    from pyspark.sql.types import StructType

    asked = []
    monkeypatch.setattr(ranges, "_column", lambda v, kind, none, f=ranges._column: asked.append(kind) or f(v, kind, none))
    reader = ranges.RecordReader({"path": str(tmp_path / "a.bin"), "record_bytes": 12, "count": 2, "fields": json.dumps(FIELDS)}, StructType.fromDDL("idx bigint, height float"))
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 2 and asked == ["float"]


def test_points_are_split(spark, tmp_path):
    v = np.zeros(500, np.dtype([(c, "<f4") for c in ("x", "y", "z", "opacity", "f_dc_0")] + [("k", "u1")]))
    v["x"], v["opacity"], v["k"] = np.arange(500), np.arange(500) / 4, np.arange(500) % 250
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 500\n" + "".join(f"property {'uchar' if c == 'k' else 'float'} {c}\n" for c in v.dtype.names) + "end_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + v.tobytes())
    got = ranges.ply_points(spark, str(tmp_path), ("x", "k"), split_bytes=2100)
    assert got.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in got.drop("path").orderBy("row_id").collect()] == [(i, float(i), float(i % 250)) for i in range(500)]
    (tmp_path / "b.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(Exception, match="little-endian"):
        ranges.ply_points(spark, str(tmp_path)).count()


@pytest.mark.parametrize("packed", [False, True])
def test_members_and_rows_of_archives(spark, tmp_path, packed):
    a, b, c = np.arange(60, dtype="<f4").reshape(20, 3), np.arange(8, dtype="<i8"), np.arange(24, dtype="<u2").reshape(2, 3, 4)
    (np.savez_compressed if packed else np.savez)(tmp_path / "x.npz", a=a, b=b, c=c)
    got = ranges.array_rows(spark, str(tmp_path / "x.npz"), ["a", "c"], 1, 15, split_bytes=60)
    rows = {(r.member, r.i): r.v for r in got.collect()}
    assert rows == {("a", i): a[i].tolist() for i in range(1, 15)} | {("c", 1): c[1].ravel().tolist()}
    assert got.rdd.getNumPartitions() == (2 if packed else 4)
    np.save(tmp_path / "y.npy", b)
    assert [r.v for r in ranges.array_rows(spark, str(tmp_path / "y.npy")).orderBy("i").collect()] == [[float(i)] for i in range(8)]
    np.save(tmp_path / "z.npy", np.asfortranarray(a))
    with pytest.raises(Exception, match="C order"):
        ranges.array_rows(spark, str(tmp_path / "z.npy")).count()


def test_other_members_are_not_read(tmp_path, monkeypatch):
    from pyspark.sql.types import StructType

    np.savez(tmp_path / "x.npz", big=np.zeros(1 << 18), small=np.arange(4.0))
    read = []
    plain = ranges.opened

    class Watched:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    monkeypatch.setattr(ranges, "opened", lambda p: Watched(plain(p)))
    reader = ranges.ArrayReader({"path": str(tmp_path / "x.npz"), "members": '["small"]'}, StructType.fromDDL("i bigint, v array<double>"))
    parts = reader.partitions()
    assert [p.member for p in parts] == ["small"]
    read.clear()
    assert sum(b.num_rows for b in reader.read(parts[0])) == 4 and sum(read) == 32


def tiff(grid, rows_a_strip=None, tile=None, packed=False, predicted=False, order="<", none=None, big=False):
    """A raster file of one band with a corner at (1000, 5000) and cells of 2 m."""
    blocks = []
    if tile:
        for r in range(0, grid.shape[0], tile):
            for c in range(0, grid.shape[1], tile):
                block = np.zeros((tile, tile), grid.dtype)
                part = grid[r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [grid[r : r + rows_a_strip] for r in range(0, grid.shape[0], rows_a_strip)]
    if predicted:
        blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(b.dtype) for b in blocks]
    raw = [b.astype(b.dtype.newbyteorder(order)).tobytes() for b in blocks]
    raw = [zlib.compress(x) for x in raw] if packed else raw
    start = 16 if big else 8
    at = [start + sum(map(len, raw[:i])) for i in range(len(raw))]
    kinds = {"u": 1, "i": 2, "f": 3}
    tags = [(256, "I", [grid.shape[1]]), (257, "I", [grid.shape[0]]), (258, "H", [grid.dtype.itemsize * 8]), (259, "H", [8 if packed else 1]), (277, "H", [1]), (317, "H", [2 if predicted else 1]), (339, "H", [kinds[grid.dtype.kind]])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", at), (325, "I", list(map(len, raw)))] if tile else [(273, "I", at), (278, "I", [rows_a_strip]), (279, "I", list(map(len, raw)))]
    tags += [(33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 5000.0, 0])] + ([(42113, "s", none)] if none else [])
    code, wide, pointer = {"H": 3, "I": 4, "d": 12, "s": 2}, (8 if big else 4), ("Q" if big else "I")
    where = start + sum(map(len, raw))
    size = (8 if big else 2) + len(tags) * (20 if big else 12) + wide
    listed, more = b"", b""
    for tag, kind, values in sorted(tags):
        data = values.encode() + b"\0" if kind == "s" else struct.pack(order + kind * len(values), *values)
        many = len(data) if kind == "s" else len(values)
        held = data.ljust(wide, b"\0") if len(data) <= wide else struct.pack(order + pointer, where + size + len(more))
        more += data if len(data) > wide else b""
        listed += struct.pack(order + ("HHQ" if big else "HHI"), tag, code[kind], many) + held
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, where) if big else struct.pack(order + "HI", 42, where))
    return head + b"".join(raw) + struct.pack(order + ("Q" if big else "H"), len(tags)) + listed + bytes(wide) + more


@pytest.mark.parametrize("how", [{"rows_a_strip": 3}, {"rows_a_strip": 4, "packed": True, "predicted": True, "order": ">"}, {"tile": 16, "packed": True}, {"tile": 16, "big": True}])
def test_windows_of_rasters(spark, tmp_path, how):
    rng = np.random.default_rng(5)
    kind = np.int16 if how.get("predicted") else np.float32
    grid = (rng.random((50, 37)) * 1000).astype(kind)
    grid[20, 10] = -999
    (tmp_path / "dem.tif").write_bytes(tiff(grid, none="-999", **how))
    got = ranges.raster_window(spark, str(tmp_path / "dem.tif"), (18, 5, 41, 30), split_bytes=200)
    assert got.rdd.getNumPartitions() > 1
    cells = {(r.row, r.col): (r.x, r.y, r.value) for r in got.collect()}
    want = {(r, c): (1000 + 2 * c + 1.0, 5000 - 2 * r - 1.0, None if (r, c) == (20, 10) else float(grid[r, c])) for r in range(18, 41) for c in range(5, 30)}
    assert cells == want
    assert ranges.aligned_window(str(tmp_path / "dem.tif"), 1010.0, 4964.0, 50.0, 46.0) == (18, 5, 41, 30)
    with pytest.raises(ValueError, match="edges"):
        ranges.aligned_window(str(tmp_path / "dem.tif"), 1011.0, 4964.0, 50.0, 46.0)
    with pytest.raises(Exception, match="not within"):
        ranges.raster_window(spark, str(tmp_path / "dem.tif"), (18, 5, 51, 30)).count()


def test_bytes_read_are_those_of_the_window(tmp_path):
    grid = np.zeros((512, 512), np.float32)
    (tmp_path / "dem.tif").write_bytes(tiff(grid, rows_a_strip=1))
    from pyspark.sql.types import StructType

    reader = ranges.WindowReader({"path": str(tmp_path / "dem.tif"), "window": "[100, 0, 110, 512]"}, StructType.fromDDL("value double"))
    met = [b for p in reader.partitions() for b in p.blocks]
    assert met == list(range(100, 110))


def files(rows):
    return [(f"f{i}.png", bytes([i]) * i, json.dumps({"n": i})) for i in rows]


KIND = "name string, data binary, about string"


def test_files_are_there_all_at_once_and_once_only(spark, tmp_path):
    path = str(tmp_path / "out")
    committed.write_files(spark.createDataFrame(files(range(1, 9)), KIND).repartition(3), path)
    committed.write_files(spark.createDataFrame(files(range(5, 12)), KIND).repartition(2), path)
    got = {r.name: (bytes(r.data), r.about) for r in committed.contents(spark, path).collect()}
    assert got == {n: (d, a) for n, d, a in files(range(1, 12))}
    assert committed.committed(spark, path).count() == 11


def test_a_task_that_fails_midway_leaves_nothing_to_see(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame(files(range(1, 30)), KIND).repartition(4)
    broken = rows.withColumn("name", F.when(F.col("name") == "f17.png", F.lit("a/b")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no name for a file"):
        committed.write_files(broken, path)
    assert committed.committed(spark, path).count() == 0
    committed.write_files(rows, path)
    assert committed.contents(spark, path).count() == 29
    damaged = committed.committed(spark, path).first().file
    with open(os.path.join(path, damaged), "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="damaged"):
        committed.contents(spark, path).collect()


def test_layers_written_in_parts_are_read_as_one(spark, tmp_path):
    path = str(tmp_path / "layers")
    rows = spark.range(1000).selectExpr("id AS idx", "float(id % 50) AS height", "if(id % 5 = 0, null, id % 300) AS cluster", "array(id % 7, id % 11, 3) AS classes", "id * 3 AS id")
    committed.write_layers(binary.layer_chunks(rows, FIELDS, 12, rows=170), path)
    whole = b"".join(bytes(r.data) for r in committed.contents(spark, path).orderBy("name").collect())
    (tmp_path / "layers.bin").write_bytes(whole)
    back = ranges.layer_records(spark, str(tmp_path / "layers.bin"), 12, 1000, FIELDS, split_bytes=3000)
    assert [(r.idx, r.height, r.cluster, r.id) for r in back.orderBy("idx").collect()] == [(r.idx, r.height, r.cluster, r.id) for r in rows.orderBy("idx").collect()]


def test_archives_that_are_no_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.npz", "w") as z:
        z.writestr("a.npy", b"hello")
    with pytest.raises(Exception, match="not a stored array"):
        ranges.array_rows(spark, str(tmp_path / "x.npz")).count()
