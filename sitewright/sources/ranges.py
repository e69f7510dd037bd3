"""Scans that split a file: fixed records, arrays and rasters are read by ranges of bytes, and only what is asked for.

Each is a data source of Spark's: the driver reads a file's head, lists ranges as partitions, and tasks read theirs. A
``schema`` names the columns that are wanted; others are not decoded, and of rasters and archives the bytes of other
windows and members are not read. Paths are files, folders or patterns of a store that Arrow's file systems reach.
"""

from __future__ import annotations

import ast
import fnmatch
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .binary import FIELD_TYPES, PLY_TYPES

BATCH = 100_000


def file_system(path: str):
    """(file system, path) of a URI or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of those of a JSON list of paths, of the files of a folder but those whose name starts with a dot or an underscore, or of those
    that a pattern in the last part of a path names; in order."""
    from pyarrow.fs import FileSelector, FileType

    if path.startswith("["):
        return [f for p in json.loads(path) for f in files_of(p)]
    fs, root = file_system(path)
    head, _, last = root.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(FileSelector(head)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(root)) if not f.base_name.startswith((".", "_"))]
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == FileType.File)


def opened(path: str):
    fs, root = file_system(path)
    return fs.open_input_file(root)


# --- fixed records ----------------------------------------------------------------------------------------------------


@dataclass
class RecordRange(InputPartition):
    path: str
    at: int
    first: int
    count: int
    dtype: np.dtype


class RecordReader(DataSourceReader):
    """Rows of ``path``, the record's number and the fields that the schema names."""

    def __init__(self, options: dict, schema: StructType):
        self.schema, self.split = schema, int(options.get("split_bytes", 64 << 20))
        self.number = "idx" if "fields" in options else "row_id"
        self.options = options

    def layout(self, path: str, size: int) -> tuple[np.dtype, int, int]:
        """(type of a record, bytes before the first, number of records)."""
        if "fields" in self.options:
            dtype = record_type(json.loads(self.options["fields"]), int(self.options["record_bytes"]))
            return dtype, 0, int(self.options["count"]) if "count" in self.options else size // dtype.itemsize
        with opened(path) as f:
            head = b""
            while b"end_header\n" not in head:
                more = f.read(4096)
                if not more or len(head) > 1 << 20:
                    raise ValueError(f"{path} has no header of a point file")
                head += more
        lines = head[: head.index(b"end_header\n")].decode("ascii", "replace").split("\n")
        if lines[0] != "ply" or "format binary_little_endian 1.0" not in lines:
            raise ValueError("only binary little-endian PLY files")
        count = next(int(x.split()[2]) for x in lines if x.startswith("element vertex "))
        dtype = np.dtype([(x.split()[2], PLY_TYPES[x.split()[1]]) for x in lines if x.startswith("property ")])
        return dtype, head.index(b"end_header\n") + len(b"end_header\n"), count

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in files_of(self.options["path"]):
            dtype, at, count = self.layout(path, size)
            if size - at < count * dtype.itemsize:
                raise ValueError(f"{size - at} bytes are fewer than {count} records of {dtype.itemsize}")
            each = max(1, self.split // dtype.itemsize)
            out += [RecordRange(path, at, n, min(each, count - n), dtype) for n in range(0, count, each)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RecordRange):
            return
        dtype, kinds = partition.dtype, self.schema
        with opened(partition.path) as f:
            for n in range(0, partition.count, BATCH):
                many = min(BATCH, partition.count - n)
                first = partition.first + n
                rec = np.frombuffer(f.read_at(many * dtype.itemsize, partition.at + first * dtype.itemsize), dtype, many)
                columns = []
                for name in kinds.names:
                    if name == "path":
                        columns.append(pa.array([partition.path] * many, pa.string()))
                    elif name == self.number:
                        columns.append(pa.array(np.arange(first, first + many), pa.int64()))
                    else:
                        columns.append(_column(rec[name], kinds[name].dataType.simpleString(), "fields" in self.options))
                yield pa.RecordBatch.from_arrays(columns, kinds.names)


_ARROW = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}


def _column(v: np.ndarray, kind: str, none: bool) -> pa.Array:
    """An Arrow column of one field; no number is null, and so is 65535 in a single u16 of layer records."""
    if kind.startswith("array<"):
        flat = pa.array(np.ascontiguousarray(v).reshape(-1).astype(_ARROW[kind[6:-1]].to_pandas_dtype()), _ARROW[kind[6:-1]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), flat)
    mask = v == 65535 if none and v.dtype == np.dtype("<u2") else np.isnan(v) if v.dtype.kind == "f" else None
    return pa.array(v.astype(_ARROW[kind].to_pandas_dtype()), _ARROW[kind], mask=mask)


def record_type(fields: list[dict], record_bytes: int) -> np.dtype:
    names, formats = [f["name"] for f in fields], []
    for f in fields:
        base, _, n = f["type"].partition("x")
        formats.append((FIELD_TYPES[base][0], (int(n),)) if n else FIELD_TYPES[base][0])
    return np.dtype({"names": names, "formats": formats, "offsets": [f["offset"] for f in fields], "itemsize": record_bytes})


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_records"

    def schema(self) -> str:
        raise ValueError("name the columns that are wanted")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(dict(self.options), schema)


def layer_records(spark: SparkSession, path: str | list[str], record_bytes: int, count: int | None, fields: list[dict], wanted: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """``path, idx`` and the ``wanted`` fields (all, if not named) of fixed-size records, split into ranges of ``split_bytes``.

    As ``binary.layer_records``, which reads a file in a task. Without ``count``, a file has as many records as fit; ``idx``
    is that in its file.
    """
    spark.dataSource.register(RecordSource)
    kinds = {}
    for f in fields:
        base, _, n = f["type"].partition("x")
        kind = FIELD_TYPES[base][1]
        kinds[f["name"]] = f"array<{'long' if kind != 'float' else kind}>" if n else "long" if base == "u16" else kind
    columns = ["path string", "idx long", *[f"{n} {kinds[n]}" for n in (wanted if wanted is not None else kinds)]]
    read = spark.read.format("sitewright_records").schema(", ".join(columns))
    if count is not None:
        read = read.option("count", count)
    path = json.dumps(path) if isinstance(path, list) else path
    return read.options(path=path, record_bytes=record_bytes, fields=json.dumps(fields), split_bytes=split_bytes).load()


def ply_points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z", "opacity"), split_bytes: int = 64 << 20) -> DataFrame:
    """``path, row_id`` and some vertex properties, as doubles, of binary little-endian PLY files, split into ranges."""
    spark.dataSource.register(RecordSource)
    kinds = ", ".join(["path string", "row_id long", *[f"{c} double" for c in columns]])
    return spark.read.format("sitewright_records").schema(kinds).options(path=path, split_bytes=split_bytes).load()


# --- arrays and archives of arrays ------------------------------------------------------------------------------------


@dataclass
class ArrayRange(InputPartition):
    path: str
    member: str
    at: int  # of the array's first byte in the file, or -1 where its member is packed
    first: int
    count: int
    dtype: str
    row: int  # values in a row


def array_head(data: bytes) -> tuple[str, tuple[int, ...], int]:
    """(type, shape, bytes of the head) of a stored array; only those in C order."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a stored array")
    size, at = (struct.unpack_from("<H", data, 8)[0], 10) if data[6] == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    told = ast.literal_eval(data[at : at + size].decode("latin1"))
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError("only arrays in C order")
    if not isinstance(told["descr"], str) or np.dtype(told["descr"]).kind not in "fiub":
        raise ValueError("only arrays of numbers")
    return told["descr"], told["shape"], at + size


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.members = json.loads(options.get("members", "null"))
        self.rows = tuple(json.loads(options.get("rows", "[0, null]")))
        self.split = int(options.get("split_bytes", 64 << 20))

    def _ranges(self, path: str, member: str, at: int, head: bytes, packed: bool) -> list[ArrayRange]:
        dtype, shape, skip = array_head(head)
        count, row = (shape[0], int(np.prod(shape[1:], dtype=np.int64))) if shape else (1, 1)
        low, high = max(0, self.rows[0]), count if self.rows[1] is None else min(count, self.rows[1])
        if low >= high:
            return []
        if packed:  # no range of it can be read on its own
            return [ArrayRange(path, member, -1, low, high - low, dtype, row)]
        each = max(1, self.split // max(1, row * np.dtype(dtype).itemsize))
        return [ArrayRange(path, member, at + skip, n, min(each, high - n), dtype, row) for n in range(low, high, each)]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, _ in files_of(self.options["path"]):
            with opened(path) as f:
                if f.read_at(4, 0) != b"PK\x03\x04":
                    out += self._ranges(path, "", 0, f.read_at(1 << 16, 0), False)
                    continue
                with zipfile.ZipFile(f) as index:  # reads the directory at its end, no member
                    for m in index.infolist():
                        name = m.filename.removesuffix(".npy")
                        if self.members is not None and name not in self.members:
                            continue
                        if m.compress_type == zipfile.ZIP_STORED:
                            local = f.read_at(30, m.header_offset)
                            at = m.header_offset + 30 + sum(struct.unpack_from("<HH", local, 26))
                            out += self._ranges(path, name, at, f.read_at(1 << 16, at), False)
                        else:
                            with index.open(m) as part:
                                out += self._ranges(path, name, 0, part.read(1 << 16), True)
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ArrayRange):
            return
        p, dtype = partition, np.dtype(partition.dtype)
        width = p.row * dtype.itemsize
        each = max(1, min(BATCH, (8 << 20) // max(1, width)))
        with opened(p.path) as f:
            packed = None
            if p.at < 0:
                packed = zipfile.ZipFile(f).open(p.member + ".npy")
                skip = array_head(packed.read(1 << 16))[2] + p.first * width
                packed.seek(0)
                while skip > 0:
                    skip -= len(packed.read(min(skip, 1 << 20)))
            for n in range(0, p.count, each):
                many = min(each, p.count - n)
                data = packed.read(many * width) if packed else f.read_at(many * width, p.at + (p.first + n) * width)
                if len(data) < many * width:
                    raise ValueError(f"{p.path} ends within {p.member or 'its array'}")
                flat = pa.array(np.frombuffer(data, dtype).astype(np.float64))
                made = {
                    "path": lambda many=many: pa.array([p.path] * many, pa.string()),
                    "member": lambda many=many: pa.array([p.member] * many, pa.string()),
                    "i": lambda n=n, many=many: pa.array(np.arange(p.first + n, p.first + n + many), pa.int64()),
                    "v": lambda flat=flat, many=many: pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * p.row, pa.int32()), flat),
                }
                yield pa.RecordBatch.from_arrays([made[c]() for c in self.schema.names], self.schema.names)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_arrays"

    def schema(self) -> str:
        return "path string, member string, i long, v array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(dict(self.options), schema)


def array_rows(spark: SparkSession, path: str | list[str], members: list[str] | None = None, first: int = 0, end: int | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """``path, member, i, v``: the rows ``first`` to ``end`` of stored arrays, or of the named members of archives of them.

    ``v`` has the values of a row, further dimensions in C order; an array of one dimension has one value a row. An archive
    is read by its directory: other members' bytes are not touched, and members that are not packed are split by rows.
    """
    spark.dataSource.register(ArraySource)
    path = json.dumps(path) if isinstance(path, list) else path
    return spark.read.format("sitewright_arrays").options(path=path, members=json.dumps(members), rows=json.dumps([first, end]), split_bytes=split_bytes).load()


# --- windows of rasters -----------------------------------------------------------------------------------------------

#: Fixed values of the format: tags, sizes of their types, and kinds of samples (format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NO_DATA = 33550, 33922, 42113
_TAG = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_SAMPLE = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Raster:
    """What a raster's directory says: size, type, where its blocks are, and where its corner lies."""

    rows: int
    cols: int
    dtype: str
    packed: bool
    predicted: bool
    block: tuple[int, int]
    at: list[int]
    length: list[int]
    west: float | None
    north: float | None
    cell: float | None
    none: float | None

    @property
    def across(self) -> int:
        return -(-self.cols // self.block[1])

    def place(self, b: int) -> tuple[int, int]:
        return b // self.across * self.block[0], b % self.across * self.block[1]


def raster_head(f) -> Raster:
    """The directory of a raster file of one band, of strips or tiles, plain or deflated; nothing else of it is read."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a raster of tags")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count_kind, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    n = struct.unpack(order + count_kind, f.read_at(struct.calcsize(order + count_kind), at))[0]
    listed = f.read_at(n * entry, at + struct.calcsize(order + count_kind))
    tags = {}
    for i in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), listed, i * entry)
        if kind not in _TAG:
            continue
        size = struct.calcsize("<" + _TAG[kind]) * many
        own = listed[i * entry + entry - inline : (i + 1) * entry]
        raw = own[:size] if size <= inline else f.read_at(size, struct.unpack(order + ("Q" if big else "I"), own)[0])
        tags[tag] = raw.rstrip(b"\0") if kind == 2 else struct.unpack(order + _TAG[kind] * many, raw)
    one = lambda t, default=None: tags[t][0] if t in tags else default
    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only one band, plain or deflated")
    kind = _SAMPLE.get((one(FORMAT, 1), one(BITS, 1)))
    if kind is None:
        raise ValueError("only samples of 8 to 64 bits")
    tiled = TILE_AT in tags
    rows, cols = one(HEIGHT), one(WIDTH)
    block = (one(TILE_H), one(TILE_W)) if tiled else (min(one(STRIP_ROWS, rows), rows), cols)
    scale, tie = tags.get(PIXEL_SCALE), tags.get(TIE_POINT)
    west, north = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if scale and tie else (None, None)
    none = float(tags[NO_DATA]) if NO_DATA in tags else None
    return Raster(rows, cols, order + kind, one(COMPRESSION, 1) != 1, one(PREDICTOR, 1) == 2, block, list(tags[TILE_AT if tiled else STRIP_AT]), list(tags[TILE_BYTES if tiled else STRIP_BYTES]), west, north, scale[0] if scale else None, none)


@dataclass
class BlockRange(InputPartition):
    path: str
    raster: Raster
    blocks: list[int]
    window: tuple[int, int, int, int]


class WindowReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        asked, split = json.loads(self.options["window"]), int(self.options.get("split_bytes", 16 << 20))
        for path, _ in files_of(self.options["path"]):
            with opened(path) as f:
                r = raster_head(f)
            r0, c0, r1, c1 = asked or (0, 0, r.rows, r.cols)
            if not (0 <= r0 <= r1 <= r.rows and 0 <= c0 <= c1 <= r.cols):
                raise ValueError(f"the window {asked} is not within {r.rows} x {r.cols} cells")
            met = [b for b in range(len(r.at)) if (p := r.place(b))[0] < r1 and p[0] + r.block[0] > r0 and p[1] < c1 and p[1] + r.block[1] > c0]
            own, held = [], 0
            for b in met:
                own.append(b)
                held += r.length[b]
                if held >= split:
                    out.append(BlockRange(path, r, own, (r0, c0, r1, c1)))
                    own, held = [], 0
            if own:
                out.append(BlockRange(path, r, own, (r0, c0, r1, c1)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, BlockRange):
            return
        r, (r0, c0, r1, c1) = partition.raster, partition.window
        with opened(partition.path) as f:
            for b in partition.blocks:
                top, left = r.place(b)
                tall = r.block[0] if r.block[1] != r.cols else min(r.block[0], r.rows - top)
                data = f.read_at(r.length[b], r.at[b])
                data = zlib.decompress(data) if r.packed else data
                grid = np.frombuffer(data, r.dtype, tall * r.block[1]).reshape(tall, r.block[1])
                if r.predicted:
                    grid = np.cumsum(grid, axis=1, dtype=grid.dtype)
                a, z, p, q = max(r0, top), min(r1, top + tall, r.rows), max(c0, left), min(c1, left + r.block[1], r.cols)
                cut = grid[a - top : z - top, p - left : q - left].astype(np.float64)
                row, col = (x.ravel() for x in np.mgrid[a:z, p:q])
                gone = np.isnan(cut.ravel()) | (cut.ravel() == r.none if r.none is not None else False)
                whole = {"path": None, "row": row, "col": col, "value": cut.ravel()}
                if r.cell is not None:
                    whole |= {"x": r.west + (col + 0.5) * r.cell, "y": r.north - (row + 0.5) * r.cell}
                for n in range(0, len(row), BATCH):
                    part = slice(n, n + BATCH)
                    many = len(row[part])
                    made = []
                    for name in self.schema.names:
                        if name == "path":
                            made.append(pa.array([partition.path] * many, pa.string()))
                        elif name in ("row", "col"):
                            made.append(pa.array(whole[name][part], pa.int32()))
                        elif name == "value":
                            made.append(pa.array(whole[name][part], pa.float64(), mask=gone[part]))
                        else:
                            made.append(pa.array(whole[name][part]) if name in whole else pa.nulls(many, pa.float64()))
                    yield pa.RecordBatch.from_arrays(made, self.schema.names)


class WindowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitewright_window"

    def schema(self) -> str:
        return "path string, row int, col int, x double, y double, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WindowReader(dict(self.options), schema)


def raster_window(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, split_bytes: int = 16 << 20) -> DataFrame:
    """``path, row, col, x, y, value`` of the cells of rasters in ``window`` (first row, first column, end row, end column).

    ``x, y`` are the places of the cells' centres by the file's own georeference, null where it has none; ``value`` is null
    where a cell has no data. Only strips or tiles that the window meets are read. A window beyond a raster is an error.
    """
    spark.dataSource.register(WindowSource)
    return spark.read.format("sitewright_window").options(path=path, window=json.dumps(window), split_bytes=split_bytes).load()


def aligned_window(path: str, west: float, north: float, width: float, height: float) -> tuple[int, int, int, int]:
    """The window of a raster that a box of the map covers, whose edges must lie on edges of cells."""
    with opened(path) as f:
        r = raster_head(f)
    if r.cell is None:
        raise ValueError("the raster has no place on the map")
    edges = [(r.north - north) / r.cell, (west - r.west) / r.cell, (r.north - north + height) / r.cell, (west + width - r.west) / r.cell]
    if any(abs(e - round(e)) > 1e-6 for e in edges):
        raise ValueError("the box's edges are not edges of cells")
    return tuple(round(e) for e in edges)
