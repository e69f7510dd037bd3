"""Scans of binary scene files: grey PNG grids, layer records, point clouds. Spark lists and reads the files; a scene is one
file of some 10 MB, so that a file is a task and many scenes are many tasks. Rows leave a task in batches."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 100_000
PNG_MARK = b"\x89PNG\r\n\x1a\n"


def png_samples(data: bytes) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(samples, alpha or None, bits) of a grey PNG of 8 or 16 bits, with or without alpha, not interlaced."""
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG file")
    at, packed = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if colour not in (0, 4) or bits not in (8, 16) or interlaced:
        raise ValueError("only grey pictures of 8 or 16 bits")
    channels = 1 if colour == 0 else 2
    pixel = channels * bits // 8
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * pixel)
    out, above = np.zeros((height, width * pixel), np.uint8), np.zeros(width * pixel, np.uint8)
    for i in range(height):
        above = out[i] = _unfiltered(int(lines[i, 0]), lines[i, 1:], above, pixel)
    samples = out.reshape(-1).view(">u2" if bits == 16 else np.uint8).reshape(height, width, channels).astype(np.int64)
    return samples[:, :, 0], samples[:, :, 1] if channels == 2 else None, bits


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, pixel), axis=0, dtype=np.uint8).reshape(-1)
    now, up, left, corner = line.reshape(-1, pixel).astype(int), above.reshape(-1, pixel).astype(int), np.zeros(pixel, int), np.zeros(pixel, int)
    for i in range(len(now)):
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[i], corner))
        corner = up[i]
        left = now[i] = (now[i] + guess) & 255
    return now.astype(np.uint8).reshape(-1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(files: DataFrame, schema: str, decode) -> DataFrame:
    """Rows of ``decode(bytes)``, a frame per file, sent in batches with the file's path before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = decode(bytes(content))
                rows.insert(0, "path", path)
                for at in range(0, len(rows), BATCH):
                    yield rows[at : at + BATCH]

    return files.mapInPandas(run, f"path string, {schema}")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, col, px, alpha, top`` of grey PNG files; alpha null where there is none, top the greatest sample."""

    def decode(data: bytes) -> pd.DataFrame:
        samples, alpha, bits = png_samples(data)
        row, col = np.indices(samples.shape).reshape(2, -1)
        a = pd.array([None] * samples.size, dtype="Int32") if alpha is None else pd.array(alpha.ravel(), dtype="Int32")
        return pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32), "px": samples.ravel().astype(np.int32), "alpha": a, "top": np.int32(2**bits - 1)})

    return _rows(_files(spark, path), "row int, col int, px int, alpha int, top int", decode)


def height_grid(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """``row, col, z``: heights from ``low`` at 0 to ``high`` at the greatest sample."""
    return pixels(spark, path).select("row", "col", (F.lit(low) + F.col("px") / F.col("top") * (high - low)).alias("z"))


def raster_values(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """``row, col, value``: null where alpha is 0."""
    value = F.lit(low) + F.col("px") / F.col("top") * (high - low)
    return pixels(spark, path).select("row", "col", F.when(F.coalesce("alpha", F.lit(1)) != 0, value).alias("value"))


def surface_grid(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """``row, col, z``: sample 0 is no data, 1 to 65535 run from ``low`` to ``high``."""
    z = F.lit(low) + (F.col("px") - 1) / 65534 * (high - low)
    return pixels(spark, path).select("row", "col", F.when(F.col("px") > 0, z).alias("z"))


#: Field types of a layer's description: numpy type and Spark type.
FIELD_TYPES = {"f16": ("<f2", "float"), "f32": ("<f4", "float"), "u8": ("u1", "int"), "u16": ("<u2", "int"), "u32": ("<u4", "long")}


def record_width(kind: str) -> int:
    """Bytes of a field type."""
    base, _, n = kind.partition("x")
    return np.dtype(FIELD_TYPES[base][0]).itemsize * int(n or 1)


def layer_records(spark: SparkSession, path: str, record_bytes: int, count: int, fields: list[dict]) -> DataFrame:
    """``path, idx`` and the described fields of fixed-size records.

    ``fields``: name, type (a key of ``FIELD_TYPES``; "u8x7" is an array of 7), offset. 65535 in a u16 field is null.
    Fewer bytes than ``count`` records are an error; bytes after them are ignored.
    """
    types, kinds = {}, []
    for f in fields:
        base, _, n = f["type"].partition("x")
        code, kind = FIELD_TYPES[base]
        types[f["name"]] = ((code, (int(n),)) if n else code, f["offset"])
        kinds.append(f"{f['name']} {f'array<{kind}>' if n else kind}")
    names = list(types)
    dtype = np.dtype({"names": names, "formats": [types[n][0] for n in names], "offsets": [types[n][1] for n in names], "itemsize": record_bytes})

    def decode(data: bytes) -> pd.DataFrame:
        if len(data) < count * record_bytes:
            raise ValueError(f"{len(data)} bytes are fewer than {count} records of {record_bytes}")
        rec = np.frombuffer(data, dtype, count)
        out = {"idx": np.arange(count, dtype=np.int64)}
        for n in names:
            v = rec[n]
            if v.ndim > 1:
                out[n] = list(v.astype(np.int64 if v.dtype.kind == "u" else np.float32))
            elif v.dtype == np.dtype("<u2"):
                out[n] = pd.array(v.astype(np.int64), dtype="Int64")
                out[n][v == 65535] = pd.NA
            else:
                out[n] = v.astype(np.float32) if v.dtype.kind == "f" else v.astype(np.int64)
        return pd.DataFrame(out)

    return _rows(_files(spark, path), "idx long, " + ", ".join(kinds), decode)


PLY_TYPES = {"float": "<f4", "double": "<f8", "uchar": "u1", "int": "<i4", "uint": "<u4", "short": "<i2", "ushort": "<u2", "char": "i1"}


def ply_points(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z", "opacity")) -> DataFrame:
    """``path, row_id`` and some vertex properties, as doubles, of binary little-endian PLY files in declared order."""

    def decode(data: bytes) -> pd.DataFrame:
        head, mark, body = data.partition(b"end_header\n")
        lines = head.decode("ascii", "replace").split("\n")
        if lines[0] != "ply" or "format binary_little_endian 1.0" not in lines or not mark:
            raise ValueError("only binary little-endian PLY files")
        count = next(int(x.split()[2]) for x in lines if x.startswith("element vertex "))
        dtype = np.dtype([(x.split()[2], PLY_TYPES[x.split()[1]]) for x in lines if x.startswith("property ")])
        rec = np.frombuffer(body, dtype, count)
        return pd.DataFrame({"row_id": np.arange(count, dtype=np.int64)} | {c: rec[c].astype(np.float64) for c in columns})

    return _rows(_files(spark, path), "row_id long, " + ", ".join(f"{c} double" for c in columns), decode)


def spz_points(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_id, x, y, z`` of gzip-compressed quantised clouds: a 16-byte header, then 24-bit fixed-point places."""

    def decode(data: bytes) -> pd.DataFrame:
        raw = gzip.decompress(data)
        magic, _, count, _, bits = struct.unpack_from("<IIIBB", raw)
        if magic != 0x5053474E:
            raise ValueError("not such a cloud")
        b = np.frombuffer(raw, np.uint8, count * 9, 16).reshape(-1, 3).astype(np.int64)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        xyz = (np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << bits)).reshape(-1, 3)
        return pd.DataFrame({"row_id": np.arange(count, dtype=np.int64), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return _rows(_files(spark, path), "row_id long, x double, y double, z double", decode)


def layer_chunks(layers: DataFrame, fields: list[dict], record_bytes: int, rows: int = BATCH) -> DataFrame:
    """``first, records, data``: fixed-size records of ``layers(idx, ..)`` in the order of idx, in chunks of whole records.

    Concatenated by ``first`` they are what ``layer_records`` reads. ``fields`` as there; a null in a u16 field is 65535,
    elsewhere 0. Chunks are made in the tasks of a range sort.
    """
    codes = {}
    for f in fields:
        base, _, n = f["type"].partition("x")
        codes[f["name"]] = ((FIELD_TYPES[base][0], (int(n),)) if n else FIELD_TYPES[base][0], f["offset"])
    names = list(codes)
    dtype = np.dtype({"names": names, "formats": [codes[n][0] for n in names], "offsets": [codes[n][1] for n in names], "itemsize": record_bytes})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                rec = np.zeros(len(part), dtype)
                for n in names:
                    wide = isinstance(codes[n][0], tuple)
                    none = 65535 if codes[n][0] == "<u2" else 0
                    rec[n] = np.array(part[n].tolist()) if wide else part[n].fillna(none).to_numpy()
                yield pd.DataFrame({"first": [int(part["idx"].iloc[0])], "records": [len(part)], "data": [rec.tobytes()]})

    return layers.select("idx", *names).orderBy("idx").mapInPandas(encode, "first long, records long, data binary")


def quantised_clouds(clouds: DataFrame, bits: int = 12) -> DataFrame:
    """``scene_id, data``: each scene's cloud as a gzip-compressed quantised file, in the order of ``row_id``.

    ``clouds(scene_id, row_id, x, y, z, opacity, dc, scale, quat)``: opacity as a logit, ``dc`` and ``scale`` (logarithms)
    of three numbers, ``quat`` w, x, y, z. Places have 24 bits with ``bits`` after the point, so a place beyond their
    range is an error; colours, sizes and opacities 8 bits; a rotation the three smallest of its four numbers in 10 bits
    each. The format keeps columns apart, so a scene (some 10^6 rows) is one group.
    """

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        place = np.rint(pdf[["x", "y", "z"]].to_numpy(np.float64) * (1 << bits)).astype(np.int64)
        if np.abs(place).max(initial=0) >= 1 << 23:
            raise ValueError("a place beyond 24 bits")
        q = np.array(pdf["quat"].tolist(), np.float64)[:, [1, 2, 3, 0]]
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        top = np.abs(q).argmax(1)
        q *= np.where(q[np.arange(len(q)), top] < 0, -1.0, 1.0)[:, None]
        packed = top.astype(np.uint32)
        rest = np.argsort(np.where(np.arange(4) == top[:, None], 4, np.arange(4)), axis=1)[:, :3]
        for k in range(3):
            v = q[np.arange(len(q)), rest[:, k]]
            size = np.minimum(np.floor(np.abs(v) * np.sqrt(2.0) * 511 + 0.5), 511).astype(np.uint32)
            packed = packed << np.uint32(10) | (v < 0).astype(np.uint32) << np.uint32(9) | size
        byte = lambda a: np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()
        column = lambda n: np.array(pdf[n].tolist(), np.float64)
        body = [
            struct.pack("<IIIBBBB", 0x5053474E, 3, len(pdf), 0, bits, 0, 0),
            np.ascontiguousarray(place, "<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(),
            byte(255 / (1 + np.exp(-pdf["opacity"].to_numpy(np.float64)))),
            byte((column("dc") * 0.15 + 0.5) * 255), byte((column("scale") + 10) * 16), packed.astype("<u4").tobytes(),
        ]
        return pd.DataFrame({"scene_id": [pdf["scene_id"].iloc[0]], "data": [gzip.compress(b"".join(body), 6)]})

    kind = clouds.schema["scene_id"].dataType.simpleString()
    return clouds.groupBy("scene_id").applyInPandas(encode, f"scene_id {kind}, data binary")
