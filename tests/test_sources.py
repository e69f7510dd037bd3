import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from sitewright.sources import binary, records


def png(samples, bits, filters, alpha=None):
    pixels = samples[:, :, None] if alpha is None else np.dstack([samples, alpha])
    raw = np.ascontiguousarray(pixels.astype(">u2" if bits == 16 else np.uint8)).view(np.uint8).reshape(len(samples), -1).astype(int)
    step, out, above = pixels.shape[2] * bits // 8, b"", np.zeros(raw.shape[1], int)
    for i, line in enumerate(raw):
        kind = filters[i % len(filters)]
        left, corner = np.r_[np.zeros(step, int), line[:-step]], np.r_[np.zeros(step, int), above[:-step]]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", samples.shape[1], len(samples), bits, 0 if alpha is None else 4, 0, 0, 0)
    return binary.PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [8, 16])
def test_png(spark, tmp_path, bits):
    rng = np.random.default_rng(bits)
    samples, alpha = rng.integers(0, 2**bits, (7, 5)), rng.integers(0, 2, (7, 5)) * (2**bits - 1)
    (tmp_path / "a.png").write_bytes(png(samples, bits, [0, 1, 2, 3, 4]))
    got = {(r.row, r.col): r.px for r in binary.pixels(spark, str(tmp_path / "a.png")).collect()}
    assert got == {(r, c): samples[r, c] for r in range(7) for c in range(5)}
    (tmp_path / "b.png").write_bytes(png(samples, bits, [4, 3, 1], alpha))
    values = binary.raster_values(spark, str(tmp_path / "b.png"), 0.0, 1.0).collect()
    assert all((r.value is None) == (alpha[r.row, r.col] == 0) for r in values)


def test_layer_records(spark, tmp_path):
    rec = np.zeros(3, np.dtype([("h", "<f2"), ("c", "<u2"), ("k", "u1", (3,))]))
    rec["h"], rec["c"], rec["k"] = [1.5, -2, 0.25], [7, 65535, 0], [[1, 2, 3], [0, 0, 0], [9, 8, 7]]
    (tmp_path / "layers.bin").write_bytes(rec.tobytes())
    fields = [{"name": "height", "type": "f16", "offset": 0}, {"name": "cluster", "type": "u16", "offset": 2}, {"name": "classes", "type": "u8x3", "offset": 4}]
    got = binary.layer_records(spark, str(tmp_path), 7, 3, fields).orderBy("idx").collect()
    assert [(r.height, r.cluster, r.classes) for r in got] == [(1.5, 7, [1, 2, 3]), (-2.0, None, [0, 0, 0]), (0.25, 0, [9, 8, 7])]
    with pytest.raises(Exception, match="fewer than 4 records"):
        binary.layer_records(spark, str(tmp_path), 7, 4, fields).collect()


def test_clouds(spark, tmp_path):
    v = np.array([(1, 2, 3, 0.5), (4, 5, 6, -1)], np.dtype([(c, "<f4") for c in ("x", "y", "z", "opacity")]))
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\n" + "".join(f"property float {c}\n" for c in v.dtype.names) + "end_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + v.tobytes())
    assert [tuple(r)[2:] for r in binary.ply_points(spark, str(tmp_path / "a.ply")).orderBy("row_id").collect()] == [(1, 2, 3, 0.5), (4, 5, 6, -1)]
    fixed = b"".join((x & 0xFFFFFF).to_bytes(3, "little") for x in (4096, -8192, 1, 0, 2, -1))
    (tmp_path / "a.spz").write_bytes(gzip.compress(struct.pack("<IIIBBBB", 0x5053474E, 2, 2, 0, 12, 0, 0) + fixed))
    assert [tuple(r)[2:] for r in binary.spz_points(spark, str(tmp_path / "a.spz")).orderBy("row_id").collect()] == [(1, -2, 1 / 4096), (0, 2 / 4096, -1 / 4096)]


def test_raster_is_replaced_by_name(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row int, col int, value double")
    for name, high in (("a", 2.0), ("b", 4.0), ("a", 1.0)):
        records.write_raster(cells, name, 0.0, high, 16, str(tmp_path / "r"))
    assert [r.value for r in records.read_raster(spark, str(tmp_path / "r"), "a").orderBy("col").collect()] == [1.0, None]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    with pytest.raises(Exception, match="out of range"):
        records.write_raster(cells, "a", 0.0, 0.5, 16, str(tmp_path / "r"))


def test_text_records(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# head\n1 1 0 0 0 5 6 7 3 left_01.png\n1.5 2.5 8 3.5 4.5 -1\n2 1 0 0 0 0 0 0 3 right_01.png\n\n")
    assert [(r.image_id, r.t, r.name) for r in records.posed_images(spark, str(tmp_path / "i.txt")).orderBy("image_id").collect()] == [(1, [5, 6, 7], "left_01.png"), (2, [0, 0, 0], "right_01.png")]
    (tmp_path / "c.csv").write_text('value,name\n1,"Rock, dark"\n')
    assert records.class_dictionary(spark, str(tmp_path / "c.csv")).first()["name"] == "Rock, dark"
    (tmp_path / "m.json").write_text(json.dumps({"imageid": "x", "sol": 3, "camera": {"camera_model_component_list": "(1,2,3.5);(0,0,1)"}}))
    assert records.raw_images(spark, str(tmp_path / "m.json")).first().camera == [[1, 2, 3.5], [0, 0, 1]]
    (tmp_path / "k.json").write_text(json.dumps({"encoder": "e", "clusters": [{"id": 4, "latent": [0.5], "size": 9}]}))
    assert records.clusters(spark, str(tmp_path / "k.json"), "e").first().size == 9
    with pytest.raises(Exception, match="another encoder"):
        records.clusters(spark, str(tmp_path / "k.json"), "f").collect()
