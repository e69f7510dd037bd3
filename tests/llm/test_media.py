import hashlib
import io
import tarfile
import zlib

import pytest

from sitewright.llm import media as M
from sitewright.llm.shared import new_folder


def test_png_round_trip():
    for n in (0, 1, 63, 64, 65, 5000):
        payload, size = M.payload_of("x" * n)
        assert size == n and len(payload) % 64 == 0 and len(payload) >= 64
        png = M.to_png(payload)
        assert M.from_png(png) == payload
        assert M.png_header(png[: M.HEADER_BYTES]) == (64, len(payload) // 64, 8)
    with pytest.raises(ValueError):
        M.png_header(b"GIF89a" + bytes(40))
    bad = bytearray(M.to_png(M.payload_of("abc")[0]))
    bad[45] ^= 1
    with pytest.raises(ValueError):
        M.from_png(bytes(bad))


def test_columns_and_shards(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 40, "c"), (4, "é" * 40, "d"), (4, "é" * 40, "d"), (5, "y" * 70_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    folder = new_folder(spark, "test-media")
    got = M.media_columns(docs, folder).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    for d, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        r = by[d]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        with open(f"{folder.removeprefix('file://')}/{r.shard}", "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.media_bytes)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and M.from_png(stored) == payload
        with tarfile.open(f"{folder.removeprefix('file://')}/{r.shard}") as tar:
            assert tar.extractfile(f"{r.payload_sha256}.png").read() == stored
        assert (r.width, r.height, r.bits) == (64, len(payload) // 64, 8)
    assert by[1].feature == by[2].feature and by[1].offset == by[2].offset
    assert by[3][1:] == by[4][1:]
    assert M.media_columns(docs.limit(0)).count() == 0


def test_small_shards_roll_over(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "test-shards")
    places = M.store(docs, folder, shard_bytes=4000).collect()
    assert len({p.shard for p in places}) > 3
    for p in places:
        data = open(f"{folder.removeprefix('file://')}/{p.shard}", "rb").read()
        assert M.from_png(data[p.offset : p.offset + p.length]).rstrip(b"\0").decode() == f"text {p.doc_id} " * 50
        tarfile.open(fileobj=io.BytesIO(data)).getmembers()


def test_digests_move_as_bytes(spark, monkeypatch):
    from sitewright.llm import media

    kinds, write = {}, media.written
    monkeypatch.setattr(media, "written", lambda df, name, **o: kinds.setdefault(name, df.schema["digest"].dataType.simpleString()) and write(df, name, **o))
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert set(kinds.values()) == {"binary"} and got[1].digest == got[3].digest == got[1].payload_sha256 and len(got[2].media_sha256) == 64
    assert got[1].digest == media.hashlib.sha256(media.payload_of("a")[0]).hexdigest()
