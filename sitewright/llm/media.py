"""Media columns: payloads in tar shards, addressed by content.

A payload is stored as an 8-bit grey picture, ``WIDTH`` samples a line (PNG, so nothing is lost). A shard is a plain tar
file whose members are named by the SHA-256 of their payload; rows carry digest, shard, offset and length. Writing tasks
store a payload once each; of several places of a digest the first is the one that rows refer to. Metadata columns come
from range reads of the fixed-size headers alone; features from the stored bytes, read back and decoded.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_folder, small_batches, written

WIDTH = 64
PNG_MARK = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # the mark and the first chunk


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with 0 to a positive multiple of ``WIDTH``, bytes before padding)."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw)), len(raw)


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit picture whose samples are the payload's bytes, line by line."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first ``HEADER_BYTES`` bytes; raises ValueError where they are not such a header."""
    if len(head) < HEADER_BYTES or head[:8] != PNG_MARK or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("damaged PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if colour:
        raise ValueError("not a grey picture")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made; chunk sums are checked."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        body = data[at + 4 : at + 8 + n]
        if zlib.crc32(body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if body[:4] == b"IDAT":
            packed.append(body[4:])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """The shape of a picture, a histogram of its samples in 16 steps and a 64-bit difference hash of its 8 x 9 thumbnail."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    edges = np.linspace(0, len(grid), 9).astype(int)
    bands = np.stack([grid[a : max(b, a + 1)].sum(0) * 840 // max(1, b - a) for a, b in zip(np.minimum(edges[:-1], len(grid) - 1), edges[1:], strict=True)])
    thumbnail = bands.reshape(8, 8, 8).sum(2)
    steps = (np.diff(np.concatenate([thumbnail, thumbnail[:, :1]], 1), axis=1) > 0).ravel()
    hist = np.bincount(grid.ravel() >> 4, minlength=16) * 255 // grid.size
    return f"{WIDTH}x{len(grid)}:{bytes(hist.tolist()).hex()}:{np.packbits(steps).tobytes().hex()}"


def store(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write the payloads of ``docs(doc_id, text)`` into shards under ``folder`` and return where each row's is.

    ``doc_id, n_bytes, payload_bytes, digest, shard, offset, length``; offset and length are those of the stored form in
    its shard. Shards are named by the task's attempt: one that is run again writes others, and only those in the result
    count.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = file_system(folder)
        number, sink, tar, name, places = 0, None, None, "", {}

        def close():
            nonlocal tar, sink, number
            if tar is not None:
                tar.close()
                sink.close()
                tar, number = None, number + 1

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    if tar is None:
                        name = f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:04d}.tar"
                        sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                        tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                    media = to_png(payload)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(media)
                    places[digest] = (name, tar.offset + 512, len(media))
                    tar.addfile(member, io.BytesIO(media))
                rows.append((doc, n, len(payload), digest, *places[digest]))
                if tar is not None and tar.offset >= shard_bytes:
                    close()
                    places = {}
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        close()

    return docs.select("doc_id", "text").mapInPandas(save, f"doc_id {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")


def read_ranges(places: DataFrame, folder: str, columns: str, of, head: int | None = None) -> DataFrame:
    """``places`` with the columns that ``of(bytes)`` gives for each row's range (or the ``head`` first bytes of it)."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema.fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        shard, source = None, None
        for pdf in batches:
            out = []
            for name, offset, length in zip(pdf["shard"], pdf["offset"], pdf["length"], strict=True):
                if name != shard:
                    shard, source = name, fs.open_input_file(f"{root}/{name}")
                n = int(length) if head is None else min(head, int(length))
                data = source.read_at(n, int(offset))
                if len(data) != n:
                    raise ValueError(f"{name} ends within the range at {offset}")
                out.append(of(data))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return places.mapInPandas(read, f"{kinds}, {columns}")


def media_columns(docs: DataFrame, folder: str | None = None, task_bytes: int = 4 << 20) -> DataFrame:
    """Store the payloads of ``docs(doc_id, text)`` and return them as media columns, a row for each row of ``docs``.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature`` and ``width,
    height, bits``, and the address of the stored form: ``digest, shard, offset, length``. A null text is an empty one; its payload is 64 bytes of 0. Equal texts have equal
    values and refer to one place. Rows that repeat come out each. An empty table writes nothing and gives no rows. Other
    columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "media")
    # digests move as bytes: as text they are twice as long, and neither shuffles nor files make that good
    stored = written(store(docs, folder).withColumn("digest", F.unhex("digest")), "stored")
    in_task = stored.groupBy("digest", "shard").agg(F.min("offset").alias("offset"), F.first("length").alias("length"))
    first = in_task.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    first = written(first, "first")
    # neighbours in a shard are read one after the other, in tasks of about ``task_bytes`` of stored bytes each
    tasks = int(first.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // task_bytes + 1
    first = written(first.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset"), "places")

    def decoded(data: bytes) -> tuple:
        payload = from_png(data)
        return hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature_of(payload)

    known = read_ranges(first, folder, "width long, height long, bits int", png_header, head=HEADER_BYTES)
    known = read_ranges(known, folder, "payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string", decoded)
    # a hot digest is one row for each shard that holds it, so no row here is shared by more than a shard's documents
    by_shard = in_task.select("digest", F.col("shard").alias("own")).join(known, "digest")
    rows = stored.select("doc_id", "n_bytes", "payload_bytes", "digest", F.col("shard").alias("own"))
    hexed = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256", "digest")}
    return rows.join(by_shard, ["digest", "own"]).withColumns(hexed).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "digest", "shard", "offset", "length"
    )
