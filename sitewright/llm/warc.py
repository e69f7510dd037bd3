"""WARC archives compressed with Zstandard and a dictionary: writer, reader, and revisits of equal payloads.

A file is a skippable frame that holds the dictionary, then one Zstandard frame for each record. The reader loads the
dictionary from the leading frame, decodes frame by frame in bounded memory, and checks version line, header lines,
declared lengths, digests and record ends.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_folder, small_batches, written

DICT_FRAME = 0x184D2A5D  # the skippable frame's magic number for dictionaries
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
END = b"\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response of page ``refers_to``: HTTP head and no payload."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    clean = "".join(c for c in url or "" if c.isprintable() and c != " ") or f"page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary from sample records, or empty where they are too few."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary


def frames(read, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decoded Zstandard frames of a file, one by one. ``read(n)`` gives up to n bytes, none at the end.

    The dictionary comes from the leading skippable frame; it may itself be compressed. Later skippable frames are passed.
    """
    buffer = bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            more = read(chunk)
            if not more:
                return False
            buffer.extend(more)
        return True

    dictionary, leading = None, True
    while need(1):
        if not need(4):
            raise WarcError("the file ends within a frame's magic number")
        magic = struct.unpack_from("<I", buffer)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not need(8):
                raise WarcError("the file ends within a skippable frame")
            size = struct.unpack_from("<I", buffer, 4)[0]
            if not need(8 + size):
                raise WarcError("the file ends within a skippable frame")
            if leading and magic == DICT_FRAME and size:
                data = bytes(buffer[8 : 8 + size])
                if data[:4] == struct.pack("<I", ZSTD_FRAME):
                    data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
                dictionary = zstandard.ZstdCompressionDict(data)
            del buffer[: 8 + size]
        elif magic == ZSTD_FRAME:
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            out = []
            try:
                while True:
                    out.append(decoder.decompress(bytes(buffer)))
                    buffer.clear()
                    if decoder.eof:
                        buffer.extend(decoder.unused_data)
                        break
                    if not need(1):
                        raise WarcError("the file ends within a frame")
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            yield b"".join(out)
        else:
            raise WarcError(f"no frame starts with {magic:#x}")
        leading = False


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises WarcError where the record is not sound."""
    head, mark, rest = data.partition(END)
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "strict").partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise WarcError(f"no header line: {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + len(END) or rest[n:] != END:
        raise WarcError(f"the record has {len(rest)} bytes after its headers, not {n} and two line ends")
    block = rest[:n]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise WarcError("the block has another digest")
    return headers, block


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, html) of a response or revisit record."""
    kind = headers["warc-type"]
    head, mark, payload = block.partition(END)
    declared = [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(declared) != 1 or not declared[0].isdigit():
        raise WarcError("the HTTP head has no end or no length")
    digest, page = headers.get("warc-payload-digest", "")[5:], headers.get("x-page-id")
    page_id = None if page is None else int(page)
    if kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("a revisit has a payload or refers to nothing")
        return page_id, int(declared[0]), digest, kind, int(headers["x-refers-to-page-id"]), None
    if len(payload) != int(declared[0]) or digest != sha1_base32(payload):
        raise WarcError("the payload has another length or digest")
    return page_id, len(payload), digest, kind, None, payload.decode("utf-8")


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, sample_rows: int = 400, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; return the archives: ``archive, records, bytes``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id is a response (each row of
    that id and payload) and the others revisit it; smaller ones are responses. A row without an id is a record without
    one, which none revisits. The dictionary is trained on at most ``sample_rows`` payloads, by the order of a hash, and
    on at most 32 KiB of each. Archives are named by the task's attempt: one that is run again writes others, and only
    those in the result count.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    keyed = written(pages.select("page_id", "digest", F.octet_length("html").alias("n")), "digests")
    eligible = keyed.filter(F.col("n") >= min_revisit_bytes)
    shared = eligible.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    revisits = eligible.join(written(shared, "shared"), "digest").filter(F.coalesce(F.col("page_id") != F.col("refers_to"), F.col("refers_to").isNotNull()))
    revisits = revisits.select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to").distinct()
    few = keyed.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows).select("page_id").distinct()
    sample = [r.html[: 1 << 15].encode() for r in pages.join(F.broadcast(few), "page_id").select("html").limit(sample_rows).collect()]
    dictionary = spark.sparkContext.broadcast(train_dictionary(sample))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = file_system(folder)
        d = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True)
        out, number, sink, name, records, size = [], 0, None, "", 0, 0

        def close():
            nonlocal sink, number
            if sink is not None:
                sink.close()
                out.append((name, records, size))
                sink, number = None, number + 1

        for pdf in batches:
            for page, url, html, ref in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if sink is None:
                    name, records = f"pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:04d}.warc.zst", 0
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    size = sink.write(dictionary_frame(dictionary.value))
                whole = lambda x: None if pd.isna(x) else int(x)
                size += sink.write(pack.compress(record(whole(page), url, html.encode("utf-8", "replace"), whole(ref))))
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pd.DataFrame(out, columns=["archive", "records", "bytes"])

    # a page is its id and its payload: pages of one id may differ
    rows = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to").sortWithinPartitions("page_id")
    return written(rows.mapInPandas(save, "archive string, records long, bytes long"), "archives")


def read(archives: DataFrame, folder: str, with_html: bool = False) -> DataFrame:
    """The records of ``archives(archive)`` under ``folder``: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` and, if asked, ``html`` (null for revisits). An unsound archive fails the job with what is wrong."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"][: 6 if with_html else 5]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        for pdf in batches:
            for name in pdf["archive"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for data in frames(source.read):
                        rows.append(page_row(*parse(data))[: len(names)])
                        size += len(data) if with_html else 200
                        if size > 16 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                yield _frame(rows, names)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_html
    dealt = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return dealt.mapInPandas(load, kinds)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    pdf[["page_id", "refers_to"]] = pdf[["page_id", "refers_to"]].astype("Int64")
    return pdf


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into archives and read them back: a row for each row of ``pages``.

    Null html is empty; a null or unprintable url becomes one made from the page's id. Rows that repeat are records each.
    Rows of one id and other html are pages of their own. A row without an id has none in the result. An empty table
    writes nothing and gives no rows. Other columns of ``pages`` play no part.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, min_revisit_bytes), folder)
