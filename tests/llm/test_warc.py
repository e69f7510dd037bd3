import base64
import hashlib
import io

import pytest
import zstandard

from sitewright.llm import warc as W
from sitewright.llm.shared import new_folder


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "u v\r\nX: y", None), (2, "x", ""), (7, "é", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 9), (8, "z", "w" * 200_000)]
    rows += [(100 + i, f"http://p/{i}", f"<html>page {i} of many pages, much alike {'and text ' * i}</html>") for i in range(60)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    folder = new_folder(spark, "test-warc")
    archives = W.write(pages, folder, archive_bytes=2000)
    got = {r.page_id: r for r in W.read(archives, folder, with_html=True).collect()}
    first = {}
    for page, _, html in sorted(rows):
        first.setdefault(html or "", page)
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, ref = got[page], first[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), digest(html))
        assert (r.record_type, r.refers_to) == (("response", None) if ref == page else ("revisit", ref))
        assert r.html == ((html or "") if ref == page else None)


def test_small_payloads_are_never_revisited(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "x" * 10), (4, "d", "x" * 10)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in W.round_trip(pages, min_revisit_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert W.round_trip(pages.limit(0)).count() == 0


def file_of(*records, dictionary=b"", compressed_dictionary=False):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=d)
    head = zstandard.compress(dictionary) if compressed_dictionary else dictionary
    return W.dictionary_frame(head) + b"".join(pack.compress(r) for r in records)


@pytest.mark.parametrize("compressed", [False, True])
def test_reader_uses_the_leading_dictionary(compressed):
    samples = [W.record(i, f"http://x/{i}", f"<html><body>body {i} {i * 7}</body></html>".encode() * 20, None) for i in range(400)]
    dictionary = W.train_dictionary(samples)
    assert dictionary
    data = file_of(*samples, dictionary=dictionary, compressed_dictionary=compressed)
    source = io.BytesIO(data)
    assert list(W.frames(source.read, chunk=1000)) == samples


def test_unsound_archives_are_refused():
    good = W.record(1, "u", b"payload", None)
    source = io.BytesIO(file_of(good)[:-3])
    with pytest.raises(W.WarcError):
        list(W.frames(source.read))
    source = io.BytesIO(b"PK\x03\x04" + bytes(50))
    with pytest.raises(W.WarcError):
        list(W.frames(source.read))
    W.page_row(*W.parse(good))
    for bad in (good[:-2], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload\r\n", b"payloaf\r\n"), good.replace(b"WARC-Date: ", b"Date: "), good + b"x", good.replace(b"X-Page-ID:", b"X-Page-ID")):
        with pytest.raises(W.WarcError):
            W.page_row(*W.parse(bad))


def test_a_page_is_its_id_and_its_payload(spark):
    rows = [(3, "AAAA"), (5, "AAAA"), (5, "BBBB"), (2, "BBBB"), (5, "AAAA"), (None, "BBBB"), (None, "CC"), (None, "CC"), (7, None), (8, "")]
    pages = spark.createDataFrame([(p, None, h, 1) for p, h in rows], "page_id long, url string, html string, digest int")
    folder = new_folder(spark, "test-warc")
    got = W.read(W.write(pages, folder), folder).collect()
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, html in rows:
        ref = first.get(html or "")
        kind = "response" if ref is None or ref == page else "revisit"
        want.append((page, len(html or ""), digest(html), kind, None if kind == "response" else ref))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_tasks_that_run_again_leave_sound_archives(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(50)], "page_id long, url string, html string")
    folder = new_folder(spark, "test-warc")
    once, again = W.write(pages, folder), W.write(pages, folder)
    assert not {r.archive for r in once.collect()} & {r.archive for r in again.collect()}
    assert W.read(once, folder).count() == W.read(again, folder).count() == 50
