"""Sharding, fill-in-the-middle and lexical search against plain versions of what they compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitewright.llm import fim as FIM
from sitewright.llm import lexical as L
from sitewright.llm import sharding as S
from sitewright.llm.shared import new_folder

ODD = [
    (1, "one line\nand another\nlast", "a", "b"), (2, "", None, None), (3, None, "x", None), (None, "no id\n", None, None), (5, "with <P> a mark", None, None),
    (6, "\n\n\n", None, None), (7, "ünï\ncödé \U0001f600\n" * 50, None, None), (8, "word " * 150_000, None, None), (9, "line\n" * 90_000 + "end<", None, None),
    (1, "one line\nand another\nlast", "a", "b"), (1, "another text of id 1", None, None), (None, "no id\n", None, None), (-4, "S>\n<P\n>M>\n<", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, rows that repeat, and columns named as the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string, shard string, block string").withColumnsRenamed({"block": "m"})


# --- sharding


def jump_by_the_book(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def key_of(doc_id: int) -> int:
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:16], 16)


def test_jumps_are_the_published_ones_and_only_enter_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    before = None
    for shards in (1, 2, 3, 8, 9, 100, 101):
        shard, leaves = S.jump(keys, shards)
        assert shard.tolist() == [jump_by_the_book(int(k), shards) for k in keys]
        assert (leaves > shards).all()
        if before is not None and shards == before[0] + 1:
            moved = shard != before[1]
            assert (shard[moved] == shards - 1).all() and (moved == (before[2] == shards)).all()
            assert abs(moved.mean() - 1 / shards) < 0.03
        before = shards, shard, leaves
    assert np.bincount(S.jump(keys, 8)[0]).min() > 3000 / 8 * 0.8
    with pytest.raises(ValueError):
        S.jump(keys, 0)


def test_shards_hold_every_row_once_and_slots_have_no_gap(spark, odd):
    got = S.sharded(odd, new_folder(spark, "t") + "/rows", 5).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            assert r.shard == jump_by_the_book(key_of(r.doc_id), 5) and r.grown_shard == jump_by_the_book(key_of(r.doc_id), 6)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert S.sharded(odd.limit(0), new_folder(spark, "t") + "/rows", 5).count() == 0


def test_a_hot_id_is_dealt_into_several_files(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "concat('text ', id) AS text")
    folder = new_folder(spark, "t") + "/rows"
    S.write(docs, folder, 4, 50)
    stored = S.read(spark, folder)
    hot = stored.filter("doc_id = 7").select("shard", "slot").collect()
    assert len({r.shard for r in hot}) == 1 and len(hot) == len({r.slot for r in hot}) > 1300
    files = spark.read.parquet(folder).filter("doc_id = 7").select("_metadata.file_name").distinct().count()
    assert files > 3
    for shard in range(4):
        own = sorted(r.slot for r in stored.filter(f"shard = {shard}").select("slot").collect())
        assert own == list(range(len(own)))


def test_appended_shards_take_only_rows_that_move(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    folder = new_folder(spark, "t") + "/rows"
    S.write(docs, folder, 4)
    files = lambda: set(r[0] for r in spark.read.parquet(folder).select("_metadata.file_path").distinct().collect())
    before = files()
    for shards in (4, 5):
        S.append_shard(spark, folder, shards)
    assert before < files() and all(re.search("_shard=[45]/", f) for f in files() - before)
    got = {(r.doc_id, r.text): r._shard for r in S.live(spark, folder, 6).collect()}
    assert got == {(i, f"text {i}"): jump_by_the_book(key_of(i), 6) for i in range(2000)}


# --- fill in the middle


def fim_by_the_book(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: [str(x) for x in r])


def fim_rows(rows):
    none = lambda x: None if x is None or x != x else int(x)
    return ordered((str(r.doc_id), r.n, r.form, none(r.prefix_chars), none(r.middle_chars), *r[5:]) for r in rows)


@pytest.mark.parametrize("rate", [100, 40])
def test_outputs_and_digests(spark, odd, rate):
    folder = new_folder(spark, "t")
    index = FIM.indexed(odd, folder)
    want = [(str(d), *fim_by_the_book(d, t, rate), t) for d, t, *_ in ODD]
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim_rows(FIM.outputs(index, folder, rate).collect()) == ordered(w[:6] for w in want)
    assert fim_rows(FIM.digests(index, folder, rate).collect()) == ordered((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert FIM.fill_in_middle(odd.limit(0)).count() == 0


@pytest.mark.parametrize("frame_chars", [1, 2, 3, 7, 1000])
def test_frames_of_any_size_give_the_same(spark, odd, frame_chars):
    small = odd.filter("length(coalesce(text, '')) < 3000")
    folder = new_folder(spark, "t")
    index = FIM.store(small, folder, frame_chars, archive_bytes=500).cache()
    assert index.select("archive").distinct().count() > 1
    want = ordered((str(d), *fim_by_the_book(d, t)[:4], sha(fim_by_the_book(d, t)[4]), sha(t)) for d, t, *_ in ODD if len(t or "") < 3000)
    assert fim_rows(FIM.digests(index, folder).collect()) == want
    index.unpersist()


def test_a_cut_decompresses_one_frame_only(spark, monkeypatch):
    text = "".join(f"line {i}\n" for i in range(20_000))
    folder = new_folder(spark, "t")
    row = FIM.store(spark.createDataFrame([(1, text)], "doc_id long, text string"), folder, 1000).first()
    stored = FIM.Stored(FIM.Source(folder), row.archive, row.offset, row.lengths, row.lines, row.chars, row.open)
    read = []
    monkeypatch.setattr(FIM.Source, "read", lambda self, *a, f=FIM.Source.read: read.append(a) or f(self, *a))
    assert stored.after(7777) == len("".join(f"line {i}\n" for i in range(7777)))
    assert len(read) == 1 and len(row.lengths) > 100


def test_marks_across_pieces_are_found():
    whole = "<S>suf<P<fix\n<P>pre<<M>mid>"
    for k in (1, 2, 3, 5, 100):
        pieces = [whole[i : i + k] for i in range(0, len(whole), k)]
        got = defaultdict(str)
        for mark, text in FIM.sections(pieces):
            got[mark] += text
        assert {m: t for m, t in got.items() if t} == {"<S>": "suf<P<fix\n", "<P>": "pre<", "<M>": "mid>"}
        assert "".join(FIM.restored(lambda p=pieces: iter(p), "spm")) == "pre<mid>suf<P<fix\n"


# --- lexical search


def search_by_the_book(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, df = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for i, of in wanted.items():
        found = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * len(bags)) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in of & b.keys())
            found += [(-s, d is None, d or 0)] * (s > 0)
        out += [(i, n + 1, None if gone else d, -s) for n, (s, gone, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def drawn_texts(rng, count):
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "日本", "ß"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(1, 120), p=weights / weights.sum())) for _ in range(count)]


@pytest.mark.parametrize("first", [1, 16])
def test_ranks_equal_scoring_every_document(spark, first):
    rng = np.random.default_rng(4)
    texts = drawn_texts(rng, 300)
    docs = [(n * 3 % 307, t.upper() if n % 7 == 0 else t) for n, t in enumerate(texts)]
    docs += [(1000 + n, texts[5]) for n in range(60)] + [(2000, None), (2001, ""), (2002, "... !"), (None, texts[9]), (None, texts[9]), (1000, texts[5]), (3000, "w1 " * 60_000)]
    items = [(n, t) for n, t in enumerate(drawn_texts(rng, 25))] + [(50, texts[5]), (51, "w1 W1 w2"), (52, None), (53, ""), (54, "nowhere"), (55, "w299"), (50, texts[5]), (56, "a b"), (None, "w3 w4")]
    spread = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, m string, block int").repartition(7)
    index = L.build(spread, block_words=400, task_words=2000)
    assert index.blocks.count() > 60
    got = L.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, first, 4, batch_pairs=300).collect()
    assert sorted(map(tuple, got), key=str) == search_by_the_book(docs, items)


def test_strata_that_cannot_matter_are_not_visited(spark, monkeypatch):
    docs = [(n, "common " * (1 + n % 90) + "word") for n in range(900)] + [(5000 + n, "rare pair of words here") for n in range(12)]
    visited = []
    plain = L._visit
    monkeypatch.setattr(L, "_visit", lambda blocks, *a, **b: visited.append(blocks.select("m").distinct().count()) or plain(blocks, *a, **b))
    index = L.build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = L.search(index, spark.createDataFrame([(1, "rare pair words common")], "item_id long, text string"), 10, 2).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [5000 + n for n in range(10)]
    assert sum(visited) < index.blocks.select("m").distinct().count() / 4


def test_a_stratum_of_copies_is_dealt_into_blocks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text in every row' AS text")
    blocks = L.build(docs, block_words=600).blocks
    sizes = [r[0] for r in blocks.selectExpr("size(docs)").collect()]
    assert blocks.select("m").distinct().count() == 1 and sum(sizes) == 3000 and max(sizes) <= 130


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.rank(docs.limit(0), items).count() == 0
    assert L.rank(docs, items.limit(0)).count() == 0
    assert L.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_crc_and_sizes_of_the_query(spark):
    from sitewright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_sharding"](spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
