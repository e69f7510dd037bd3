import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitewright.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello, world! <|endoftext|> naïve", "a" * 9000, "  \n\t x\r\n  y", "日本語 текст 🙂", "word " * 3000, "12345 67890", "same", "same"]


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_those_of_the_json_vocabulary():
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in TEXTS:
        assert packing.token_ids(text, RANKS).tolist() == ids_of(tokenizer, text)


def test_pieces_cover_documents_and_fit(spark):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = [(i, t, i) for i, t in enumerate(TEXTS)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int"), RANKS).collect()
    bins = {}
    for r in got:
        ids = np.array(ids_of(tokenizer, TEXTS[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    for i, text in enumerate(TEXTS):
        mine = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == i)
        total = len(ids_of(tokenizer, text))
        assert [p for p, _, _ in mine] == list(range(-(-total // 1024))) and sum(n for _, _, n in mine) == total and all(n == 1024 for _, _, n in mine[1:])
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_search_never_worsens_best_fit(seed):
    lengths = np.random.default_rng(seed).integers(1, 700, 400).tolist()
    first = packing.best_fit(lengths, 1024)
    better = packing.improve(first, lengths, 1024)
    assert sorted(i for b in better for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 1024 for b in better)
    assert -(-sum(lengths) // 1024) <= len(better) <= len(first)


def test_exchange_empties_a_bin():
    lengths = [6, 4, 5, 5, 7, 3]
    assert len(packing.improve([[0, 5], [1, 2], [3], [4]], lengths, 10)) == 3


def test_early_positions_come_in_early_sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "word " * int(n), float(at)) for i, (n, at) in enumerate(zip(rng.integers(1, 1500, 400), rng.permutation(400), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, position double").repartition(7)
    got = packing.pack_documents(docs, RANKS, group_size=50, order_col="position").collect()
    assert {r.doc_id for r in got} == set(range(400)) and all(r.position == rows[r.doc_id][2] for r in got)
    ranked = sorted(got, key=lambda r: (r.position, r.doc_id, r.piece))
    shorts = np.cumsum([r.length < 1024 for r in ranked])
    bins = {}
    for n, r in enumerate(ranked):
        bins.setdefault(r.sequence_id, []).append((n, (shorts[n] - 1) // 50, r))
    for number, members in bins.items():
        assert number == members[0][0] and sum(r.length for *_, r in members) <= 1024  # a sequence's first piece numbers it
        assert len({group for _, group, _ in members}) == 1  # and none reaches beyond its range
        ends = sorted((r.offset, r.offset + r.length) for *_, r in members)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
