"""Ranked lexical search over a length-stratified index.

The documents whose length normaliser m is equal are a stratum. A stratum is stored in blocks of a bounded number of words;
a block has postings by term and, within a term, by how often it occurs (tf), so that an impact, which rests on term, tf
and m alone, is computed once for all documents of a run. The greatest tf of a term in a stratum bounds what the term can
give there: the sum of these bounds orders the strata of an item, and those that cannot reach the item's k-th score by then
are never visited. All sums are exact in 64 bits, so the result is that of scoring every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import short_batches, written

#: Bytes of terms: digits, letters, of which capital ones are taken as small, and all of code points beyond ASCII.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed values of the score: scale of impacts, weight of a term's count, share of the normaliser, and its base.
SCALE, PER_TF, PER_M, SPAN, BASE = 1_000_000_000, 1000, 8, 90, 100


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: maximal runs of digits, letters and code points beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


@F.pandas_udf(LongType())
def _length(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(terms_of(t)), na_action=None)


@dataclass
class Index:
    """``blocks(m, block, docs, terms, group_ends, tfs, ends, postings)``; documents with a term, and all their terms.

    Of a block, ``terms`` are sorted; term i has the groups up to ``group_ends[i]``, each of one tf; group j has the
    postings up to ``ends[j]``, which are places in ``docs``.
    """

    blocks: DataFrame
    documents: int
    words: int


_BLOCK = "m long, docs array<long>, terms array<string>, group_ends array<int>, tfs array<int>, ends array<int>, postings array<int>"
_NO_ID = np.iinfo(np.int64).max


def _block(table: pa.Table) -> pa.Table:
    """The block of ``table(m, doc_id, text)``."""
    ids = table["doc_id"].combine_chunks().cast(pa.int64())
    own = np.asarray(ids.fill_null(_NO_ID))
    order = np.argsort(own, kind="stable")
    number: dict[bytes, int] = {}
    words, counts, docs = [], [], []
    texts = table["text"]
    for place, row in enumerate(order.tolist()):
        found = Counter(terms_of(texts[row].as_py()))
        words.extend([number.setdefault(t, len(number)) for t in found])
        counts.extend(found.values())
        docs.append((place, len(found)))
    vocabulary = sorted(number)
    rank = np.empty(len(number), np.int64)
    rank[[number[t] for t in vocabulary]] = np.arange(len(vocabulary))
    term, tf = rank[np.array(words, np.int64)], np.array(counts, np.int64)
    doc = np.repeat([d for d, _ in docs], [n for _, n in docs])
    by = np.lexsort((doc, tf, term))
    term, tf, doc = term[by], tf[by], doc[by]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    ends = np.concatenate([new[1:], [len(term)]])
    group_ends = np.searchsorted(term[new], np.arange(len(vocabulary)), "right")
    listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    names = pa.array(vocabulary, pa.binary()).cast(pa.string())
    return pa.table(
        {
            "m": table["m"].slice(0, 1).combine_chunks(),
            "docs": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order))),
            "terms": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
            "group_ends": listed(group_ends, pa.int32()),
            "tfs": listed(tf[new], pa.int32()),
            "ends": listed(ends, pa.int32()),
            "postings": listed(doc, pa.int32()),
        }
    )


def build(docs: DataFrame, block_words: int = 1 << 17, block_docs: int = 2048, task_words: int = 1 << 22) -> Index:
    """Index every row of ``docs(doc_id, text)`` that has a term, over whole texts.

    A block takes about ``block_words`` words and ``block_docs`` documents of one stratum at most, or one document that is longer; rows are dealt to the blocks
    of their stratum in turn, so that no stratum, however many copies it holds, is together in one task.
    """
    short_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    lengths = written(own.select(_length("text").alias("n")).groupBy("n").agg(F.count("*").alias("rows")).filter("n > 0"), "lengths")
    documents, words = lengths.agg(F.sum("rows"), F.sum(F.col("n") * F.col("rows"))).first()
    if not documents:
        return Index(docs.sparkSession.createDataFrame([], _BLOCK), 0, 0)
    # in decimals, as 90 n N outgrows 64 bits where tables are very large
    m = (F.lit(BASE - SPAN) + F.expr(f"(cast({SPAN * documents} as decimal(19, 0)) * cast(n as decimal(12, 0))) div cast({words} as decimal(19, 0))")).cast("long")
    lengths = lengths.withColumn("m", m)
    strata = lengths.groupBy("m").agg(F.ceil(F.greatest(F.sum(F.col("n") * F.col("rows")) / block_words, F.sum("rows") / block_docs)).alias("blocks"))
    strata = written(lengths.join(strata, "m").select("n", "m", "blocks"), "strata")  # a row for each length that occurs
    dealt = own.withColumn("n", _length("text")).join(strata, "n")
    dealt = dealt.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")))
    tasks = max(int(words) // task_words + 1, docs.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.select("m", "block", F.col("doc_id").cast("long"), "text").repartition(tasks, "m", "block")
    made = dealt.groupBy("m", "block").applyInArrow(_block, _BLOCK)
    # small row groups, as a reader takes the rows of a group at once and a block is a long row
    return Index(written(made, "blocks", **{"parquet.block.size": 8 << 20}), int(documents), int(words))


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which span, place) of every place in the spans."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - starts, n)


def _within(ends: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(i > 0, ends[i - 1], 0), ends[i]


def _first_k(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` first of their item: highest scores, then smallest ids."""
    order = np.lexsort((doc, -score, item))
    new = np.concatenate([[True], item[order][1:] != item[order][:-1]]) if len(order) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - begun < k]


@dataclass
class Terms:
    """The terms of a set of items: pairs of item and term by number, a weight a pair, and the terms themselves."""

    names: list[str]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def found(self, block_terms: pa.Array) -> np.ndarray:
        """The place of each term in a block's, -1 where it is not."""
        at = pc.index_in(pa.array(self.names, pa.string()), value_set=block_terms)
        return np.asarray(at.fill_null(-1))


def impact(tf: np.ndarray, m) -> np.ndarray:
    return SCALE * tf // (PER_TF * tf + PER_M * m)


def _scored(terms: Terms, m: int, row: dict[str, np.ndarray], found: np.ndarray, items: np.ndarray, least: np.ndarray, k: int):
    """(item, place in the block, score) of the ``k`` first documents of a block for each of ``items``, of ``least`` at least."""
    slot = np.full(len(least), -1)
    slot[items] = np.arange(len(items))
    pairs = np.flatnonzero((slot[terms.item] >= 0) & (found[terms.term] >= 0))
    if not len(pairs):
        return (np.zeros(0, np.int64),) * 3
    each = impact(row["tfs"].astype(np.int64), m)  # once a run of equal tf
    of, group = _spans(*_within(row["group_ends"], found[terms.term[pairs]]))
    gain = terms.weight[pairs][of] * each[group]
    at, posting = _spans(*_within(row["ends"], group))
    size = len(row["docs"])
    sums = np.zeros(len(items) * size, np.int64)
    np.add.at(sums, slot[terms.item[pairs]][of][at] * size + row["postings"][posting], gain[at])
    sums = sums.reshape(len(items), size)
    who, place = np.nonzero(sums >= np.maximum(least[items], 1)[:, None])
    score = sums[who, place]
    best = _first_k(who, place, score, k)
    return items[who[best]], place[best], score[best]


def _visit(blocks: DataFrame, terms: Terms, least: np.ndarray, k: int, together: int = 32, keep: int = 50_000) -> DataFrame:
    """``item, doc_id, score``: each task's ``k`` first documents of ``blocks(.., items)`` for the block's items."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_least = least.copy()
        item, doc, score, held = [], [], [], 0

        def reduced():
            i, d, s = np.concatenate(item), np.concatenate(doc), np.concatenate(score)
            best = _first_k(i, d, s, k)
            i, d, s = i[best], d[best], s[best]
            ends = np.flatnonzero(np.bincount(i, minlength=len(own_least)) >= k)
            for which in ends.tolist():  # an item with k documents takes none below the last of them
                own_least[which] = max(own_least[which], s[i == which].min())
            return [i], [d], [s], len(i)

        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: np.asarray(batch.column(c)[n].values) for c in ("group_ends", "tfs", "ends", "postings", "items")}
                docs = batch.column("docs")[n].values
                row["docs"] = np.asarray(docs.fill_null(_NO_ID))
                found = terms.found(batch.column("terms")[n].values)
                for a in range(0, len(row["items"]), together):
                    i, place, s = _scored(terms, batch.column("m")[n].as_py(), row, found, row["items"][a : a + together], own_least, k)
                    item.append(i)
                    doc.append(row["docs"][place])
                    score.append(s)
                    held += len(i)
                if held > keep:
                    item, doc, score, held = reduced()
        if held:
            item, doc, score, held = reduced()
            gone = doc[0] == _NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(item[0], pa.int32()), pa.array(doc[0], pa.int64(), mask=gone), pa.array(score[0], pa.int64())], ["item", "doc_id", "score"])

    used = blocks.select("m", "docs", "terms", "group_ends", "tfs", "ends", "postings", "items")
    return used.mapInArrow(scored, "item int, doc_id long, score long")


def _tops(index: Index, names: list[str]) -> DataFrame:
    """``term, m, top, df`` of the terms ``names``: the greatest tf in a stratum, and the documents there that hold it."""
    listed = pa.array(names, pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            for n in range(batch.num_rows):
                found = np.asarray(pc.index_in(listed, value_set=batch.column("terms")[n].values).fill_null(-1))
                here = np.flatnonzero(found >= 0)
                groups, tfs, ends = (np.asarray(batch.column(c)[n].values) for c in ("group_ends", "tfs", "ends"))
                first, last = _within(groups, found[here])
                begun = np.where(first > 0, ends[first - 1], 0)
                for column, x in zip(out, (here, np.full(len(here), batch.column("m")[n].as_py()), tfs[last - 1], ends[last - 1] - begun), strict=True):
                    column.append(x)
            if batch.num_rows:
                columns = [pa.array(np.concatenate(x), kind) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "m", "top", "df"])

    each = index.blocks.select("m", "terms", "group_ends", "tfs", "ends").mapInArrow(read, "term int, m long, top int, df long")
    return written(each.groupBy("term", "m").agg(F.max("top").alias("top"), F.sum("df").alias("df")), "tops")


def _batch(index: Index, wanted: list, k: int, first: int, growth: int) -> DataFrame:
    """``item, doc_id, score`` of the ``k`` best of each item of ``wanted``, pairs of an item's number and its terms."""
    spark = index.blocks.sparkSession
    names = sorted({t for _, of in wanted for t in of})
    number = {t: i for i, t in enumerate(names)}
    tops = _tops(index, names)
    df = np.zeros(len(names), np.int64)
    for r in tops.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the items
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    item = np.repeat(np.arange(len(wanted)), [len(of) for _, of in wanted])
    term = np.array([number[t] for _, of in wanted for t in of], np.int64)
    terms = Terms(names, item, term, weights[term])
    pairs = spark.createDataFrame(pd.DataFrame({"item": item, "term": term, "weight": terms.weight}), "item int, term int, weight long")
    gain = F.expr(f"weight * (({SCALE}L * top) div ({PER_TF} * top + {PER_M} * m))")
    bounds = tops.join(F.broadcast(pairs), "term").groupBy("item", "m").agg(F.sum(gain).alias("bound")).filter("bound > 0")
    # a row a stratum that holds a term, for each item; there are no more strata than lengths
    order = written(bounds.withColumn("nth", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "m"))), "order")
    best = spark.createDataFrame([], "item int, doc_id long, score long")
    least, low, high = np.zeros(len(wanted), np.int64), 0, first
    while True:
        worth = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(least)), "least": least}), "item int, least long")
        open_ = order.filter(F.col("nth") > low).join(F.broadcast(worth), "item").filter("bound >= least")
        if open_.isEmpty():
            break
        visits = written(open_.filter(F.col("nth") <= high).groupBy("m").agg(F.sort_array(F.collect_list("item")).alias("items")), "visits")
        made = best.unionByName(_visit(index.blocks.join(visits, "m"), terms, least, k))
        by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = written(made.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).drop("nth"), "best")
        for r in best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= k).collect():
            least[r["item"]] = r["last"]
        low, high = high, high * growth
    return best


def search(index: Index, items: DataFrame, k: int = 10, first: int = 16, growth: int = 32, batch_pairs: int = 100_000) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 of each item, all if fewer.

    ``items(item_id, text)`` are taken in batches of about ``batch_pairs`` pairs of item and term, each against the whole
    index: a batch's terms and least scores go to all tasks, and its size does not grow with the index. An item's terms
    are those of all rows of its id, once each. Of a batch, the ``first`` strata by bound are visited, then ``growth``
    times as many, and so on, until no stratum left can hold a document of the result. Equal scores are in the order of
    ids, rows without an id last; an id that occurs in several rows is a document for each. Items without a term, and
    items that no document shares a term with, have no rows.
    """
    spark = index.blocks.sparkSession
    short_batches(spark)
    kind = items.schema["item_id"].dataType.simpleString()

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({x.decode("utf-8", "replace") for x in terms_of(t)}), na_action=None)

    pairs = items.select("item_id", F.explode(listed("text")).alias("term")).distinct()
    sets = written(pairs.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "items")
    count = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = -(-int(count) // batch_pairs)
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for n in range(batches if index.documents else 0):
        own = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == n).collect()
        if own:
            best = _batch(index, [(r.item_id, r.terms) for r in own], k, first, growth)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item int, item_id {kind}")
            found = found.unionByName(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    by = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item_id", F.row_number().over(by).alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` of ``items`` in an index of all ``docs(doc_id, text)``. Null and empty texts have no terms; other columns
    play no part; an empty table on either side gives no rows."""
    return search(build(docs), items, k)
