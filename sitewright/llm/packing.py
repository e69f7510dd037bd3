"""Best-fit packing of documents into fixed-length training sequences, improved by a swap-based local search.

Tokens are made once, in the tasks that read the documents. Full-length pieces are sequences by themselves; the shorter
ones, as numbers only, are dealt into groups of about ``group_size`` and each group is packed by best fit and then by
exchanges between underfull bins. Groups are independent, so the work scales out; each costs at most part of one bin.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

EOS = 2

_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """A byte-pair encoder from a file of ranks; kept per Python worker. The rank file holds the same vocabulary as the
    JSON file of the same name and gives the same ids, several times faster (tests compare them)."""
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )
    return _ENCODERS[ranks_path]


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    """Ids of a whole text (null: empty) and the end mark, as little-endian unsigned 32-bit numbers."""
    enc, text = encoder(ranks_path), text or ""
    ids = enc.encode(text, allowed_special="all") if "<|endoftext|>" in text else enc.encode_ordinary(text)
    ids.append(EOS)
    return np.array(ids, "<u4")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the open bin with the least room that is enough."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull bins.

    From the emptiest bin on, the best of three steps is taken while one raises the sum of squared fills: move a document
    into another bin, exchange one for one, exchange two for one. A bin without a step is tried again after others have
    changed; the search ends after a pass over all of them without a step. The sum is a
    whole number with a bound, so it does end. Bins that have become empty go.
    """
    size = np.asarray(lengths, np.int64)
    owner = np.zeros(len(size), np.int64)
    for n, b in enumerate(bins):
        owner[b] = n
    bins = [list(b) for b in bins]
    fill = np.bincount(owner, size, minlength=len(bins)).astype(np.int64)
    least = -(-int(size.sum()) // capacity)
    count = len(bins)
    stuck, changed = np.zeros(len(bins), bool), False
    while count > least:
        is_open = (fill > 0) & (fill < capacity)
        sources = np.flatnonzero(is_open & ~stuck)
        if not len(sources) and changed:
            stuck[:], changed = False, False
            continue
        if not len(sources) or is_open.sum() < 2:
            break
        source = int(sources[fill[sources].argmin()])
        is_open[source] = False
        taken = _best_step(bins[source], int(fill[source]), np.flatnonzero(is_open), np.flatnonzero(is_open[owner]), owner, fill, size, capacity)
        if taken is None:
            stuck[source] = True
            continue
        target, give, back = taken
        moved = int(size[give].sum() - size[back].sum())
        bins[source] = [i for i in bins[source] if i not in give] + back
        bins[target] = [i for i in bins[target] if i not in back] + give
        owner[give], owner[back] = target, source
        fill[source] -= moved
        fill[target] += moved
        count -= fill[source] == 0
        stuck[[source, target]], changed = False, True
    return [b for b in bins if b]


def _best_step(mine, own_fill, others, items, owner, fill, size, capacity):
    """(target, items given, items taken back) that raises the squared fill most, or None.

    Giving d more than comes back, to a bin filled f from one filled a, raises the sum by 2 d (f - a + d).
    """
    x = size[mine]
    i, j = np.triu_indices(len(mine), 1)
    gifts = np.concatenate([x, x[i] + x[j]])  # one document, or two
    best, step = 0, None
    for give, targets, returned in ((x, others, None), (gifts, owner[items], items)):
        f = fill[targets]
        d = give[:, None] if returned is None else give[:, None] - size[returned][None, :]
        gain = np.where((d > 0) & (d <= capacity - f), 2 * d * (f - own_fill + d), 0)
        g, t = divmod(int(gain.argmax()), gain.shape[1])
        if gain[g, t] > best:
            best = gain[g, t]
            given = [mine[g]] if g < len(mine) else [mine[i[g - len(mine)]], mine[j[g - len(mine)]]]
            step = (int(targets[t]), given, [] if returned is None else [int(returned[t])])
    return step


def pack_lengths(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for i in b:
            where[i], offset[i] = n, at
            at += lengths[i]
    return where, offset


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    max_tokens: int = 1024,
    group_size: int = 4096,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_col: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked, ``ids``.

    A document of up to ``max_tokens`` ids (its own and the end mark) is one piece. Of a longer one every piece but the
    first has ``max_tokens`` ids. Null and empty texts are the end mark alone. Rows that repeat, ids included, are each
    packed. An empty table gives no rows. Other columns of ``docs`` play no part, whatever their names.

    With ``order_col``, whose column then comes last, groups are ranges of that order instead of hashes, and sequence ids
    rise with it: a sequence's id is the rank, among all pieces, of its first one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    ids_type = ", ids array<long>" if with_ids else ""
    order_kind = docs.schema[order_col].dataType.simpleString() if order_col else "int"
    order = F.col(order_col) if order_col else F.lit(0)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            chunks = []
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = token_ids(text.as_py(), ranks_path)
                first = (len(ids) - 1) % max_tokens + 1
                starts = [0, *range(first, len(ids), max_tokens)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc, piece, a, b - a, zlib.crc32(ids[a:b]), (task << 33) + row, at))
                    row += 1
                    if with_ids:
                        chunks.append(ids[a:b])
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), batch.schema.field(2).type]
                columns = [c.cast(t) for c, t in zip(columns, types, strict=True)]
                names = ["doc", "piece", "start", "length", "crc", "item", "place"]
                if with_ids:
                    columns.append(pa.array(chunks, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    made = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), order.alias("place")).mapInArrow(
        pieces, f"doc {kind}, piece int, start long, length long, crc long, item long, place {order_kind}{ids_type}"
    )
    made = written(made, "pieces")
    if order_col:
        return _packed_in_order(made, max_tokens, group_size, id_col, order_col, with_ids)
    short = made.filter(F.col("length") < max_tokens).select("item", "length")
    groups = max(1, -(-short.count() // group_size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        where, offset = pack_lengths(pdf["length"].tolist(), max_tokens)
        return pd.DataFrame({"item": pdf["item"], "bin": where, "offset": offset, "grp": pdf["grp"]})

    placed = (
        short.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(pack, "item long, bin long, offset long, grp long")
        .select("item", (F.col("grp") * (2 * group_size) + F.col("bin")).alias("shared_bin"), "offset")
    )
    whole = [F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32")]
    tail = ["ids"] if with_ids else []
    full = made.filter(F.col("length") == max_tokens).select(
        *whole, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *tail
    )
    rest = made.filter(F.col("length") < max_tokens).join(placed, "item").select(*whole, F.col("shared_bin").alias("sequence_id"), "offset", *tail)
    return full.unionByName(rest)


def _packed_in_order(made: DataFrame, max_tokens: int, group_size: int, id_col: str, order_col: str, with_ids: bool) -> DataFrame:
    """Pieces packed in groups that are ranges of their order. Ranks are made in two steps: within range partitions, whose
    totals are then accumulated."""
    by_place = made.select("item", "length", "place", "doc", "piece").orderBy("place", "doc", "piece", "item")
    ranged = written(by_place.select("item", "length", F.monotonically_increasing_id().alias("nth")), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("nth", 33)).withColumn("short", (F.col("length") < max_tokens).cast("long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("short").alias("n_short"))
    ahead = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "n_short")])
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.withColumn("shorts", F.sum("short").over(within)).join(F.broadcast(ahead), "part").select(
        "item", "length", "short",
        (F.col("n_ahead") + F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"),
        F.expr(f"(n_short_ahead + shorts - 1) div {group_size}").alias("grp"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        where, offset = pack_lengths(pdf["length"].tolist(), max_tokens)
        first = pdf["rank"].groupby(where).transform("min")
        return pd.DataFrame({"item": pdf["item"], "sequence_id": first, "offset": offset})

    shorts = ranked.filter("short = 1").select("item", "length", "rank", "grp")
    placed = shorts.groupBy("grp").applyInPandas(pack, "item long, sequence_id long, offset long")
    full = ranked.filter("short = 0").select("item", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tail = ["ids"] if with_ids else []
    return made.join(placed.unionByName(full), "item").select(
        F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *tail, F.col("place").alias(order_col)
    )
