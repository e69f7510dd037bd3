"""I-Match document fingerprints with randomised lexicons, with DataFrame functions only.

The lexicon is the terms whose document frequency lies in a band, counted over all documents. A text's distinct lexicon
terms, sorted, are hashed once for each of several random subsets of the lexicon; the hashes side by side are the
fingerprint. Small subsets survive larger edits. Two fingerprints are alike by the share of subsets, of those that hold
a term of either text, whose hashes agree.

Terms are 64-bit hashes. The lexicon reaches the tasks as one value: a bitmap of ``BITS`` bits, which rules out most other
terms, and the terms themselves in ``CELLS`` short lists, which decide. Its size has a bound that does not grow with the
corpus: a term is in at least the share ``low`` of the texts, so there are at most 1 / ``low`` times as many as the mean
text has distinct terms (2,000 times; 5 MB for 300 terms a text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BITS = 1 << 22
WORDS = BITS // 64
CELLS = 1 << 16

#: Random subsets of the lexicon as (power, number): two of a quarter of it (a power of 2 of a half), four of a 16th, ...
#: Those of one power share no term.
SUBSETS = ((2, 2), (4, 4), (6, 6), (8, 6), (9, 6))

TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct hashed terms: runs of letters and digits of the lower-case text, sorted."""
    parts = F.filter(F.split(F.lower(text), TERM), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda t: F.xxhash64(t))))


def bit_of(term: Column) -> Column:
    return F.shiftrightunsigned(term, 42)  # the upper 22 bits


def lexicon(texts: DataFrame, low: float = 0.0005, high: float = 0.25) -> DataFrame:
    """One row with ``lexicon``, a struct of ``bits``, a bitmap in ``WORDS`` longs, and ``cells``, the terms by their
    upper 16 bits: those in at least ``low`` and at most ``high`` of all texts. At least two texts must hold a term, so
    that a small corpus has no lexicon of one-off words.
    """
    held = texts.select(F.explode(terms(F.col("text"))).alias("term"))
    n = texts.agg(F.count("*").alias("n"))
    counted = held.groupBy("term").agg(F.count("*").alias("df"))
    share = F.col("df") / n.scalar()
    kept = counted.filter((F.col("df") >= 2) & (share >= low) & (share <= high))
    at = bit_of(F.col("term"))
    kept = written(kept.select("term"), "terms")
    words = kept.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    dense = lambda n, name, empty: texts.sparkSession.range(n).select(F.col("id").cast("int").alias(name), empty)
    bits = dense(WORDS, "word", F.lit(0).cast("long").alias("bit")).unionByName(words).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    cells = kept.groupBy(cell_of(F.col("term")).alias("cell")).agg(F.collect_list("term").alias("terms"))
    cells = dense(CELLS, "cell", F.lit(None).cast("array<long>").alias("terms")).unionByName(cells)
    cells = cells.groupBy("cell").agg(F.coalesce(F.first("terms", ignorenulls=True), F.array().cast("array<long>")).alias("terms"))
    listed = lambda df, key, value: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]).alias(value))
    return listed(bits, "word", "bit").select(F.struct(F.col("bit").alias("bits"), listed(cells, "cell", "terms").scalar().alias("cells")).alias("lexicon"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def cell_of(term: Column) -> Column:
    return F.shiftrightunsigned(term, 48).cast("int")


def fingerprint(text: Column, lexicon: Column) -> Column:
    """An array with a hash for each subset; null where the text has no lexicon term in it.

    ``lexicon`` is a column with what ``lexicon()`` gives.
    """
    marked = lambda t: F.getbit(F.element_at(lexicon.bits, (F.shiftrightunsigned(bit_of(t), 6) + 1).cast("int")), (bit_of(t) % 64).cast("int")) == 1
    known = F.filter(terms(text), lambda t: marked(t) & F.array_contains(F.element_at(lexicon.cells, cell_of(t) + 1), t))

    def cut(known: Column, power: int, number: int, shift: int) -> Column:
        """Hashes of the ``number`` subsets whose terms have one value in ``power`` bits of their hash."""
        value = lambda t: F.shiftright(t, shift).bitwiseAND(F.lit((1 << power) - 1))
        one = lambda within, k: let(F.filter(within, lambda t: value(t) == k), lambda inside: F.when(F.size(inside) > 0, F.xxhash64(inside)))
        return let(F.filter(known, lambda t: value(t) < number), lambda within: F.array(*[one(within, k) for k in range(number)]))

    shifts = [sum(power for power, _ in SUBSETS[:k]) for k in range(len(SUBSETS))]  # each power has bits of its own
    return let(known, lambda known: F.concat(*[cut(known, power, number, at) for (power, number), at in zip(SUBSETS, shifts, strict=True)]))


def shown(prints: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a subset, a dot for a null."""
    return F.array_join(F.transform(prints, lambda h: F.coalesce(F.lower(F.lpad(F.hex(F.shiftrightunsigned(h, 32)), 8, "0")), F.lit("."))), "-")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; two texts without any lexicon term are alike (1) only in having none."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    agree = F.size(F.filter(pairs, lambda p: p["a"].eqNullSafe(p["b"])))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(agree / F.size(pairs))


def with_next(docs: DataFrame, buckets: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs(doc_id, text, ..)`` with ``next``, a struct of the next row by id (ties by text, rows without an
    id last); after the last comes the first.

    Ids are cut at approximate quantiles into ranges of about ``range_bytes`` of text, a window each (at least four a
    shuffle partition, at most 65,536, since their bounds are part of the plan; a window spills what it can't hold); a
    range takes the first rows of the next one along, so that each text is shuffled once.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = min(65_536, max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes))
    cuts = [k / buckets for k in range(1, buckets)]
    row = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", cuts, 20 * buckets).alias("cuts")).first()
    if row.low is None:
        return docs.withColumn("next", F.struct(*docs.columns))
    firsts = sorted({row.low, *row.cuts})
    # bounds in rows of about the root of their number, so that a range is found in two short scans
    wide = max(1, int(len(firsts) ** 0.5))
    heads = F.array(*[F.lit(b) for b in firsts[::wide]])
    bounds = F.array(*[F.array(*[F.lit(b) for b in firsts[k : k + wide]]) for k in range(0, len(firsts), wide)])
    row_of = F.size(F.filter(heads, lambda b: b <= F.col("doc_id")))
    found = (row_of - 1) * wide + F.size(F.filter(F.get(bounds, row_of - 1), lambda b: b <= F.col("doc_id"))) - 1
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(firsts) - 1)).otherwise(found)
    before = F.when(bucket == 0, len(firsts) - 1).otherwise(bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("bucket"), F.lit(1).alias("guest"))
    is_first = F.array_contains(F.get(bounds, row_of - 1), F.col("doc_id"))
    dealt = docs.withColumn("at", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy("at.bucket").orderBy("at.guest", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*docs.columns)).over(w)).filter("at.guest = 0").select(*docs.columns, "next")


def compare_with_edits(docs: DataFrame, low: float = 0.0005, high: float = 0.25) -> DataFrame:
    """Fingerprints of every document and of an edited form of it: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edit replaces the last half (rounded down) of the code points by as many of the next document's first, or all it
    has. Null is empty. Of rows with one id the next is that with the next text; rows without an id come after all
    others, by text (where no row has one, each is its own next). An empty table gives no rows. Other columns of ``docs``
    play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = written(lexicon(docs, low, high), "lexicon").scalar()
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next.text", F.lit(1), half))
    # a text's own fingerprint is made once, before the shuffle, and is also what the one before it compares with
    own = docs.withColumn("lexicon", known).select("doc_id", "text", fingerprint(F.col("text"), F.col("lexicon")).alias("own"))
    both = with_next(own).withColumn("edited", edited).withColumn("lexicon", known)
    made = both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        F.col("next.own").alias("following"),
        fingerprint(F.col("edited"), F.col("lexicon")).alias("changed"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
