"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

The shingles of a text are its runs of five words, weighed by how often they occur. In a sketch of m registers, every
shingle sends arrivals of a Poisson process, at a rate of its weight, to random registers; a register keeps the shingle
of the first arrival. Two sketches agree in a register with the probability Jaccard similarity of the texts. A shingle
stops when its next arrival would come after the latest first arrival of all registers, so most send one or two.

Candidates share a band of registers. Within a band's bucket every text is compared, exactly, with the bucket's leader
only: the text that shares most buckets with most others, so that a group of copies has one leader for most of its
buckets. Where texts of a bucket are still unconnected, they are dealt anew by what sets each apart: two texts that both
differ from one thing are alike only if they share much of those differences, which chance does not bring about, so
sketches of the differences part them sharply. That thing is the leader where few texts are left with it. Where many are,
it is their consensus, the runs of words that most of them have: a leader's own oddities would set all others apart from it
in the same way and keep them together. The text nearest to the consensus is compared with all, which connects those that
lie around it. Small buckets of differences are compared pair by pair where sizes, distances and sketches allow a link;
larger ones are parted again, by a consensus of their own, until none is left. Nothing is capped: a bucket that its
consensus does not part is compared pair by pair in the end, but its texts then share their oddities, so most are linked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import salted_join, small_batches, written

M64 = (1 << 64) - 1
#: Odd factors of the words of a shingle, by place.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """64-bit hashes of words; emptied when large, so that a task's memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h


_WORDS = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted and distinct; counts) of a text's runs of ``words`` words, lower case, split at white space.

    A text of fewer words is one shingle; an empty one has none.
    """
    tokens = (text or "").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _FACTORS[i % len(_FACTORS)]
    return np.unique(mix(out), return_counts=True)


def sketch(hashes: np.ndarray, weights: np.ndarray, registers: int = 128) -> np.ndarray:
    """The shingle (a 64-bit number) that comes first in each register; zeros for no shingles. ``registers``: a power of 2."""
    out = np.zeros(registers, np.uint64)
    if not len(hashes):
        return out
    first = np.full(registers, np.inf)
    ids, rate, at = hashes, weights.astype(np.float64), np.zeros(len(hashes))
    k = 0
    while len(ids):
        k += 1
        draw = mix(ids + np.uint64(k * 0x9E3779B97F4A7C15 & M64))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        register = (draw & np.uint64(registers - 1)).astype(np.intp)
        sooner = np.flatnonzero(at < first[register])
        order = sooner[at[sooner].argsort()[::-1]]  # of several arrivals in a register, the first is assigned last
        where = register[order]
        first[where], out[where] = at[order], ids[order]
        on = at < first.max()
        if not on.all():
            ids, rate, at = ids[on], rate[on], at[on]
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i). Two empty texts: 1.

    With all weights equal it is the Jaccard similarity.
    """
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = ca[ia].astype(np.float64), cb[ib].astype(np.float64)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    r, below = ratio[order], np.concatenate([[0.0], np.cumsum(y[order])])
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    at = np.searchsorted(r, ratio, "left")
    return float((x / (only_a + ratio * only_b + above[at] + ratio * below[at])).sum())


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, content`` (equal for equal words in equal order) and ``bands``, an array of bucket numbers."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, buckets = [], []
            for text in pdf["text"]:
                h, c = shingles(text, words)
                whole = blake2b(" ".join((text or "").lower().split()).encode("utf-8", "replace"), digest_size=16)
                content.append(whole.hexdigest())
                s = sketch(h, c, bands * rows).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for i in range(rows):
                    key = mix(key * _GOLD + s[:, i])
                buckets.append(key.view(np.int64).tolist() if len(h) else [])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": content, "bands": buckets})

    return docs.select("doc_id", "text").mapInPandas(made, "doc_id long, content string, bands array<long>")


#: A text's differences from a leader: a sketch of ``REGISTERS``, of which ``BANDS`` pairs make buckets; all of them, by
#: four bits each, 16 to a long, tell how much of their differences two texts share.
REGISTERS, BANDS = 128, 48


def bands_of(apart: int, weight: int, similarity: float = 0.8) -> int:
    """How many bands a text needs whose differences are ``apart`` of its ``weight``.

    A text alike to it shares at least 1 - d weight / apart of both their differences (as similarity of sets, where its own
    are the more; d is 2/7 at 0.8): the further both are from the leader, the surer a band meets. With these a link is
    missed once in 10,000; the nearest texts, for which no number would do, have all ``BANDS``.
    """
    c = (1 - similarity) / similarity
    share = 2 * c / (2 + c)
    least = 1 - share / (1 - share) * weight / apart if apart else 1.0
    return BANDS if least <= 0.1 else int(min(BANDS, max(4, np.ceil(np.log(1e-4) / np.log1p(-min(least, 0.999) ** 2)))))


def difference_marks(only: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the first ``bands``, registers by four bits) of a set of shingles; one key for an empty set."""
    s = sketch(only, np.ones(len(only)), REGISTERS)
    nibbles = (mix(s) & np.uint64(15)).reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))
    keys = mix(s[0 : 2 * bands : 2] * _GOLD + s[1 : 2 * bands : 2]) if len(only) else np.zeros(1, np.uint64)
    return keys.view(np.int64), np.bitwise_or.reduce(nibbles, axis=1).view(np.int64)


def _compared(pairs: DataFrame, texts: DataFrame, words: int, marks: bool = False, similarity: float = 0.8) -> DataFrame:
    """``pairs(a, b)`` with their exact ``similarity``; each text is sent to its pairs, no more.

    With ``marks``, also ``apart``, the number of shingles that only one of the two has; ``weight``, the number of runs
    of words of b; and ``keys, nibbles``, the marks of those shingles.
    """
    pairs = written(pairs, "pairs")
    pairs = pairs.repartition(pairs.count() // 500 + 1, "a", "b")  # so that few bytes of ids still make many tasks
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = both.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for pdf in batches:
            out, apart, weight, keys, nibbles = [], [], [], [], []
            for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if last != a:
                    last, mine = a, shingles(ta, words)
                other = shingles(tb, words)
                out.append(probability_jaccard(mine, other))
                if marks:
                    only = np.setxor1d(mine[0], other[0], assume_unique=True)
                    apart.append(len(only))
                    weight.append(int(other[1].sum()))
                    of = difference_marks(only, bands_of(len(only), weight[-1], similarity))
                    keys.append(of[0])
                    nibbles.append(of[1])
            more = {"apart": apart, "weight": weight, "keys": keys, "nibbles": nibbles} if marks else {}
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": out, **more})

    kinds = ", apart long, weight long, keys array<long>, nibbles array<long>" if marks else ""
    return both.select("a", "b", "text_a", "text_b").mapInPandas(compared, f"a long, b long, similarity double{kinds}")


def _led(dealt: DataFrame, scope: list[str]) -> DataFrame:
    """``dealt(bucket, rep, n, *scope)`` with ``lead``: in each bucket of n texts the one whose buckets of that scope hold
    most texts together, the smallest of such."""
    central = dealt.groupBy(*scope, "rep").agg(F.sum("n").alias("central"))
    ranked = dealt.join(central, [*scope, "rep"])
    leads = ranked.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("rep")).alias("small"))).alias("best"))
    # written first: a join whose sides are plain shuffles can be split at a hot bucket
    return dealt.join(written(leads.select("bucket", (-F.col("best.small")).alias("lead")), "leads"), "bucket")


#: Texts that a consensus is taken from. It is a thing to compare with, and any would be right: more make it sharper.
VOICES = 15


def consensus(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that more than half of some texts have, with the median of their counts there."""
    sets = [shingles(t, words) for t in texts]
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets])
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    found, first, many = np.unique(h, return_index=True, return_counts=True)
    kept = 2 * many > len(sets)
    return found[kept], c[first[kept] + many[kept] // 2]


def _from_consensus(crowd: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``scope, rep, distance, apart, weight, keys, nibbles`` of ``crowd(scope, rep)`` as seen from the scopes' consensus.

    Its ``VOICES`` are those whose ids hash lowest; a scope's consensus is one row, sent to the texts of a large scope in
    salted parts.
    """
    first = Window.partitionBy("scope").orderBy(F.xxhash64("rep", "scope"), "rep")
    voices = crowd.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= VOICES).select("scope", F.col("rep").alias("doc_id"))
    kind = "scope long, hashes array<long>, counts array<long>"

    def agreed(pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = consensus(pdf["text"].tolist(), words)
        return pd.DataFrame({"scope": [pdf["scope"].iloc[0]], "hashes": [h.view(np.int64)], "counts": [c]})

    middle = written(voices.join(texts, "doc_id").groupBy("scope").applyInPandas(agreed, kind), "consensus")
    with_text = crowd.select("scope", "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    seen = salted_join(with_text, middle, "scope", by="rep")
    seen = seen.repartition(crowd.count() // 500 + 1, "rep", "scope")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, h, c in zip(pdf["text"], pdf["hashes"], pdf["counts"], strict=True):
                other, own = (np.asarray(h, np.int64).view(np.uint64), np.asarray(c, np.int64)), shingles(text, words)
                only, weight = np.setxor1d(other[0], own[0], assume_unique=True), int(own[1].sum())
                out.append((1 - probability_jaccard(other, own), len(only), weight, *difference_marks(only, bands_of(len(only), weight, similarity))))
            rows = pd.DataFrame(out, columns=["distance", "apart", "weight", "keys", "nibbles"])
            yield pd.concat([pdf[["scope", "rep"]].reset_index(drop=True), rows], axis=1)

    return seen.mapInPandas(measured, "scope long, rep long, distance double, apart long, weight long, keys array<long>, nibbles array<long>")


def _rooted(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """``open_(scope, rep, ..)`` with ``root``, of the scopes whose texts lie in several components."""
    placed = open_.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = placed.groupBy("scope").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("scope")
    # dealt evenly by text, as each becomes a row a band: a large scope's texts would else be together
    return salted_join(placed, several, "scope", by="rep").repartition("rep", "scope")


def _unlike(x: Column, y: Column) -> Column:
    """How many of 16 groups of four bits differ."""
    z = x.bitwiseXOR(y)
    any_bit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
    return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))


def _crossing(dealt: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of a bucket in different components that may be ``similarity`` alike.

    Two texts that are so have at most 2c / (2 + c) of the greater weight in shingles that only one has, c being
    (1 - similarity) / similarity. Those are the differences from the leader that they do not share, so the sizes of
    the differences give the least share of them in common; pairs whose marks show far less (five standard errors)
    are out. So are pairs whose distances to the leader differ by more than 1 - similarity.
    """
    c = (1 - similarity) / similarity
    one = dealt.select("bucket", *[F.col(x).alias(f"{x}_a") for x in ("rep", "root", "distance", "apart", "weight", "nibbles")])
    differ = F.col("apart") + F.col("apart_a")
    unshared = F.least(differ.cast("double"), F.greatest("weight", "weight_a") * (2 * c / (2 + c)))
    least = F.coalesce(F.try_divide(differ - unshared, differ + unshared), F.lit(0.0))
    expected = least + (1 - least) / 16  # four bits agree by chance once in 16
    same = 1 - F.aggregate(F.zip_with("nibbles", "nibbles_a", _unlike), F.lit(0), lambda n, x: n + x) / REGISTERS
    allowed = (F.abs(F.col("distance") - F.col("distance_a")) <= 1 - similarity + 1e-9) & (same >= expected - 5 * F.sqrt(F.greatest(expected * (1 - expected), F.lit(0.01)) / REGISTERS))
    met = one.join(dealt, "bucket").filter((F.col("root_a") < F.col("root")) & allowed)
    return met.select(F.least("rep_a", "rep").alias("a"), F.greatest("rep_a", "rep").alias("b")).distinct()


def _sized(dealt: DataFrame) -> DataFrame:
    """``dealt(bucket, root, ..)`` with ``n``, the texts of the bucket; only buckets of several components."""
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    sizes = written(sizes.filter("r0 <> r1").drop("r0", "r1"), "sizes")
    return written(dealt.join(sizes, "bucket"), "apart")


def _by_differences(open_: DataFrame, small: int, split: int = 8) -> tuple[DataFrame, DataFrame]:
    """Buckets by what sets the texts of a scope apart from its leader: (those of up to ``small`` texts, larger ones).

    A bucket shares two registers of the sketches; a larger one is split by four bits of a third, in ``split`` ways.
    """
    about = ["scope", "rep", "root", "distance", "apart", "weight", "nibbles"]
    dealt = _sized(open_.select(*about, F.posexplode("keys").alias("i", "k")).select(*about, F.xxhash64("scope", "i", "k").alias("bucket")))
    large = dealt.filter(F.col("n") > small).select(*about, "bucket", F.explode(F.array(*map(F.lit, range(split)))).alias("i"))
    at = F.pmod(F.col("bucket") + F.col("i") * 37, F.lit(REGISTERS))
    bits = F.call_function("shiftrightunsigned", F.get("nibbles", F.floor(at / 16).cast("int")), (at % 16 * 4).cast("int")).bitwiseAND(F.lit(15))
    finer = _sized(large.select(*about, F.xxhash64("bucket", "i", bits).alias("bucket")))
    return dealt.filter(F.col("n") <= small).unionByName(finer.filter(F.col("n") <= small)), finer.filter(F.col("n") > small)


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` after the links ``found`` as well."""
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b")
    ends = written(ends.distinct(), "joined")
    if ends.isEmpty():
        return roots
    return components(ends.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _linked(members: DataFrame, docs: DataFrame, words: int, similarity: float, small: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(``a, b``: verified links; ``node, root``: the components they make) of ``members(rep, bands)``."""
    dealt = members.select("rep", F.explode("bands").alias("bucket"))
    sizes = written(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    dealt = written(dealt.join(sizes, "bucket"), "buckets")  # only buckets of several texts
    texts = docs.join(dealt.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = written(texts, "texts")  # of texts with a candidate, once each
    pairs = _led(dealt, []).filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    made = written(_compared(pairs, texts, words, True, similarity), "led")
    alike = lambda pairs: pairs.filter(F.col("similarity") >= similarity).select("a", "b")
    links = alike(made)
    roots = components(links)
    about = ("scope", "rep", "distance", "apart", "weight", "keys", "nibbles")
    open_ = made.select(F.col("a").alias("scope"), F.col("b").alias("rep"), (1 - F.col("similarity")).alias("distance"), "apart", "weight", "keys", "nibbles")
    for level in range(rounds + 1):
        open_ = written(_rooted(open_.select(*about), roots), "open")
        if open_.isEmpty():
            break
        crowds = open_.groupBy("scope").agg(F.count("*").alias("_n")).filter(F.col("_n") > (0 if level else small)).select("scope")
        crowds = written(crowds, "crowds")
        if not crowds.isEmpty():
            crowd = written(salted_join(open_.select("scope", "rep"), crowds, "scope", by="rep"), "crowd")
            seen = written(_from_consensus(crowd, texts, words, similarity), "seen")
            nearest = written(seen.groupBy("scope").agg(F.min(F.struct("apart", "rep")).alias("b")).select("scope", F.col("b.rep").alias("lead")), "nearest")
            around = salted_join(seen.select("scope", "rep"), nearest, "scope", by="rep").filter("rep <> lead")
            around = around.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
            found = alike(written(_compared(around, texts, words), "around"))
            links = written(links.unionByName(found).distinct(), "links")
            roots = _joined(roots, found)
            rest = open_.select(*about).join(crowds, "scope", "left_anti")
            open_ = written(_rooted(rest.unionByName(seen.select(*about)), roots), "open")
            if open_.isEmpty():
                break
        few, many = _by_differences(open_, small)
        if level == rounds:
            few, many = few.unionByName(many), None
        found = alike(written(_compared(_crossing(few, similarity), texts, words), "crossed"))
        links = written(links.unionByName(found).distinct(), "links")
        roots = _joined(roots, found)
        if many is None or many.isEmpty():
            break
        # larger buckets that have one text in their middle are one scope; it is seen from its consensus
        led = _led(written(many, "many"), ["scope"]).select(F.xxhash64("scope", "lead").alias("scope"), "rep", "distance", "apart", "weight", "nibbles")
        open_ = led.dropDuplicates(["scope", "rep"]).withColumn("keys", F.lit(None).cast("array<long>"))
    return links, roots


#: Ids that stand for texts without one; greater than those of any row.
_NO_ID = 1 << 62


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` as a long; a row without an id gets one from its text, so that equal texts share it."""
    stand_in = F.lit(_NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1))
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), stand_in))


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 4, small: int = 128, rounds: int = 6
) -> DataFrame:
    """``doc_id, class_id, content_class, links`` of every row of ``docs``.

    ``class_id`` is the smallest id of the documents that chains of links connect; a link is a probability Jaccard of
    ``similarity`` or more between different texts. ``content_class`` is the smallest id with the same words, and
    ``links`` counts the links of that text that were verified (those that connect its class), not all. At 0.8 a pair
    misses all of 32 bands of 4 once in 10 million; a pair that only differences from a leader can bring together is
    found by up to ``BANDS`` bands of 2 registers of them. Buckets of differences of up to ``small`` texts are compared pair by
    pair, larger ones parted by their consensus, ``rounds`` times at most; what is then still open is compared pair by pair.

    Null and empty texts are one class. Texts of fewer than five words are one shingle. Rows that repeat come out each. Rows of one id that have several texts
    each get the class of their own text; which of them stands for the id in comparisons is not defined. Rows without an id take part by their text; a class of none but such has a null
    ``class_id``. Ids are below 2^62. An empty table gives no rows. Other columns play no part.
    """
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c)).alias(c)
    classes = _classes(_numbered(docs.select("doc_id", "text")), words, similarity, bands, rows, small, rounds)
    return classes.select(*map(known, ("doc_id", "class_id", "content_class")), "links")


def _classes(docs: DataFrame, words: int, similarity: float, bands: int, rows: int, small: int, rounds: int) -> DataFrame:
    """As ``near_duplicates``, of ``docs`` that all have ids, made up or not."""
    small_batches(docs.sparkSession)
    made = written(_sketches(docs, words, bands, rows), "sketches")
    members = written(made.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "contents")
    links, roots = _linked(members, docs, words, similarity, small, rounds)
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    classes = members.select("content", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
    classes = classes.select("content", F.col("rep").alias("content_class"), F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return made.select("doc_id", "content").join(classes, "content").select("doc_id", "class_id", "content_class", "links")


def first_of_class(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 4, small: int = 128, rounds: int = 6
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; of rows that repeat such an id, one. Of a class of rows
    without an id one row stays, with its null id."""
    numbered = _numbered(docs.withColumn("__own_id", F.col("doc_id")))
    classes = _classes(numbered.select("doc_id", "text"), words, similarity, bands, rows, small, rounds)
    kept = classes.filter("doc_id = class_id").select("doc_id").distinct()
    return numbered.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("__own_id")).select(*docs.columns)
