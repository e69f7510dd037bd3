"""A quality classifier learnt from trusted positives and unlabelled text (positive-unlabelled learning).

A small network is trained to minimise the non-negative unbiased risk: pi R_p+ + max(0, R_u- - pi R_p-), with pi the
share of good documents among the unlabelled ones. pi is estimated from the scores of a first fit: the smallest ratio,
over thresholds, of the unlabelled to the positive share above the threshold (with a margin for chance).

Scores come from the shape of a whole text alone: its bytes by class, which classes follow each other, and how words and
lines repeat. A bounded sample of the trusted documents reaches the driver, and a sample of all documents that a first
fit starts from. The means and deviations of the features, the prior and the risk that is minimised in the end are those of
all documents: tasks add up their parts of them, and the driver takes the step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Byte classes: lower, upper, digit, space, line end, sentence marks, brackets and quotes, other marks, other controls, beyond ASCII.
CLASSES = 10


def _byte_classes() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[128:] = 9
    table[33:127] = 7
    for n, letters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?!", b"()[]{}\"'`")):
        table[list(letters)] = n
    return table


_TABLE = _byte_classes()
WIDTH = CLASSES + CLASSES * CLASSES + 12


def features(text: str | None) -> np.ndarray:
    """``WIDTH`` numbers from a whole text; all zero for a null or empty one."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    kinds = _TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    n = len(kinds)
    out[:CLASSES] = np.bincount(kinds, minlength=CLASSES) / n
    if n > 1:
        follow = kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
        out[CLASSES : CLASSES + CLASSES * CLASSES] = np.bincount(follow, minlength=CLASSES * CLASSES) / (n - 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k = CLASSES + CLASSES * CLASSES
    if words:
        counts = Counter(words)
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        out[k] = len(counts) / m
        out[k + 1] = max(counts.values()) / m
        out[k + 2] = sum(map(str.__eq__, words, words[1:])) / m
        out[k + 3] = np.log1p(m) / 10
        out[k + 4] = lengths.mean() / 10
        out[k + 5] = lengths.std() / 10
        out[k + 6] = (lengths == 1).mean()
        out[k + 7] = min(1.0, len(counts) / (3 * np.sqrt(m)) / 5)
        out[k + 8] = sum(sorted(counts.values(), reverse=True)[:10]) / m
    if lines:
        seen = Counter(lines)
        out[k + 9] = sum(len(x) * (c - 1) for x, c in seen.items()) / len(text)
        out[k + 10] = len(lines) / max(1, len(words))
        out[k + 11] = np.mean([x.rstrip()[-1] in ".!?:\"'" for x in lines])
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps along gradients, scaled by their running moments."""

    def __init__(self, par: list[np.ndarray]):
        self.par, self.t = par, 0
        self.m, self.v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.par[i] = self.par[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def outputs(par: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, margins) of standardised rows."""
    h = np.maximum(x @ par[0] + par[1], 0)
    return h, h @ par[2] + par[3][0]


def gradients(par: list[np.ndarray], x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    """Of the parameters, from those of the margins, ``g``."""
    gh = np.outer(g, par[2]) * (h > 0)
    return [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, mean: np.ndarray, scale: np.ndarray, hidden: int = 24, epochs: int = 25, batch: int = 256, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Network:
    """Minimise the non-negative PU risk with logistic loss; with ``prior`` None, plain positives against unlabelled."""
    rng = np.random.default_rng(seed)
    p, u = (standard(x, mean, scale) for x in (positive, unlabelled))
    width = p.shape[1]
    adam = Adam([rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)])
    steps = max(1, len(u) // batch, 1500 // epochs)
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for k in range(steps):
            xu = u[order.take(range(k * batch, (k + 1) * batch), mode="wrap")]
            xp = p[rng.integers(0, len(p), batch)]
            x = np.vstack([xp, xu])
            h, z = outputs(adam.par, x)
            zp, zu = z[: len(xp)], z[len(xp) :]
            if prior is None:
                g = np.concatenate([-_sig(-zp) / len(xp), _sig(zu) / len(xu)])
            else:  # loss of a margin z: log(1+exp(-z)) as positive, log(1+exp(z)) as negative
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                as_negative = np.concatenate([-prior * _sig(zp) / len(xp), _sig(zu) / len(xu)])
                if negative >= 0:
                    g = as_negative + np.concatenate([-prior * _sig(-zp) / len(xp), np.zeros(len(xu))])
                else:
                    g = -as_negative
            grads = gradients(adam.par, x, h, g)
            grads[0] = grads[0] + decay * adam.par[0]
            grads[2] = grads[2] + decay * adam.par[2]
            adam.step(grads, rate * (1 - 0.9 * (adam.t + 1) / (epochs * steps)))
    par = adam.par
    return Network(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6).astype(np.float64)


def estimate_prior(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the shares of both above a row of cuts, of rows that the fit did not
    see."""
    slack = np.sqrt(np.log(2 / confidence) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row of ``docs``, written to the shared folder: ``WIDTH`` numbers of 32 bits."""
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [features(t).tobytes() for t in pdf["text"]]})

    rows = docs.select("doc_id", "text").mapInPandas(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")
    return written(rows, "features")


def matrix(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, WIDTH) if len(x) else np.zeros((0, WIDTH), np.float32)


def summed(rows: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], parts: int = 8) -> np.ndarray:
    """The sum over all rows of ``part``, ``size`` numbers of a batch of features. Tasks add up theirs, ``parts`` tasks add
    up those, and the driver adds ``parts`` rows."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(matrix(pdf["x"]).astype(np.float64))
        yield pd.DataFrame({"s": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            for s in pdf["s"]:
                total += np.frombuffer(s, np.float64)
        yield pd.DataFrame({"s": [total.tobytes()]})

    each = rows.select("x").mapInPandas(own, "s binary").repartition(parts).mapInPandas(added, "s binary")
    return np.sum([np.frombuffer(bytes(r.s), np.float64) for r in each.collect()], axis=0)


def refined(network: Network, rows: DataFrame, n: int, positive: np.ndarray, prior: float, rounds: int = 8, rate: float = 0.002, decay: float = 1e-4) -> Network:
    """The network after ``rounds`` steps along the gradient of the risk over all ``n`` rows of features."""
    adam = Adam([network.w1, network.b1, network.w2, np.array([network.b2])])
    xp = standard(positive, network.mean, network.scale)
    shapes = [x.shape for x in adam.par]
    ends = np.cumsum([x.size for x in adam.par])
    for k in range(rounds):
        par, mean, scale = adam.par, network.mean, network.scale

        def part(x: np.ndarray, par=par, mean=mean, scale=scale) -> np.ndarray:
            x = standard(x, mean, scale)
            h, z = outputs(par, x)
            return np.concatenate([[np.logaddexp(0, z).sum()], *(g.ravel() for g in gradients(par, x, h, _sig(z)))])

        total = summed(rows, 1 + int(ends[-1]), part) / n
        as_negative = [g.reshape(shape) for g, shape in zip(np.split(total[1:], ends[:-1]), shapes, strict=True)]
        h, zp = outputs(par, xp)
        if total[0] - prior * np.logaddexp(0, zp).mean() >= 0:
            grads = [a + b for a, b in zip(as_negative, gradients(par, xp, h, -prior * (_sig(zp) + _sig(-zp)) / len(xp)), strict=True)]
        else:
            grads = [b - a for a, b in zip(as_negative, gradients(par, xp, h, prior * _sig(zp) / len(xp)), strict=True)]
        grads[0] = grads[0] + decay * par[0]
        grads[2] = grads[2] + decay * par[2]
        adam.step(grads, rate * (1 - 0.9 * k / rounds))
    par = adam.par
    return Network(network.mean, network.scale, par[0], par[1], par[2], float(par[3][0]))


def unknown() -> Network:
    """What scores every document 1 / (1 + exp(-3)), that is 0.95."""
    return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 3.0)


def _first(rows: DataFrame, most: int, salt: str, n: int) -> np.ndarray:
    """Features of the ``most`` of ``n`` rows that a salted hash of their id puts first: the same in every run.

    Another hash first thins many rows to hardly more than ``most`` in all, so that tasks do not each send the driver as
    many; one in a hundred million times, and where rows repeat, there may be fewer.
    """
    draw = F.xxhash64(F.lit(salt), F.col("doc_id").cast("string"))
    share = (most + 6 * most**0.5) / max(1, n)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(salt + " thinned"), F.col("doc_id").cast("string"), "x"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return matrix(rows.select(draw.alias("draw"), "x").orderBy("draw", "x").limit(most).toPandas()["x"])


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = 8000, start_rows: int = 12000, trusted_below: float = 0.002, rounds: int = 8) -> tuple[Network, float]:
    """(network, prior) from at most ``max_positive`` documents with ``labels.quality`` 1, the trusted ones, and all
    documents, which are unlabelled.

    Of ``labels``, pass only the rows that may be learnt from. Rows labelled 0 teach nothing here: they are unlabelled. The
    prior comes from a fit on half of the trusted documents and half of at most ``start_rows`` others, scored on the other
    half of all documents (a single row is both halves). The network is first fitted to at most ``start_rows`` documents and
    then improved in ``rounds`` passes over all. Scores are shifted so that ``trusted_below`` of the trusted documents score
    under 0.5: an error in the prior moves all scores and would otherwise move the cut. Without a trusted document nothing
    can be learnt: every document scores 0.95, and the prior is 0.95.
    """
    rows = feature_rows(docs)
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    of_good = rows.join(good, "doc_id", "left_semi")
    trusted = _first(of_good, max_positive, "trusted", of_good.count())
    if not len(trusted):
        return unknown(), 0.95
    sums = summed(rows, 1 + 2 * WIDTH, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, mean = int(sums[0]), sums[1 : 1 + WIDTH] / sums[0]
    scale = np.sqrt(np.maximum(0, sums[1 + WIDTH :] / n - mean * mean)) + 1e-3
    start = _first(rows, start_rows, "unlabelled", n)

    # halves by what a row holds, so that tasks and driver part them alike and copies stay together
    seen = lambda x: np.frombuffer(np.ascontiguousarray(x, np.float32).tobytes(), np.uint32).reshape(-1, WIDTH).sum(1) % 2 == 0
    halves = lambda x: (x[seen(x)], x[~seen(x)]) if 0 < seen(x).sum() < len(x) else (x, x)
    (seen_p, other_p), (seen_u, other_u) = halves(trusted), halves(start)
    first = fit(seen_p, seen_u, None, mean, scale, epochs=10)
    scores = first.score(other_p)
    cuts = np.quantile(scores, np.linspace(0.01, 0.9, 90))
    parted = len(other_u) < len(start)

    def above(x: np.ndarray) -> np.ndarray:
        other = np.sort(first.score(x[~seen(x)] if parted else x))
        return np.concatenate([[len(other)], len(other) - np.searchsorted(other, cuts)])

    counts = summed(rows, 1 + len(cuts), above)
    above_p = 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)
    prior = estimate_prior(above_p, counts[1:] / counts[0], len(scores), int(counts[0]))
    network = refined(fit(trusted, start, prior, mean, scale), rows, n, trusted, prior, rounds)
    network.b2 -= float(np.quantile(network.margin(trusted), trusted_below))
    return network, prior


def score(docs: DataFrame, network: Network, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``, and the columns named in ``keep`` (text included).

    Null and empty texts score like any text, from features that are all zero. Rows that repeat score alike, each. An
    empty table gives no rows. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    net = spark.sparkContext.broadcast(network)  # a few thousand numbers
    fields = [docs.schema[c] for c in keep if c not in ("doc_id",)]
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    kept = [f.name for f in fields]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([features(t) for t in pdf["text"]]) if len(pdf) else np.zeros((0, WIDTH), np.float32)
            s = net.value.score(x.astype(np.float64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: pdf[c] for c in kept}, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    columns = list(dict.fromkeys(["doc_id", "text", *kept]))
    return docs.select(*columns).mapInPandas(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{kinds}, score double, predicted int")
