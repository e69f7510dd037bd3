"""Secret scans: plain patterns, and candidates scored by inferred grammars of credential formats.

A grammar is a probabilistic automaton made by state merging: labelled credentials form a prefix tree whose branches
carry counts, and states whose outgoing frequencies (and those of what follows) agree within a Hoeffding bound are
merged. A candidate's format likelihood under an automaton, against that of ordinary words under a background automaton
of letter classes, decides whether it is a secret, and of which format. All candidates are scored, those that plain patterns
touch too.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

# Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of 24 is the same as a run, if of 24
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = 8  # characters of a candidate
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
SEPARATORS = "=/."
#: An identifier that is no secret, however random.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
KINDS = ("assign", "access", "hex", "grammar")

ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
END = "$"


@dataclass
class State:
    """Counts of what strings do in a state: go on by a symbol, or end."""

    end: int = 0
    count: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    to: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.end + sum(self.count.values())


def classed(text: str) -> str:
    """Symbols of the automata: the first 6 characters as they are (formats differ in their prefixes), then classes."""
    return text[:6] + "".join("9" if c.isdigit() else "a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else c for c in text[6:])


def prefix_tree(samples: list[str]) -> list[State]:
    states = [State()]
    for sample in samples:
        at = 0
        for c in sample:
            s = states[at]
            s.count[c] += 1
            if c not in s.to:
                states.append(State())
                s.to[c] = len(states) - 1
            at = s.to[c]
        states[at].end += 1
    return states


def infer(samples: list[str], alpha: float = 0.05) -> list[State]:
    """A probabilistic automaton: prefix-tree states are merged, in breadth-first order, with the first compatible one."""
    states = prefix_tree(samples)
    margin = math.sqrt(math.log(2 / alpha) / 2)

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > margin * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            s, t = states[p], states[q]
            n1, n2 = s.total, t.total
            if not n1 or not n2:
                continue
            if differ(s.end, n1, t.end, n2) or any(differ(s.count.get(c, 0), n1, t.count.get(c, 0), n2) for c in s.count.keys() | t.count.keys()):
                return False
            # a state seen once never differs by the bound, nor does what follows it
            todo += [(s.to[c], t.to[c]) for c in s.to.keys() & t.to.keys() if s.to[c] != t.to[c] and min(states[s.to[c]].total, states[t.to[c]].total) >= 2]
        return True

    def fold(into: int, other: int) -> None:
        """``other``, the root of a tree, becomes part of ``into``."""
        todo = [(into, other)]
        while todo:
            p, q = todo.pop()
            s, t = states[p], states[q]
            s.end += t.end
            for c, n in t.count.items():
                s.count[c] += n
                if c in s.to:
                    todo.append((s.to[c], t.to[c]))
                else:
                    s.to[c] = t.to[c]

    red, blue = [0], [(0, c) for c in sorted(states[0].to)]
    while blue:
        parent, symbol = blue.pop(0)
        b = states[parent].to[symbol]
        if b in red:
            continue
        match = next((r for r in red if compatible(r, b)), None)
        if match is None:
            red.append(b)
        else:
            states[parent].to[symbol] = match
            fold(match, b)
        seen = set(red)
        blue = [(r, c) for r in red for c in sorted(states[r].to) if states[r].to[c] not in seen]
    place = {r: n for n, r in enumerate(red)}
    return [State(states[r].end, dict(states[r].count), {c: place[t] for c, t in states[r].to.items()}) for r in red]


@dataclass
class Grammar:
    """Log probabilities of an automaton, ready for scoring; ``miss`` is that of a step the automaton lacks."""

    steps: list[dict[str, tuple[float, int]]]
    ends: list[float]
    miss: float

    def loglik(self, text: str, floor: float = -math.inf) -> float:
        """Of a whole string of symbols; stops early, at less than ``floor``."""
        at, total = 0, 0.0
        for c in text:
            step = self.steps[at].get(c)
            if step is None:
                total += self.miss
            else:
                total += step[0]
                at = step[1]
            if total < floor:
                return -math.inf
        return total + self.ends[at]


def grammar(samples: list[str], smooth: float = 0.5, alpha: float = 0.05) -> Grammar:
    states = infer([classed(s) for s in samples], alpha)
    steps, ends = [], []
    for s in states:
        total = s.total + smooth * (len(s.count) + 2)
        steps.append({c: (math.log((n + smooth) / total), s.to[c]) for c, n in s.count.items()})
        ends.append(math.log((s.end + smooth) / total))
    return Grammar(steps, ends, math.log(1e-4))


@dataclass
class Background:
    """Pairs of neighbouring symbols in ordinary text."""

    steps: dict[tuple[str, str], float]
    other: float

    def loglik(self, text: str) -> float:
        total, last = 0.0, "^"
        for c in text + END:
            total += self.steps.get((last, c), self.other)
            last = c
        return total


def pairs_of(words: dict[str, int]) -> Counter[tuple[str, str]]:
    """How often symbols follow each other in words that come so many times, start and end among them."""
    counts: Counter[tuple[str, str]] = Counter()
    for w, n in words.items():
        symbols = classed(w)
        for pair in zip("^" + symbols, symbols + END):
            counts[pair] += n
    return counts


def background(words: list[str], pairs: dict[tuple[str, str], int] | None = None) -> Background:
    """From words, and from ``pairs`` counted elsewhere. No pair is less likely than one that was never seen, so a pair that
    is rare in a large corpus is no better evidence than in a small one."""
    counts = pairs_of(Counter(words))
    counts.update(pairs or {})
    firsts: dict[str, int] = defaultdict(int)
    for (first, _), n in counts.items():
        firsts[first] += n
    other = math.log(1e-3)
    return Background({k: max(other, math.log((n + 0.5) / (firsts[k[0]] + 40))) for k, n in counts.items()}, other)


def example_credentials(rows: int = 150, seed: int = 11) -> dict[str, list[str]]:
    """Labelled credentials of published formats, drawn at random: nothing here opens anything."""
    rng = random.Random(seed)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, base62 = "0123456789abcdef", string.ascii_letters + string.digits
    base64, upper = base62 + "+/", string.ascii_uppercase + string.digits
    # Fixed formats.
    formats = {
        "access": lambda: "AKIA" + of(upper, 16),
        "temporary": lambda: "ASIA" + of(upper, 16),
        "hex": lambda: of(hexes, rng.choice((32, 40, 64))),
        "forge": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + of(base62, 36),
        "payment": lambda: rng.choice(("sk_live_", "rk_live_")) + of(base62, 24),
        "chat": lambda: "xoxb-" + of(string.digits, 12) + "-" + of(string.digits, 12) + "-" + of(base62, 24),
        "maps": lambda: "AIza" + of(base62 + "_-", 35),
        "mail": lambda: "SG." + of(base62 + "_-", 22) + "." + of(base62 + "_-", 43),
        "web": lambda: "eyJ" + of(base62, 33) + "." + "eyJ" + of(base62, 60) + "." + of(base62 + "_-", 43),
        "base64": lambda: of(base64, rng.choice((40, 43))) + rng.choice(("", "=")),
    }
    return {kind: [make() for _ in range(rows)] for kind, make in formats.items()}


def ordinary_words(rows: int = 3000, seed: int = 12) -> list[str]:
    """Long runs that are no secrets: words, joined words, paths, names, numbers, dates, dotted versions. What the
    background knows before it has seen the corpus's own tokens."""
    rng = random.Random(seed)
    syllables = "the an er in on re ti es ing tion ble st th en or ly ment ung ver lich heit que elle ador mente cion ous al ic ed pre con pro sub able ful ness".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 7)))
    out = []
    for _ in range(rows):
        w = [word() for _ in range(rng.randint(1, 4))]
        w = [x.capitalize() if rng.random() < 0.2 else x.upper() if rng.random() < 0.1 else x for x in w]
        number = str(rng.randint(0, 10 ** rng.randint(1, 18)))
        out.append(rng.choice(("".join(w), "-".join(w), "_".join(w), "/".join(w), ".".join(w), number, w[0] + number[:4], "/".join(w) + f"/{number[:4]}.html", "=" * rng.randint(16, 40), "-" * rng.randint(16, 40), "." * rng.randint(16, 40))))
    return out


@dataclass
class Scanner:
    grammars: dict[str, Grammar]
    background: Background
    least_gain: float = 0.35  # nats per symbol over the background
    least_evidence: float = 12.0  # nats in all: odds of 160,000 to 1, so that short words do not pass by chance

    def __post_init__(self):
        self.known: dict[str, tuple[str, float] | None] = {}

    def likely(self, text: str) -> tuple[str, float] | None:
        """(format, nats per symbol over the background) of the likeliest format; None where that is too little."""
        symbols = classed(text)
        if symbols not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            base = self.background.loglik(symbols)
            need, best = base + max(self.least_gain * len(symbols), self.least_evidence), None
            for name, g in self.grammars.items():
                if (found := g.loglik(symbols, need)) > need:
                    need, best = found, (name, (found - base) / len(symbols))
            self.known[symbols] = best
        return self.known[symbols]


def trained(labelled: dict[str, list[str]] | None = None, ordinary: list[str] | None = None, corpus: dict[str, list[str]] | None = None, pairs: dict[tuple[str, str], int] | None = None) -> Scanner:
    """A scanner from labelled credentials by format, those of a ``corpus`` beside published formats, and ordinary tokens,
    or ``pairs`` of their symbols, beside those of ``ordinary_words``."""
    known = {k: list(v) for k, v in (labelled or example_credentials()).items()}
    for kind, values in (corpus or {}).items():
        known.setdefault(kind, []).extend(values)
    return Scanner({k: grammar(v) for k, v in known.items() if v}, background([*ordinary_words(), *(ordinary or [])], pairs))


def held_out_rates(corpus: dict[str, list[str]], ordinary: list[str]) -> dict[str, float]:
    """How well grammars know what they have not learnt: of the values of each kind whose CRC-32 leaves 0 by 5 the share
    that is found, and under ``ordinary`` the share of such tokens that is taken for a credential; learnt from the others."""
    aside = lambda v: crc32(v.encode()) % 5 == 0
    scanner = trained(corpus={k: [v for v in vs if not aside(v)] for k, vs in corpus.items()}, ordinary=[t for t in ordinary if not aside(t)])
    of = lambda values: [v for v in values if aside(v) and len(v) >= LEAST]
    rate = lambda values: sum(scanner.likely(v) is not None for v in values) / max(1, len(values))
    return {k: rate(of(vs)) for k, vs in corpus.items()} | {"ordinary": rate(of(ordinary))}


def likely_pieces(text: str, start: int, end: int, scanner: Scanner, marks: str = SEPARATORS) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, format, gain) of the largest likely parts of a stretch: itself, else itself without the marks around
    it, else its parts between the first of ``marks``, each looked at with the later marks."""
    if end - start < LEAST or UUID.fullmatch(text, start, end):
        return
    if found := scanner.likely(text[start:end]):
        yield start, end, *found
        return
    a, b = start, end
    while a < b and text[a] in SEPARATORS:
        a += 1
    while a < b and text[b - 1] in SEPARATORS:
        b -= 1
    if (a, b) != (start, end):
        yield from likely_pieces(text, a, b, scanner, marks)
        return
    mark = next((n for n, c in enumerate(marks) if c in text[start:end]), None)
    if mark is None:
        return
    at = start
    for part in text[start:end].split(marks[mark]):
        yield from likely_pieces(text, at, at + len(part), scanner, marks[mark + 1 :])
        at += len(part) + 1


def base_matches(text: str) -> Iterator[tuple[str, str, re.Match]]:
    """(kind, value, match) of what the plain patterns find."""
    low = text.lower()
    named = any(w in low for w in ASSIGN_WORDS)
    for kind, pattern, group, least in BASE:
        if kind != "assign" or named:
            yield from ((kind, m[group], m) for m in pattern.finditer(text) if len(m[group]) >= least)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that the plain patterns find."""
    return sorted((m.start(), m.end(), kind) for kind, _, m in base_matches(text))


def untouched(text: str, base: list[tuple[int, int, str]]) -> Iterator[str]:
    """Candidates that no span of ``base``, sorted, meets."""
    n = reach = 0
    for m in CANDIDATE.finditer(text):
        while n < len(base) and base[n][0] < m.end():
            reach, n = max(reach, base[n][1]), n + 1
        if reach <= m.start():
            yield m[0]


def spans_of(text: str | None, scanner: Scanner) -> list[tuple[int, int, str, str | None, float | None]]:
    """(start, end, kind, format, gain) by start, then kind: the base patterns' spans, and candidates of the grammars.

    A candidate is a run of ``LEAST`` or more characters, whole; where base spans touch it, also what they have of it and
    what they leave of it. Of those that are not likely, the parts between separators.
    """
    text = text or ""
    base = base_spans(text)
    found: dict[tuple[int, int], tuple[str, float]] = {}
    first = 0
    for m in CANDIDATE.finditer(text):
        while first < len(base) and base[first][1] <= m.start():  # one of another kind may end later: it is seen again
            first += 1
        stretches, at, n = [(m.start(), m.end())], m.start(), first
        while n < len(base) and base[n][0] < m.end():
            a, b = max(base[n][0], m.start()), min(base[n][1], m.end())
            if a < b:
                stretches += [(at, a), (a, b)]
                at = max(at, b)
            n += 1
        if at > m.start():
            stretches.append((at, m.end()))
        for a, b in dict.fromkeys(stretches):
            for x, y, name, gain in likely_pieces(text, a, b, scanner):
                found[x, y] = (name, gain)
    out = [(a, b, k, None, None) for a, b, k in base] + [(a, b, "grammar", *of) for (a, b), of in found.items()]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def ordinary_tokens(docs: DataFrame, documents: int = 2000, tokens: int = 20_000) -> list[str]:
    """At most ``tokens`` distinct candidates of at most ``documents`` documents that no plain pattern touches, both by the
    order of a hash: a bounded sample, the same in every run."""
    small_batches(docs.sparkSession)
    draw = F.xxhash64(F.lit("ordinary"), F.col("doc_id").cast("string"))
    few = docs.select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(documents).select("doc_id").distinct()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = set()
            for text in pdf["text"].dropna():
                kept.update(untouched(text, base_spans(text)))
            yield pd.DataFrame({"token": sorted(kept)}, dtype=object)

    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text")  # at most ``documents`` ids
    got = chosen.mapInPandas(made, "token string").distinct().orderBy(F.xxhash64("token"), "token").limit(tokens)
    return [r.token for r in got.collect()]


#: Kind of the rows of ``lessons`` that hold two symbols, one after the other.
PAIR = "pair"


def lessons(docs: DataFrame) -> DataFrame:
    """``kind, value, n``: what all whole texts teach, with how often it comes.

    Values that the plain patterns confirm, by kind (what is assigned is of kind ``assigned``), and, of kind ``pair``, two
    symbols that follow each other in candidates that no plain pattern meets: a few thousand kinds of pairs at most.
    """
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter[tuple[str, str]] = Counter()
        rows = lambda counts: pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "value", "n"])
        for pdf in batches:
            values: Counter[tuple[str, str]] = Counter()
            tokens: Counter[str] = Counter()
            for text in pdf["text"].dropna():
                found = list(base_matches(text))
                values.update(("assigned" if kind == "assign" else kind, value) for kind, value, _ in found if len(value) >= LEAST)
                tokens.update(untouched(text, sorted((m.start(), m.end(), kind) for kind, _, m in found)))
            pairs.update(pairs_of(tokens))
            yield rows(values)
        yield rows({(PAIR, a + b): n for (a, b), n in pairs.items()})

    counted = docs.select("text").mapInPandas(made, "kind string, value string, n long")
    return counted.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def confirmed(taught: DataFrame, most: int = 2000) -> dict[str, list[str]]:
    """At most ``most`` distinct values of each kind that the plain patterns confirm, by the order of a hash: the corpus's
    own labels, a bounded sample of them, the same in every run."""
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    out: dict[str, list[str]] = {}
    for r in taught.filter(F.col("kind") != PAIR).withColumn("nth", nth).filter(F.col("nth") <= most).collect():  # ``most`` of each of three kinds
        out.setdefault(r.kind, []).append(r.value)
    return {k: sorted(v) for k, v in sorted(out.items())}


def corpus_credentials(docs: DataFrame, most: int = 2000) -> dict[str, list[str]]:
    """``confirmed`` of all texts of ``docs``."""
    return confirmed(lessons(docs), most)


def ordinary_pairs(taught: DataFrame) -> dict[tuple[str, str], int]:
    """How often two symbols follow each other in the ordinary tokens of all texts."""
    return {(r.value[0], r.value[1]): r.n for r in taught.filter(F.col("kind") == PAIR).collect()}  # pairs of some 70 symbols


def scanner_of(docs: DataFrame) -> Scanner:
    """A scanner that knows published formats and what all whole texts of ``docs`` teach, gathered in one pass."""
    taught = written(lessons(docs), "lessons")
    return trained(corpus=confirmed(taught), pairs=ordinary_pairs(taught))


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_grammar, spans, found`` for every row of ``docs``.

    ``spans`` is an array of ``struct<kind, start, end, format, gain>`` in code points, end exclusive, by start, then kind
    as listed; ``found`` has their texts. Base spans are leftmost and non-overlapping within a kind. Spans of kind
    ``grammar`` come beside them, with the likeliest format and by how many nats a symbol it is likelier than ordinary
    tokens. Without a ``scanner`` it is ``scanner_of`` all ``docs``. UUIDs are no secrets. A null text is an empty one, without spans. Whole texts are searched. Rows that repeat come out each. An
    empty table gives no rows. Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(scanner or scanner_of(docs))  # some thousand states at most
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("start", "end", "kind", "format", "gain")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                spans = spans_of(text, model.value)
                counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
                rows.append((doc, *counts, [dict(zip(names, s, strict=True)) for s in spans], [text[s[0] : s[1]] for s in spans]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_grammar", "spans", "found"])
            out["doc_id"] = pdf["doc_id"].to_numpy()
            yield out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    span = "struct<kind: string, start: int, end: int, format: string, gain: double>"
    return docs.select("doc_id", "text").mapInPandas(made, f"doc_id {id_kind}, {counts}, spans array<{span}>, found array<string>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
