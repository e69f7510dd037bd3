import numpy as np
import pytest

from sitewright.llm import probminhash as P

SF = "/root/testdata/sf0.001"


def brute_jp(x: dict, y: dict) -> float:
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def as_dict(s):
    return dict(zip(s[0].tolist(), s[1].tolist(), strict=True))


def test_probability_jaccard_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 6, rng.integers(3, 40))]
        other = list(words)
        for _ in range(rng.integers(0, 4)):
            other[rng.integers(0, len(other))] = "z"
        a, b = P.shingles(" ".join(words)), P.shingles(" ".join(other))
        assert P.probability_jaccard(a, b) == pytest.approx(brute_jp(as_dict(a), as_dict(b)), abs=1e-12)


def test_equal_weights_give_jaccard():
    a = P.shingles("a b c d e f g h i j")
    b = P.shingles("a b c d e f g h i z")
    assert P.probability_jaccard(a, b) == pytest.approx(5 / 7)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10_000, 600)]
    other = [w if rng.random() > 0.02 else "x" for w in words]
    a, b = P.shingles(" ".join(words)), P.shingles(" ".join(other))
    sa, sb = P.sketch(*a, 4096), P.sketch(*b, 4096)
    assert abs((sa == sb).mean() - P.probability_jaccard(a, b)) < 0.04


def test_sketch_is_filled_for_one_shingle():
    s = P.sketch(*P.shingles("one two three"), 128)
    assert len(set(s.tolist())) == 1 and s[0]


def classes_by_brute_force(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {d: P.shingles(t) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a][0]), len(sets[b][0])))
            if large and small / large < 0.1:
                continue
            if P.probability_jaccard(sets[a], sets[b]) >= 0.8:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in ids}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in P.near_duplicates(docs).collect()}
    assert got == classes_by_brute_force(rows)


def test_chain_beyond_the_leader_is_linked(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [list(base) for _ in range(5)]
    for n, t in enumerate(texts):  # each text differs from the one before in two places more
        for i in range(2 * n):
            t[10 + 17 * i] = f"x{i}"
    rows = [(n, " ".join(t), "en", "s", 1) for n, t in enumerate(texts)]
    rows += [(90, None, None, None, None), (91, "", None, None, 0), (92, "a", None, None, 1), (93, "A ", None, None, 2), (92, "a", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, root string, rep long")
    got = {}
    for r in P.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    want = classes_by_brute_force([(r[0], r[1]) for r in rows[:-1]])
    assert {d: set(c) for d, c in got.items()} == {d: {c} for d, c in want.items()}
    assert len(got[92]) == 2
    assert sorted(r.doc_id for r in P.first_of_class(docs).collect()) == sorted(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.near_duplicates(docs).count() == 0


def copies_of(base: list[str], rng, count: int, most: int) -> list[str]:
    """Copies of a text with up to ``most`` words replaced, each by a word of its own."""
    out = []
    for n in range(count):
        t = list(base)
        for i in rng.choice(len(t), rng.integers(1, most + 1), replace=False):
            t[i] = f"z{n}x{i}"
        out.append(" ".join(t))
    return out


def test_a_large_group_of_near_copies_loses_no_link_and_stays_linear(spark, monkeypatch):
    """Half of the copies are not alike enough to the first text; some are alike to one another only."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = [" ".join(base)] + copies_of(base, rng, 500, 6)
    far = base[:100] + [f"q{i}" for i in range(50)]
    texts += [" ".join(far)] + copies_of(far, rng, 200, 4)
    texts += [" ".join(base[: 150 - k]) for k in range(1, 60, 3)]  # cut ever shorter: a chain
    rows = list(enumerate(dict.fromkeys(texts)))
    compared = []
    plain = P.written
    monkeypatch.setattr(P, "written", lambda df, name: compared.append(df.count()) or plain(df, name) if name == "pairs" else plain(df, name))
    got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: P.shingles(t) for d, t in rows}
    want = classes_by_brute_force(rows)
    assert got == want
    assert len(set(want.values())) > 100 and len(sets) > 700
    # every pair: over 250,000
    assert sum(compared) < 60 * len(rows)


def test_rows_without_an_id(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text), (7, text + " b"), (None, "other words here"), (None, "other words here"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in P.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (None, None), (None, None), (None, 3), (3, 3)], key=str)
    kept = P.first_of_class(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == [(False, 3, ""), (False, 7, text + " b"), (True, 0, "other words here")]


def test_comparisons_of_a_hot_group_stay_flat(spark, monkeypatch):
    """Texts with one origin, each as far from the others as from it: no two are alike, and all share bands."""
    compared = []
    plain, measured = P.written, P._from_consensus
    monkeypatch.setattr(P, "written", lambda df, name: compared.append(df.count()) or plain(df, name) if name == "pairs" else plain(df, name))
    monkeypatch.setattr(P, "_from_consensus", lambda crowd, *a: compared.append(crowd.count()) or measured(crowd, *a))
    each = {}
    for size in (250, 2000):
        rng = np.random.default_rng(size)
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        texts = []
        for n in range(size):
            t = list(base)
            for i in rng.choice(300, 8, replace=False):
                t[i] = f"z{n}x{i}"
            texts.append(" ".join(t))
        texts[7] = texts[3] + " end"
        compared.clear()
        got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got[7] == got[3]
        each[size] = sum(compared) / size
        if size == 250:
            assert got == classes_by_brute_force(list(enumerate(texts)))
    # bounded by the leaders that a text's bands have, three comparisons each; with all pairs it would be eightfold
    assert each[2000] < 2.2 * each[250] and max(each.values()) < 40


def test_consensus_is_what_most_have():
    texts = ["a b c d e f g", "a b c d e f g h", "a b c d e x y", None, "a b c d e f z"]
    h, c = P.consensus(texts)
    want = P.shingles("a b c d e f")[0]
    assert h.tolist() == sorted(want.tolist()) and c.tolist() == [1, 1]
    assert len(P.consensus([])[0]) == 0


def test_a_very_long_text_and_its_near_copy(spark):
    long_ = " ".join(f"w{i % 7919}x{i % 31}" for i in range(150_000))
    rows = [(1, long_), (2, long_ + " more"), (3, "short")]
    got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
