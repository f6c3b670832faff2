"""Exact and near duplicates against brute force."""

import random
from collections import defaultdict

import pytest
from measureframe.llm import exact_dedup as exact
from measureframe.llm import minhash
from measureframe.llm.components import components

CLASHING = "doc_id bigint, text string, grp string, digit string, next string, n string, row string, id string, kept string"


def clashing(rows):
    return [(i, t, *["x"] * 7) for i, t in rows]


def found_exact(df):
    return sorted(((r.row.doc_id, r.row.text, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, t, max(ids, default=None), len(groups[t or ""])))
    return sorted(out, key=repr)


def test_exact_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact, "FIRST", 2)
    monkeypatch.setattr(exact, "GROWTH", 3)
    monkeypatch.setattr(exact, "WIDEST", 500)
    rng = random.Random(3)
    start = "é" * 700
    texts = [None, "", "a", "ab", "ab ", start, start + "x", start + "y", "z" * 5000, "z" * 4999 + "y"]
    rows = [(i, rng.choice(texts)) for i in range(120)]
    got = found_exact(exact.exact_dedup(spark.createDataFrame(clashing(rows), CLASHING)))
    assert [r[:4] for r in got] == brute_exact(rows)
    kept = defaultdict(int)
    for i, t, keep, _, k in got:
        assert k == (i == keep)
        kept[t or ""] += k
    assert set(kept.values()) == {1}


def test_exact_dedup_of_rows_that_repeat_and_ids_that_are_null(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "a"), (2, None), (2, "")]
    got = found_exact(exact.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [r[:4] for r in got] == brute_exact(rows)
    kept = defaultdict(int)
    for _, t, _, _, k in got:
        kept[t or ""] += k
    assert kept == {"a": 1, "b": 1, "c": 1, "": 1}


def test_exact_dedup_of_nothing(spark):
    assert exact.exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def families(rng, n, size):
    """Texts in families: chains of small edits, so links run through others, and strangers with shared passages."""
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(1, 60))] + passage * rng.randint(0, 1)
        for _ in range(rng.randint(1, size)):
            rows.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = word()
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hubs", [(32, 256), (1, 1)])
def test_near_dedup_against_brute_force(spark, monkeypatch, hubs):
    monkeypatch.setattr(minhash, "HUBS", hubs[0])
    monkeypatch.setattr(minhash, "MORE_HUBS", hubs[1])
    rows = families(random.Random(5), 25, 12)
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\n "), (10_003, "one"), (10_004, "ONE"), (10_005, "one two"), (10_006, "one\vtwo"), (10_007, "one two")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, node string, bands string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(df).collect()}
    assert got == brute_near(rows)


def test_near_dedup_of_rows_that_repeat_and_ids_that_are_null(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (None, text), (5, text + " "), (7, None), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(3, 4, 3, True), (3, 4, 3, True), (None, 4, 3, False), (5, 4, 3, False), (7, 0, 7, True), (None, 0, None, True)], key=repr)


def test_near_dedup_of_nothing(spark):
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_circulant_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    one, two = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 1000).astype(np.uint64)])), np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 1000).astype(np.uint64)]))
    both = minhash.signatures(np.concatenate([one, two]), np.array([0, len(one)]), 240)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.1
    # By definition, coordinate by coordinate: the second permutation shifted around the circle.
    x = (one >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x = minhash._permuted(x, minhash.SIGMA)
    x ^= x >> np.uint32(16)
    assert [minhash._permuted(x - np.uint32(k), minhash.PI).min() for k in (0, 1, 239)] == [both[0][k] for k in (0, 1, 239)]


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(9)
    n = 60
    name = [rng.randbytes(8) for _ in range(n)]
    edges = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]}[kind]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a binary, b binary")).collect()}
    group = {name[i]: {name[i]} for e in edges for i in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and group[name[a]] is not group[name[b]]:
            group[name[a]] |= group[name[b]]
            for x in group[name[b]]:
                group[x] = group[name[a]]
    assert got == {x: min(g) for x, g in group.items()}


def test_strangers_with_a_common_passage_are_not_compared_in_pairs(spark, monkeypatch):
    """Two thousand short texts, 0.67 alike by a passage: the pairs tested grow with the texts, not with their square."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(44))
    sizes = []
    plain = minhash.confirmed

    def counted(pairs, texts, width):
        sizes.append(pairs.count())
        return plain(pairs, texts, width)

    monkeypatch.setattr(minhash, "confirmed", counted)
    rows = [(i, f"{passage} {' '.join(word() for _ in range(10))}") for i in range(2000)]
    copies = [(5000 + i, rows[i][1] + " tail") for i in range(0, 2000, 100)]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows + copies, "doc_id bigint, text string")).collect()}
    assert all(got[i] == i for i, _ in rows) and all(got[5000 + i] == i for i in range(0, 2000, 100))
    assert sum(sizes) < 3 * 2000, sizes


def test_near_copies_of_one_text_are_not_tested_again_and_again(spark, monkeypatch):
    """A family of near copies: once a node's likest hub has joined it, its other hubs need no test."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, rows, sizes = [word() for _ in range(100)], [], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(100)] = word()
        rows.append((i, " ".join(words)))
    plain = minhash.confirmed

    def counted(pairs, texts, width):
        sizes.append(pairs.count())
        return plain(pairs, texts, width)

    monkeypatch.setattr(minhash, "confirmed", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)
    assert sum(sizes) < 4 * 400, sizes


def test_near_copies_of_one_text_make_few_pairs_with_hubs(spark, monkeypatch):
    """A family of near copies: no round makes many pairs, as the first hubs are few and what they join makes none with those that follow."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, rows, sizes = [word() for _ in range(100)], [], []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(100)] = word()
        rows.append((i, " ".join(words)))
    plain = minhash.written

    def counted(df, name):
        out = plain(df, name)
        if name == "fresh":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)
    assert max(sizes) < 10 * 600, sizes  # with 64 hubs in the first round: 7288


def test_near_dedup_of_a_very_long_text(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200_000)]
    other = words[:190_000] + ["changed"] * 3
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:90_000]))]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
