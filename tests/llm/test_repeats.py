"""Removal of repeated strings against brute force; suffix arrays against sorting."""

import random

import numpy as np
import pytest
from measureframe.llm import repeats as rp
from measureframe.llm import suffixes

CLASHING = "doc_id bigint, text string, id string, sum string, start int, key string, removed string, kept string, places string"


def brute(rows, length):
    """rows: (id, text) with ids in order; (id, kept, runs) of each."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            window = body[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        steps = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        runs = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()))
        out.append((key, bytes(b for b, g in zip(body, gone) if not g), runs))
    return sorted(out, key=repr)


def found(df, length):
    rows = rp.remove_repeats(df, length).collect()
    return sorted(((r.row.doc_id, bytes(r.kept), [(x.start, x.end) for x in r.removed]) for r in rows), key=repr)


def corpus(rng, n):
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append(rng.choice(["", " "]).join(parts))
    return texts + rng.sample(texts, n // 4) + [None, "", "a", "x" * 700, "x" * 650 + "y", "ab" * 400, "z\x00" * 90, "z\x00" * 60, "€" * 120]


@pytest.mark.parametrize("length, hot, shard, entries", [(100, 20_000, 8 << 20, 1 << 24), (100, 1, 300, 7), (20, 2, 2000, 50), (3, 5, 500, 1 << 20)])
def test_repeats_against_brute_force(spark, monkeypatch, length, hot, shard, entries):
    monkeypatch.setattr(rp, "HOT", hot)
    monkeypatch.setattr(rp, "SHARD_BYTES", shard)
    monkeypatch.setattr(rp, "QUEUE_ENTRIES", entries)
    texts = corpus(random.Random(length + hot), 40)
    random.Random(1).shuffle(texts)
    rows = [(10 * i - 50, t, "x", "y", 1, "k", "r", "q", "p") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CLASHING).repartition(5)
    assert found(df, length) == brute([r[:2] for r in rows], length)


def test_rows_that_repeat_and_ids_that_are_null(spark):
    text = "a passage that is long enough to repeat " * 4
    rows = [(1, text), (1, text), (None, text), (None, "first " + text), (2, None), (2, ""), (3, text[:90]), (3, text[:90])]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"), 100)
    assert [r for r in got if r[0] in (2, 3)] == sorted([(2, b"", []), (2, b"", []), (3, text[:90].encode(), []), (3, text[:90].encode(), [])], key=repr)
    ones = [r for r in got if r[0] == 1]
    period = len("a passage that is long enough to repeat ")
    assert sorted(len(r[1]) for r in ones) == [0, period]  # a period of 40 bytes: what follows the first 40 is covered
    nulls = [r for r in got if r[0] is None]
    assert sorted(r[1] for r in nulls) == [b"", b"firs"]  # "t " before the passage stands in it as well


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000))
    rows = [(1, "start " + long[100_000:100_500]), (2, long), (3, "m" * 300_000)]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"), 100)
    assert got[1][2] == [(100_000, 100_500)] and len(got[1][1]) == len(long) - 500
    assert got[2][2] == [(1, 300_000)]


def test_repeats_of_nothing(spark):
    assert rp.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert found(spark.createDataFrame([(1, "short"), (2, None)], "doc_id bigint, text string"), 100) == [(1, b"short", []), (2, b"", [])]


@pytest.mark.parametrize("memory, step", [(10**6, 1 << 20), (1, 2), (20, 3)])
def test_suffix_arrays_against_sorting(monkeypatch, memory, step):
    monkeypatch.setattr(suffixes, "STEP", step)
    rng = random.Random(memory)
    for _ in range(250):
        letters = rng.choice([b"ab", b"a", b"abc\0", b"abcdefgh"])
        strings = [bytes(rng.choices(letters, k=rng.randint(0, rng.choice([3, 12, 60])))) for _ in range(rng.randint(0, 6))]
        strings += [strings[0], strings[0] * 3] if strings else []
        depth, batches = rng.choice([1, 4, 100]), []
        text = bytes(suffixes.suffix_array(strings, depth, memory, lambda p, c: batches.append((p.tolist(), c.tolist()))))
        places, common = [p for b in batches for p in b[0]], [c for b in batches for c in b[1]]
        assert sorted(places) == [i for i, b in enumerate(text) if b]
        suffix = [text[p : text.index(b"\0", p)][:depth] for p in places]
        for one, other, n in zip(suffix, suffix[1:], common[1:]):
            assert one >= other
            shared = next((i for i, (x, y) in enumerate(zip(one, other)) if x != y), min(len(one), len(other)))
            assert n == shared or one == other and n >= shared
