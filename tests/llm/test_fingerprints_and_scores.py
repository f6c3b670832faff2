"""Merkle fingerprints and language-model scores against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from measureframe.llm import merkle, ppm
from measureframe.llm.merkle import WordEnds, compare_edits, edited, fingerprint, likeness
from measureframe.llm.queries import op2_ppm
from pyspark.sql import functions as F

ENDS = WordEnds()


def leaves(print_):
    return Counter(x for part in print_.split("|")[1:] for p in part.partition("=")[2].split(";") for x in p.partition(":")[2].split(",") if x)


def test_equal_texts_and_edits():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    text = "\n\n".join("\n".join(" ".join(words[i : i + 60]) for i in range(j, j + 300, 60)) for j in range(0, 900, 300))
    own = fingerprint(text, ENDS)
    assert own == fingerprint(text, ENDS) and own.count("|") == 3 and own.count(";") == 12
    changed = fingerprint(text.replace(words[450], "changed"), ENDS)
    one, two = own.split("|"), changed.split("|")
    assert one[0] != two[0] and [a == b for a, b in zip(one[1:], two[1:])] == [True, False, True]
    assert sum(a != b for a, b in zip(*(x[2].partition("=")[2].split(";") for x in (one, two)))) == 1
    assert 0.97 < likeness(own, changed) < 1 and likeness(own, own) == 1
    assert fingerprint(text + " ", ENDS).split("|")[0] != one[0]
    assert likeness(fingerprint(None, ENDS), fingerprint("", ENDS)) == 1 and likeness(fingerprint("", ENDS), own) == 0


def test_likeness_is_that_of_the_leaves():
    rng = random.Random(2)
    for _ in range(200):
        texts = [rng.choice(["", "\n"]).join(" ".join(rng.choices(["a", "bb", "ccc", "d.", "ee\n", "f\n\n"], k=rng.randint(0, 60))) for _ in range(2)) for _ in range(2)]
        a, b = (fingerprint(t, ENDS) for t in texts)
        size = leaves(a).total() + leaves(b).total()
        want = 1.0 if texts[0] == texts[1] else 2 * (leaves(a) & leaves(b)).total() / size if size else 0.0
        assert likeness(a, b) == pytest.approx(want)


def brute_edits(rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for (has, i, t), (_, _, n) in zip(rows, rows[1:] + rows[:1]):
        e = edited(t, n)
        a, b, c = (fingerprint(x, ENDS) for x in (t, e, n))
        out.append((i if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def test_different_runs_have_different_leaves():
    assert len({merkle._leaf_hash([b"run", b"%d" % i]) for i in range(100_000)}) == 100_000


@pytest.mark.parametrize("n", [0, 1, 2, 90])
@pytest.mark.parametrize("stretch", [4096, 8])
def test_compare_edits(spark, monkeypatch, n, stretch):
    monkeypatch.setattr(merkle, "STRETCH_ROWS", stretch)
    rng = random.Random(n)
    rows = [(i * 3, rng.choice([None, "", "ab", "é" * 9, " ".join(rng.choices(["x", "yy", "zé\n"], k=rng.randint(1, 200)))])) for i in range(n)]
    rows += [(3, "tie a"), (3, "tie b"), (3, "tie a"), (None, "none")] if n > 2 else []
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, task string").repartition(6)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in compare_edits(df).collect()]
    assert sorted(got, key=repr) == brute_edits(rows)


def test_edited_text():
    assert edited("abcdefgh", "XYZ") == "abcdefXY" and edited("abcdefgh", "X") == "abcdefX" and edited("abc", "X") == "abc" and edited("", "X") == ""


def brute_model(bodies, order):
    contexts = {}
    for body in bodies:
        s = [256] * order + list(body) + [256]
        for p in range(order, len(s)):
            for k in range(order + 1):
                contexts.setdefault((k, *s[p - k : p]), Counter())[s[p]] += 1
    return contexts


def brute_score(contexts, body, order):
    s, total = [256] * order + list(body) + [256], 0.0
    for p in range(order, len(s)):
        out, done = set(), False
        for k in range(order, -1, -1):
            live = {x: n for x, n in contexts.get((k, *s[p - k : p]), {}).items() if x not in out}
            if live:
                size = 2 * sum(live.values())
                if s[p] in live:
                    total += math.log10((2 * live[s[p]] - 1) / size)
                    done = True
                    break
                total += math.log10(len(live) / size)
                out |= live.keys()
        if not done:
            total -= math.log10(257 - len(out))
    return total


def check_scores(rows, docs, trains, order):
    learned = [ppm.lowered(t) for i, t in docs if trains(i)]
    contexts, counts = brute_model(learned, order), Counter(w for b in learned for w in [*b.split(), None])
    size, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        words = [*ppm.lowered(t).split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (size + 0.5 * (kinds + 1))) for w in words)
        want.append((i, trains(i), len(words), sum(counts[w] > 0 for w in words), size, base, brute_score(contexts, ppm.lowered(t), order)))
    key = lambda r: (repr(r[0]), *r[1:5], round(r[6], 6))
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-7) and a[6] == pytest.approx(b[6], abs=1e-7)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 300)
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choices(["The", "tin", "then", "é", "xyz\n"], k=rng.randint(0, 12)))) for i in range(40)] + [(100, None), (101, ""), (102, "zz qq"), (102, "zz qq"), (None, "tin")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, block string, gram int")
    got = ppm.score(df, F.coalesce(F.col("doc_id"), F.lit(1)) % 3 != 1, order).collect()
    check_scores([tuple(r) for r in got], docs, lambda i: (1 if i is None else i) % 3 != 1, order)


def test_score_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).collect()]
    got = op2_ppm(spark, sf).collect()
    trains = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    check_scores([(r.doc_id, not r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], docs, trains, ppm.ORDER)


def test_scores_without_training_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    r = ppm.score(df, F.lit(False)).first()
    assert r.score == pytest.approx(-3 * math.log10(257)) and (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_behind_a_context_sum_to_one():
    import numpy as np

    bodies = [b"abcabcab", b"abd", b"xab"]
    keys, counts = np.unique(np.concatenate([g for b in bodies for g in ppm.grams(b, 3)]), return_counts=True)
    trie = ppm.Trie(keys, counts, 3)
    for context in ((97, 98, 99), (256, 97, 98), (1, 2, 3), (5, 97, 98)):
        code = 0
        for s in context:
            code = code << ppm.BITS | s
        assert (10 ** trie.log10(np.arange(257) | code << ppm.BITS)).sum() == pytest.approx(1)


def test_adaptive_code_length():
    assert ppm.adaptive(b"") == pytest.approx(-math.log10(257))
    same, mixed = ppm.adaptive(b"ab" * 40), ppm.adaptive(bytes(random.Random(1).choices(range(97, 123), k=80)))
    assert same > mixed / 3
    learned, total, order = [], 0.0, 3
    body = b"abracadabra"
    for i in range(len(body) + 1):
        contexts = brute_model([], order)
        s = [256] * order + list(body) + [256]
        for p in range(order, order + i):
            for k in range(order + 1):
                contexts.setdefault((k, *s[p - k : p]), Counter())[s[p]] += 1
        out, done = set(), False
        p = order + i
        for k in range(order, -1, -1):
            live = {x: n for x, n in contexts.get((k, *s[p - k : p]), {}).items() if x not in out}
            if live:
                size = 2 * sum(live.values())
                total += math.log10((2 * live[s[p]] - 1 if s[p] in live else len(live)) / size)
                if s[p] in live:
                    done = True
                    break
                out |= live.keys()
        if not done:
            total -= math.log10(257 - len(out))
    assert ppm.adaptive(body, order) == pytest.approx(total)


def test_grams_travel_packed_by_part():
    words = random.Random(2).choices(["stream", "measure", "Block", "of", "rows", "sorted"], k=20_000)
    text = pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([True, False]), pa.array([" ".join(words), "Other text"])], ["block", "trains", "text"])
    rows = pa.Table.from_batches(ppm._counted(4, 16)([text])).to_pylist()
    packed = [r for r in rows if r["part"] is not None]
    assert len({r["part"] for r in packed}) == len(packed) <= 16
    got = {}
    for r in packed:
        keys, counts = (ppm.restored(r[c], r["size"], np.int64) for c in ("grams", "counts"))
        assert (np.diff(keys) > 0).all() and (ppm.part_of(keys, 16) == r["part"]).all()
        got |= dict(zip(keys.tolist(), counts.tolist()))
    want = Counter(g for c in ppm.grams(ppm.lowered(" ".join(words)), 4) for g in c.tolist())
    for chunk in ppm.grams(b"other text", 4):
        want.update(dict.fromkeys(chunk.tolist(), 0))
    assert got == want
    keys = np.array(sorted(got))
    assert len(ppm.squeezed(keys)) < 8 * len(keys)
    values = np.random.default_rng(0).random(100)
    assert (ppm.restored(ppm.squeezed(values), 100, np.float64) == values).all()
