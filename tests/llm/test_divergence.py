"""Source divergence against brute force with exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from measureframe.llm import divergence as d

CLASHING = "doc_id bigint, text string, lang string, source string, term string, n int, copies string, g string, digest string"


def brute(rows, at_least=3, ranks=200):
    """rows: (text, lang, source)."""
    count, docs, seen = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        seen.add((lang, source))
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        count[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang in {k for k, _ in seen}:
        kept = [t for t, n in docs[lang].items() if n >= at_least]
        sources = sorted(s for k, s in seen if k == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 1000000000 * (c + 1) // (n + len(kept))
        p = {(s, t): share(count[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o) for o in sources if o != s]
            over = [((p[s, t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s, t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(items, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def found(df, **options):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in d.divergence(df, **options).collect())


def corpus(rng, n, sources=7):
    words = ["Alpha", "beta", "gamma-delta", "É", "été", "日本", "x1y", "the", "THE", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30))) for _ in range(n // 2)] + [None, "", "123 ...", "once only terms"]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice([f"s{k}" for k in range(sources)] + [None]), "x", 1, "y", "z", "w") for i in range(n)]


@pytest.mark.parametrize("block", [512, 3])
def test_divergence_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    monkeypatch.setattr(d, "MEMORY", 40)
    rows = corpus(random.Random(2), 160)
    # A text that a third of the rows repeat, in one source.
    rows += [(1000 + i, "the copy of the copy", "en", "s1", "x", 1, "y", "z", "w") for i in range(80)]
    got = found(spark.createDataFrame(rows, CLASHING), ranks=4)
    assert got == brute([r[1:4] for r in rows], ranks=4)


def test_langs_without_kept_terms_and_sources_alone(spark):
    rows = [("a b", "en", "s1"), ("c", "en", "s2"), ("a a a", "de", "s1"), ("a", "de", "s1"), ("a b", "de", "s1"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = found(df)
    assert got == brute(rows)
    assert [r for r in got if r[0] == "en"] == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]


def test_a_very_long_text_and_ties(spark):
    rows = [("w" * 50_000 + " " + "tie tied " * 40_000, "en", "a"), ("tie tied", "en", "b"), ("tied tie", "en", "b"), ("other " * 3, "en", "b")]
    assert found(spark.createDataFrame(rows, "text string, lang string, source string")) == brute(rows)


def test_divergence_of_nothing(spark):
    assert found(spark.createDataFrame([], "text string, lang string, source string")) == []


def test_shares_are_exact():
    for count, total, kept in [(0, 10, 3), (9_999_999_999_999, 8_000_000_000_000_000, 77), (8_999_999_999_999, 9_000_000_000_000, 1)]:
        assert int(d.shares(count, total, kept)) == 1 + 1_000_000_000 * (count + 1) // (total + kept)
