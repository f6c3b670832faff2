"""Language identification: definition, held-out accuracy, odd rows."""

import numpy as np
import pytest
from measureframe.llm import language
from measureframe.llm.language import BUCKETS, LENGTHS, has_letter, identify, subwords, train
from measureframe.llm.queries import op5_language

SF = "/root/testdata/sf0.01"


def plain_subwords(text):
    codes, out = [0], []
    for b in text.lower().encode():
        c = b if b >= 128 or ord("a") <= b <= ord("z") else 0
        if c or codes[-1]:
            codes.append(c)
    if codes[-1]:
        codes.append(0)
    for n in LENGTHS:
        for i in range(len(codes) - n + 1):
            part = codes[i : i + n]
            if all(part[1:-1]) and any(part):
                h = n
                for c in part:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                h ^= h >> 15
                out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16 & (BUCKETS - 1))
    return out


@pytest.mark.parametrize("text", ["", "a", "Été, l'été.", "  x  1 y ", "word " * 50, "ß9ß", "#?! 12"])
@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_subwords_by_definition(monkeypatch, text, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    got = np.concatenate([np.zeros(0, np.uint32), *subwords(text)])
    assert sorted(got.tolist()) == sorted(plain_subwords(text))


def test_letters():
    assert has_letter("1 é") and has_letter("日") and not has_letter("12 ½ !") and not has_letter("") and not has_letter(None)


def test_held_out_accuracy(spark):
    rows = op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 2


def test_probabilities_are_calibrated_and_odd_rows_defined(spark):
    a, b = ["the cat and that hat", "than this then"], ["der und die das", "nicht sich ich"]
    rows = [(label, *map(np.asarray, np.unique(np.concatenate(subwords(t)), return_counts=True))) for label, texts in (("en", a), ("de", b)) for t in texts * 10]
    model = train([(x, y.astype(np.int64), z.astype(float)) for x, y, z in rows])
    assert model.predict("that hat and the") [0] == "en" and model.predict("ich und die")[0] == "de"
    long = "der und die nicht " * 60_000
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !", "q"), (4, long, "q"), (4, long, "q"), (None, "the", None)], "doc_id bigint, text string, lang_pred string")
    got = [(r.row.doc_id, r.row.lang_pred, r.lang_pred, r.score > 0.5, r.rejected) for r in identify(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "q", "und", False, True), (2, "q", "und", False, True), (3, "q", "und", False, True), (4, "q", "de", True, False), (4, "q", "de", True, False), (None, None, "en", True, False)], key=repr)
    assert identify(df.limit(0), model).count() == 0
