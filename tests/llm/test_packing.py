"""Packing, tokenising and token counts against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from measureframe.llm import token_files
from measureframe.llm.packing import cut, pack, plan, runs
from measureframe.llm.queries import op7_packing, tokenizer_path
from measureframe.llm.tokens import byte_bpe

BPE = tokenizer_path("byte_bpe_50k.json")
ODD = ["a  b", "  x ", " a\n\nb", "   c", "don't we've 'tis it's.", "a\tb c\t d", "<|endoftext|> z", "²x ½", "I'm,'s 's", "a_b __c", "é́x œuvre", "日本 語。", "\n", " ", "", "a \nb", "w.\n\nN", "a\x1cb a\x1c b", "x'", "a 's b", "b  c"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(text):
    coder = byte_bpe(BPE)
    assert coder.ids(text) == coder.whole(text) == coder.ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAé1. ,'!\n\t _²日")), max_size=30))
def test_ids_are_the_tokenizers_for_any_text(text):
    coder = byte_bpe(BPE)
    assert coder.ids(text) == (coder.whole(text) if text else b"")


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_sequences(seed):
    rng = random.Random(seed)
    size = 64
    counts = Counter(min(size, 1 + int(rng.expovariate(1 / rng.choice([5, 20, 50])))) for _ in range(rng.choice([1, 10, 3000])))
    planned = plan(counts, size)
    used = Counter()
    for lengths, n in planned:
        assert sum(lengths) <= size and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    bins = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    first_fit = []
    for x in bins:
        for i, g in enumerate(first_fit):
            if g >= x:
                first_fit[i] -= x
                break
        else:
            first_fit.append(size - x)
    assert -(-total // size) <= sum(n for _, n in planned) <= len(first_fit) + 1


def test_plan_finds_single_pair_and_triple_complements():
    assert plan({60: 1, 40: 1}, 100) == [([60, 40], 1)]
    assert plan({60: 2, 30: 2, 10: 2}, 100) == [([60, 30, 10], 2)]
    assert plan({50: 1, 25: 1, 15: 1, 10: 1}, 100) == [([50, 25, 15, 10], 1)]
    assert plan({}, 100) == [] and plan({100: 3}, 100) == [([100], 3)]


def test_runs_place_every_rank():
    table = runs([([60, 20, 20], 2), ([20], 1)])
    assert table[20].tolist() == [[0, 0, 60], [2, 0, 80], [4, 2, 0]]


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def checked(rows, docs, size, end_id=2):
    coder = byte_bpe(BPE)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for doc, text in docs:
        whole, at = coder.whole(text or "") + np.asarray([end_id], "<u4").tobytes(), 0
        for k, (piece, start, length, ids) in enumerate(sorted(by_doc.pop(doc))):
            assert piece == k and start == at and ids == whole[4 * start : 4 * (start + length)] and (k == 0 or length == size)
            at += length
        assert 4 * at == len(whole)
    assert not by_doc
    return len(by_sequence)


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["the", "of", "Zürich", "x1"], k=rng.randint(0, 90)))) for i in range(150)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id bigint, text string, task string, length string").repartition(5)
    rows = pack(df, BPE, size=32).collect()
    sequences = checked(rows, docs, 32)
    assert sequences <= 1.02 * sum(r.length for r in rows) / 32 + 1


def test_pack_of_rows_that_repeat_and_of_nothing(spark):
    rows = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string"), BPE, size=8).collect()
    assert sorted(r.length for r in rows) == [2, 3, 3] and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), BPE).count() == 0


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    coder, rows = byte_bpe(BPE), op7_packing(spark, sf).collect()
    crc = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in rows}
    assert len(crc) == len(rows)
    for doc, text in docs:
        ids = coder.whole(text or "") + b"\x02\x00\x00\x00"
        for start, length in cut(len(ids) // 4, 1024):
            assert crc.pop((doc, start, length)) == zlib.crc32(ids[4 * start : 4 * (start + length)])
    assert not crc


@pytest.mark.parametrize("seed", range(4))
def test_scan_stitches_over_parts_and_blocks(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for stream in range(3):
        ids = [rng.choice([2, 2, 5, 6, 7, 300]) if rng.random() < 0.5 else 9 for _ in range(rng.choice([0, 1, 40, 200]))]
        at = 0
        for i, x in enumerate(ids):
            if x == 2:
                want.append((stream, at, i - at, True))
                at = i + 1
        if at < len(ids):
            want.append((stream, at, len(ids) - at, False))
        cuts = sorted({0, len(ids), *(rng.randint(0, len(ids)) for _ in range(5))})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:] or [0])):
            rows.append((stream, f"part-{k:03d}", np.asarray(ids[a:b], "<u2").tobytes()))
    files = spark.createDataFrame(rows, "stream int, part string, content binary").repartition(4)
    got = token_files.scan_token_files(files, 2, block=7).collect()
    assert sorted((r.stream, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)
    for stream in range(3):
        assert sorted(r.doc_no for r in got if r.stream == stream) == list(range(sum(w[0] == stream for w in want)))


def test_more_than_a_thousand_parts_are_stitched_in_order(spark):
    """Document k has k tokens and its own part, named as Spark names them."""
    rows = [(0, f"part-00000-1b5e.c{k:03d}.txt", np.asarray([9] * k + [2], "<u2").tobytes()) for k in range(1013)]
    got = token_files.scan_token_files(spark.createDataFrame(rows, "stream int, part string, content binary").repartition(4), 2)
    assert sorted((r.doc_no, r.n_tokens) for r in got.collect()) == [(k, k) for k in range(1013)]


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [(i, t) for i, t in enumerate([*ODD, None, "long word " * 3000])] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, stream string").repartition(3)
    from measureframe.llm.store import new_path

    got = token_files.count_tokens(df, new_path(spark, "test"), path, file_docs=5).collect()
    assert all(r.ended for r in got)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(model.encode(t or ""))) for i, t in docs)
    assert token_files.count_tokens(df.limit(0), new_path(spark, "test"), path).count() == 0
