"""Cross-tokenizer alignment against brute force over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from measureframe.llm import alignment as al
from measureframe.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "a", "Hello world", "Hello  world ", " leading", "tab\tand\nnewline\n\n", "naïve café 日本語 🙂 ﬁ ①", "<|endoftext|> and </s> <s> <unk> <0x0A>",
    "don't stop, 12345 3.14!", "▁ sign ▁▁", "x" * 300, "Donaudampfschifffahrtsgesellschaft " * 40, "\x00\x01 control", "é combining", "same text", "same text", "word " * 3 + "tail",
]


def tokens(text):
    """(ids of A, ids of B, byte spans of both), straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    if not text:
        return [], [], [], []
    char = {c: x for x, c in __import__("measureframe.llm.tokens", fromlist=["x"]).byte_alphabet().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0] + ends[:-1], ends))

    return ids_a, ids_b, spans(bytes_a), spans(bytes_b)


def brute(rows):
    found, holders = {}, defaultdict(set)
    for key, text in enumerate(t for _, t in rows):
        ids_a, ids_b, spans_a, spans_b = tokens(text)
        links = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (u, v) in zip(ids_b, spans_b) if s < v and u < e]
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, low = [], 0
        for cut in cuts:
            own = [",".join(str(i) for i, (s, e) in zip(ids, spans) if low < e <= cut) for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))]
            groups.append("|".join(own))
            low = cut
        found[key] = (len(ids_a), len(ids_b), len(cuts), links, ";".join(groups))
        for pair in set(links):
            holders[pair].add(key)
    count = {p: len(k) for p, k in holders.items()}
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for key, (doc, _) in enumerate(rows):
        n_a, n_b, n_groups, links, text = found[key]
        out.append((doc, n_a, n_b, n_groups, len(links), text, sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)))
    return sorted(out, key=repr), sorted((a, b, n, n == most[a]) for (a, b), n in count.items())


@pytest.mark.parametrize("size", [4 << 20, 600])
def test_alignment_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(al, "BLOCK_BYTES", size)
    rows = list(enumerate(TEXTS)) + [(3, "repeated id"), (None, "no id"), (3, "repeated id")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, block int, pairs string, groups string").repartition(3)
    docs, links = al.align(df, tokenizer_path(A), tokenizer_path(B))
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in docs.collect()), key=repr)
    want_docs, want_links = brute(rows)
    assert got == want_docs
    assert sorted(tuple(r) for r in links.select("a", "b", "n", "best").collect()) == want_links


def test_digest_of_groups_and_a_very_long_text(spark):
    text = "Long texts, many wörds. " * 6000
    docs, _ = al.align(spark.createDataFrame([("k", text), ("l", "short")], "doc_id string, text string"), tokenizer_path(A), tokenizer_path(B), groups="sha256")
    (row,) = docs.filter("doc_id = 'k'").collect()
    ids_a, ids_b, spans_a, spans_b = tokens(text)
    assert (row.n_a, row.n_b, row.n_groups) == (len(ids_a), len(ids_b), len({e for _, e in spans_a} & {e for _, e in spans_b}))
    own = al.align(spark.createDataFrame([("k", text)], "doc_id string, text string"), tokenizer_path(A), tokenizer_path(B))[0].first()
    assert row.groups == hashlib.sha256(own.groups.encode()).hexdigest()


def test_alignment_of_nothing(spark):
    docs, links = al.align(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path(A), tokenizer_path(B))
    assert docs.count() == links.count() == 0
