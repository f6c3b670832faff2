"""Alignment of two tokenizers' tokens of the same text, all documents of a batch in lockstep."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.store import short, written
from measureframe.llm.tokens import ByteBpe

#: Bytes of text of the documents that are merged in lockstep, and then share the answers on their id pairs.
BLOCK_BYTES = 4 << 20
#: Words that a worker remembers the pieces of; the memory is then begun anew.
MEMORY = 300_000


class PieceIds(dict):
    """Ids by a piece tokenizer that writes a space as U+2581 and puts one before the text.

    Where no piece of the vocabulary has that sign behind another, no merge reaches over it, so a word
    is encoded by itself and remembered; a text with spaces in a row, or at its ends, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]

    def _bytes(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def learn(self, texts: list[str]) -> None:
        """Encode all words at once that the texts bring and the memory lacks."""
        if self.by_word:
            new = list({w for t in texts for w in t.split(" ") if w and w not in self})
            if len(self) + len(new) > MEMORY:
                self.clear()
                new = list({w for t in texts for w in t.split(" ") if w})
            for word, ids in zip(new, self.model.encode(new, num_threads=1)):
                self[word] = struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Ids, little-endian, 32 bits each."""
        if self.by_word and "▁" not in text:
            try:
                return b"".join(map(self.__getitem__, text.split(" ")))
            except KeyError:
                pass
        return np.array(self.model.encode(text), "<u4").tobytes()


class TokenBytes:
    """The bytes of every id, one after the other."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """Whether the bytes of each list of ids are those of its text."""
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        ends = np.cumsum([len(i) for i in ids])
        total = np.concatenate([[0], np.cumsum(self.sizes[every])])
        long = total[ends] - total[ends - [len(i) for i in ids]]
        good = long == [len(t) for t in texts]
        # Only texts of the right length are compared, all of them at once.
        chosen = every[np.repeat(good, [len(i) for i in ids])]
        sizes = self.sizes[chosen]
        place = np.repeat(self.starts[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        wrong = self.flat[place] != np.frombuffer(b"".join([t for t, g in zip(texts, good) if g]), np.uint8)
        sums = np.concatenate([[0], np.cumsum(wrong)])
        stop = np.cumsum(long[good])
        good[good] = sums[stop] == sums[stop - long[good]]
        return good


class Encoders:
    """Both tokenizers, and the bytes of every id of theirs."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteBpe(path_a), PieceIds(path_b)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        back = {c: b for b, c in self.a.alphabet.items()}
        entry = {i: token for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(back[c] for c in entry[i]) if i in entry and all(c in back for c in entry[i]) else b"" for i in range(max(entry) + 1)]
        self.bytes_b = self.b.bytes
        self.spelled_a, self.spelled_b = TokenBytes(self.bytes_a), TokenBytes(self.bytes_b)
        self.sizes_a, self.sizes_b = self.spelled_a.sizes, self.spelled_b.sizes

    def _ids_a(self, text: str) -> bytes:
        if not any(s in text for s in self.a.special):
            try:
                return b"".join(map(self.a.spaced.__getitem__, text.split(" ")))
            except ValueError:
                pass
        return self.a.whole(" " + text)

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space+text by A and of text by B, for each text; none where either's bytes are not those of space+text."""
        full = [t for t in texts if t]
        self.b.learn(full)
        ids = [[np.frombuffer(f(t), "<u4").astype(np.int64) for t in full] for f in (self._ids_a, self.b.ids)]
        spaced = [(" " + t).encode() for t in full]
        good = iter(self.spelled_a.spelled(ids[0], spaced) & self.spelled_b.spelled(ids[1], spaced) if full else ())
        pairs, none = zip(*ids), np.zeros(0, np.int64)
        out = []
        for t in texts:
            found = next(pairs) if t else (none, none)
            out.append(found if t and next(good) else (none, none))
        return out


@lru_cache(maxsize=2)
def _encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


def lockstep(ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray):
    """Links (document, token of A, token of B) and cuts (document, tokens of A before, tokens of B before) of a batch.

    ``ends`` are the byte ends of all documents' tokens, one document after the other; ``starts`` has where each
    document begins among them, and where the last one ends.  One state vector holds the pointers of every document
    that has not finished.  A step links the tokens that it points to, advances those that end first,
    cuts where both end, and drops the documents that are through.
    """
    doc = np.flatnonzero(starts_a[1:] > starts_a[:-1])
    at_a, at_b, stop = starts_a[:-1][doc], starts_b[:-1][doc], starts_a[1:][doc]
    links, cuts = [], []
    while len(doc):
        links.append((doc, at_a, at_b))
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        cut = end_a == end_b
        if cut.any():
            cuts.append((doc[cut], at_a[cut], at_b[cut]))
            go = ~(cut & (at_a == stop))
            if not go.all():
                doc, at_a, at_b, stop = doc[go], at_a[go], at_b[go], stop[go]
    joined = lambda rows: [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
    return joined(links), joined(cuts)


class GroupText:
    """Groups of a document as text, ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int) -> None:
        one = lambda n, last: [b"%d%s" % (i, sign) for i in range(n) for sign in (b",", last)]
        self.signs, self.b_from = one(n_a, b"|") + one(n_b, b";"), 2 * n_a

    def of(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """``cut_a`` and ``cut_b``: tokens of each up to the end of every group."""
        codes = np.empty(len(a) + len(b), np.int64)
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[cut_a - 1], end_b[cut_b - 1] = 1, 1
        codes[np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)] = 2 * a + end_a
        codes[np.arange(len(b)) + np.repeat(cut_a, size_b)] = self.b_from + 2 * b + end_b
        return b"".join(map(self.signs.__getitem__, codes.tolist()))[:-1]


_PAIR = 32


def _aligned(path_a: str, path_b: str, groups: str):
    """A function on batches (id, text): rows of documents, and one row for each block with its distinct id pairs."""
    def run(batches):
        own = _encoders(path_a, path_b)
        text_of = GroupText(len(own.bytes_a), len(own.bytes_b))
        task, number = TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0

        def finished():
            n = len(tokens)
            a, b = (np.concatenate([t[i] for t in tokens]) if n else np.zeros(0, np.int64) for i in (0, 1))
            starts = [np.concatenate([[0], np.cumsum([len(t[i]) for t in tokens])]).astype(np.int64) for i in (0, 1)]

            def ends(x, sizes, start):
                total = np.concatenate([[0], np.cumsum(sizes[x])])
                return total[1:] - np.repeat(total[start[:-1]], np.diff(start))

            (doc, at_a, at_b), (cut_doc, cut_a, cut_b) = lockstep(ends(a, own.sizes_a, starts[0]), starts[0], ends(b, own.sizes_b, starts[1]), starts[1])
            n_links, n_groups = np.bincount(doc, minlength=n), np.bincount(cut_doc, minlength=n)
            # The distinct pairs of each document, with how often it holds them; then those of the block.
            pair, where = np.unique((a[at_a] << _PAIR) | b[at_b], return_inverse=True)
            held, times = np.unique(doc * max(1, len(pair)) + where, return_counts=True)
            held_doc, held_pair = np.divmod(held, max(1, len(pair)))
            parts = np.searchsorted(held_doc, np.arange(n + 1))
            order = np.lexsort((cut_a, cut_doc))
            cut_a, cut_b, of = cut_a[order], cut_b[order], np.concatenate([[0], np.cumsum(n_groups)])
            texts = []
            for i in range(n):
                mine = slice(of[i], of[i + 1])
                text = text_of.of(*tokens[i], cut_a[mine] - starts[0][i], cut_b[mine] - starts[1][i]) if n_groups[i] else b""
                texts.append(text.decode() if groups == "text" else hashlib.sha256(text).hexdigest() if text else "")
            block = (task << 32) + number
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), pa.concat_arrays(ids), *(pa.array(np.asarray(x, np.int64)) for x in (np.diff(starts[0]), np.diff(starts[1]), n_groups, n_links)), pa.array(texts, pa.string()),
                pa.array([held_pair[parts[i] : parts[i + 1]].astype("<u4").tobytes() for i in range(n)], pa.binary()),
                pa.array([times[parts[i] : parts[i + 1]].astype("<u4").tobytes() for i in range(n)], pa.binary()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
            holders = np.bincount(held_pair, minlength=len(pair))
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.nulls(1, ids[0].type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([pair], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64()))], names)

        for batch in short(batches):
            texts = batch.column(1).to_pylist()
            for i, (text, both) in enumerate(zip(texts, own.both(texts))):
                ids.append(batch.column(0).slice(i, 1))
                tokens.append(both)
                size += len(text or "") + 64
                if size >= BLOCK_BYTES:
                    yield from finished()
                    ids, tokens, size, number = [], [], 0, number + 1
        if ids:
            yield from finished()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "held", "times", "pairs", "holders"]
    return run


def align(docs: DataFrame, path_a: str, path_b: str, groups: str = "text", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents, and links between the ids of two tokenizers, corpus-wide.

    The first table has a row for each document: doc_id, n_a, n_b (tokens of space+text by the byte-level
    tokenizer A and of the text by the piece tokenizer B), n_groups, n_links, groups, n_best, count_sum.  Byte offsets
    at which tokens of both end cut the document into groups, ``a1,a2|b1;a3|b2,b3`` in ids (``groups="sha256"``: only the
    digest of that text).  Two tokens are linked when their byte ranges overlap.  The second table
    has a row for each pair of ids that are linked anywhere: a, b, n (documents that hold the pair linked), best (no
    pair of the same a has a larger n; ties are all best).  A document's n_best and count_sum are the
    number of its links that are best and the sum of n over its links.

    Whole texts are read once; blocks of documents of bounded size name their distinct pairs once, and get the answers on just
    those.  A text that is null or empty, or that a tokenizer changes, has no tokens: zeros and empty
    groups.  Rows that repeat count each; an id may be null; other columns are not read; empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [
        T.StructField("groups", T.StringType()), T.StructField("held", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("holders", T.ArrayType(T.LongType()))])
    found = written(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_aligned(path_a, path_b, groups), schema), "aligned")
    named = found.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("nth", "p")).select("block", "nth", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = named.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", _PAIR))
    # Few ids, very many pairs of some: the largest count of an id is joined back, no id is gathered.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    links = written(counts.join(most, "a").select("pair", "a", F.col("pair").bitwiseAND((1 << _PAIR) - 1).alias("b"), "n", (F.col("n") == F.col("most")).alias("best")), "links")
    answers = named.select("block", "nth", "pair").join(links.select("pair", "n", "best"), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("nth", "n", "best"))).alias("answers"))
    answers = answers.select("block", F.col("answers.n").alias("n"), F.col("answers.best").alias("best"))

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        best = right.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for held, times in zip(left.column("held").to_pylist(), left.column("times").to_pylist()):
            which, times = np.frombuffer(held, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            out.append((int((times * best[which]).sum()), int((times * n[which]).sum())))
        return left.drop_columns(["block", "held", "times"]).append_column("n_best", pa.array([x for x, _ in out], pa.int64())).append_column("count_sum", pa.array([x for _, x in out], pa.int64()))

    rows = found.filter("pairs is null").drop("pairs", "holders")
    rows = rows.toDF(*rows.columns)  # columns of their own, as both sides come from one table
    result = T.StructType([schema[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    documents = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(told, result)
    return documents, links.select("a", "b", "n", "best")
