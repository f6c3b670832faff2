"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.store import settled_in, short, shard_count, shard_of, written
from measureframe.llm.words import mixed

#: Bytes of context; a gram is a context and the symbol behind it.
ORDER = 5
#: Symbols have 9 bits: the bytes, and 256 for the border before and behind a text.
BITS, BORDER = 9, 256
SYMBOL = (1 << BITS) - 1
#: Bytes of text that one block holds, as an average, and that are turned into grams at once.
BLOCK_BYTES, CHUNK = 24 << 20, 1 << 20
#: The last symbols of a context by which grams are dealt out; shorter contexts are few enough to send along.
SHORT = 2


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def grams(body: bytes, order: int = ORDER):
    """The grams of a text and its end, one a position, in chunks; the text follows ``order`` borders."""
    codes = np.empty(len(body) + order + 1, np.int64)
    codes[:order] = BORDER
    codes[order:-1] = np.frombuffer(body, np.uint8)
    codes[-1] = BORDER
    for begin in range(0, len(body) + 1, CHUNK):
        size = min(CHUNK, len(body) + 1 - begin)
        gram = np.zeros(size, np.int64)
        for i in range(order + 1):
            gram = gram << BITS | codes[begin + i : begin + i + size]
        yield gram


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def squeezed(values: np.ndarray) -> bytes:
    """An array of eight-byte values in few bytes; of integers, bytes of one weight lie side by side."""
    raw = values.view(np.uint8)
    return pa.compress(np.ascontiguousarray(raw.reshape(-1, 8).T) if values.dtype == np.int64 else raw, codec="zstd", asbytes=True)


def restored(packed: bytes, size: int, kind: type) -> np.ndarray:
    """The ``size`` values that ``squeezed`` made ``packed`` of."""
    raw = np.frombuffer(pa.decompress(packed, 8 * size, codec="zstd", asbytes=True), np.uint8)
    return (np.ascontiguousarray(raw.reshape(8, -1).T) if kind is np.int64 else raw).reshape(-1).view(kind)


class Trie:
    """The contexts of some grams, of every length from ``low`` to ``order``, as sorted arrays.

    For a level k: the grams of k symbols of context with their counts, and for each context its total, the
    number of its symbols, and how often those symbols come in the context one shorter.
    The levels below are in ``below``, a trie of the short contexts of all grams.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: int = 0, below: Trie | None = None) -> None:
        self.low, self.order, self.below = low, order, below
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        seen = counts > 0
        keys, counts = _summed(keys[seen], counts[seen])
        for k in range(order, low - 1, -1):
            if k < order:
                keys, counts = _summed(keys & ((1 << BITS * (k + 1)) - 1), counts)
            self.grams[k] = keys, counts
        for k in range(order, low - 1, -1):
            keys, counts = self.grams[k]
            contexts, first, size = np.unique(keys >> BITS, return_index=True, return_counts=True) if len(keys) else (keys, keys, keys)
            total = np.add.reduceat(counts, first) if len(keys) else counts
            shorter = self.count(k - 1, keys & ((1 << BITS * k) - 1)) if k else counts
            again = np.add.reduceat(shorter, first) if len(keys) else counts
            self.contexts[k] = contexts, total, size.astype(np.int64), again

    def count(self, k: int, keys: np.ndarray) -> np.ndarray:
        """How often each gram with k symbols of context comes."""
        if k < self.low:
            return self.below.count(k, keys)
        return _looked_up(*self.grams[k], keys)

    def context(self, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, symbols, and the symbols' count one level below, of each context; zeros for one never met."""
        if k < self.low:
            return self.below.context(k, contexts)
        keys, *values = self.contexts[k]
        return tuple(_looked_up(keys, v, contexts) for v in values)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol behind its context.

        From the longest context down: of T symbols of D kinds met there, one met c times has the share
        (2c - 1) / 2T; for one not met the escape D / 2T is paid and the next
        shorter context asked, without the symbols that the longer one knows.  A context
        never met costs nothing.  Below the empty context all symbols left are alike.
        """
        result, open_ = np.zeros(len(keys)), np.arange(len(keys))
        without, kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(self.order, -1, -1):
            own = keys[open_] & ((1 << BITS * (k + 1)) - 1)
            n = self.count(k, own)
            total, symbols, again = self.context(k, own >> BITS)
            left, fresh = total - without, symbols - kinds
            met = n > 0
            result[open_[met]] += np.log10((2 * n[met] - 1) / (2 * left[met]))
            escape = ~met & (fresh > 0)
            result[open_[escape]] += np.log10(fresh[escape] / (2 * left[escape]))
            open_, without, kinds = open_[~met], again[~met], symbols[~met]
        result[open_] -= np.log10(np.maximum(BORDER + 1 - kinds, 1))
        return result


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key; 0 for one that is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def adaptive(body: bytes, order: int = ORDER) -> float:
    """log10 probability of a text by a model that begins empty and learns each symbol after coding it."""
    counts: dict[tuple[int, int], Counter] = {}
    total, history = 0.0, [BORDER] * order
    for symbol in [*body, BORDER]:
        excluded: set[int] = set()
        paid = False
        for k in range(order, -1, -1):
            context = 1
            for s in history[len(history) - k :]:
                context = context << BITS | s
            met = counts.setdefault((k, context), Counter())
            live = {s: n for s, n in met.items() if s not in excluded}
            if not paid and live:
                share = 2 * live[symbol] - 1 if symbol in live else len(live)
                total += np.log10(share / (2 * sum(live.values())))
                paid = symbol in live
                excluded |= live.keys()
            met[symbol] += 1
        if not paid:
            total -= np.log10(BORDER + 1 - len(excluded))
        history = [*history[1:], symbol]
    return float(total)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram, by the last symbols of its context."""
    tail = keys >> BITS & ((1 << BITS * SHORT) - 1)
    return (mixed(tail.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)


#: The columns of what a block names: packed grams of one part with their counts, or a short gram or a word with its count.
_COUNTED = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("short", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _counted(order: int, parts: int):
    """Per task and block: distinct grams, in order and packed by part, short grams and words, with their counts among the training rows."""

    class Block:
        def __init__(self, number: int) -> None:
            self.number, self.raw, self.fresh, self.summed, self.words = number, [], 0, [], Counter()

        def add(self, body: bytes, trains: bool) -> None:
            for gram in grams(body, order):
                self.raw.append(gram << 1 | int(trains))
                self.fresh += len(gram)
            if self.fresh > 2 * CHUNK:
                self.shrink()
            if trains:
                self.words.update(body.split())
            else:
                self.words.update(dict.fromkeys(body.split(), 0))

        def shrink(self) -> None:
            """Raw grams give way to distinct ones with counts, so memory follows the distinct ones."""
            keys, counts = np.unique(np.concatenate(self.raw), return_counts=True)
            self.summed.append((keys >> 1, counts * (keys & 1)))
            if len(self.summed) > 8:
                self.summed = [_summed(*map(np.concatenate, zip(*self.summed)))]
            self.raw, self.fresh = [], 0

        def rows(self):
            self.shrink()
            keys, counts = _summed(*map(np.concatenate, zip(*self.summed)))
            part = part_of(keys, parts)
            at = np.argsort(part, kind="stable")
            own = np.split(at, np.flatnonzero(np.diff(part[at])) + 1)
            yield self.batch(len(own), part=part[[i[0] for i in own]], size=[len(i) for i in own], grams=[squeezed(keys[i]) for i in own], counts=[squeezed(counts[i]) for i in own])
            low, n = _summed(keys & ((1 << BITS * SHORT) - 1), counts)
            yield self.batch(len(low), short=low, n=n)
            yield self.batch(len(self.words), word=list(self.words), n=list(self.words.values()))

        def batch(self, rows: int, **columns):
            columns["block"] = np.full(rows, self.number, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _COUNTED], schema=_COUNTED)

    def run(batches):
        block = None
        for batch in short(batches):
            for at, trains, text in zip(*(batch.column(c).to_pylist() for c in ("block", "trains", "text"))):
                if block is None or at != block.number:
                    if block:
                        yield from block.rows()
                    block = Block(at)
                block.add(lowered(text), trains)
        if block:
            yield from block.rows()

    return run


def score(docs: DataFrame, training: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Texts are lower-cased (A-Z).  ``score`` is the log10 probability of the text's bytes and its end by a byte-context trie of
    ``order`` symbols learned from all rows where ``training`` holds; ``base_score`` that of its words and
    its end by smoothed word counts of the same rows.

    The model is never in one place.  Documents are dealt into blocks of bounded size; a block names its distinct
    grams and words and their counts.  Grams are dealt out by the last symbols of their contexts, so
    all levels of the trie above those meet in one task, and only the levels below, at most 257**2
    grams, are sent to all.  Each task answers with the probabilities of the grams that blocks
    asked for; a block then scores its texts with just the answers that it needs.

    A null text counts as empty: one token, its end.  Rows that repeat are learned and scored each; other columns
    are not read; an empty table gives no rows.  Without training rows every symbol is as likely as any.
    """
    return settled_in(docs.sparkSession, lambda: _score(docs, training, order, id_col, text_col), "scores")


def _score(docs: DataFrame, training: Column, order: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.count(F.when(training, 1)).alias("ends")).first()
    blocks = shard_count(size.bytes + size.n, BLOCK_BYTES)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("trains"), text.alias("text"))
    rows = rows.withColumn("block", shard_of(blocks, F.col("doc_id"), F.col("text")))
    dealt = rows.repartition(blocks, "block").sortWithinPartitions("block")
    parts = max(64, 4 * blocks)
    counted = written(dealt.mapInArrow(_counted(order, parts), "block int, part int, size bigint, grams binary, counts binary, short bigint, word binary, n bigint"), "grams")

    words = counted.filter("word is not null")
    known = words.groupBy("word").agg(F.sum("n").alias("c"))
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("words")).first()
    # The end is a word of its own, once in every training text.
    tokens, distinct = sums.tokens + size.ends, sums.words + (size.ends > 0)
    floor = float(np.log10(tokens + 0.5 * (distinct + 1)))
    answer_type = "block int, size bigint, grams binary, values binary, word binary, c bigint"
    none = [F.lit(None).cast(kind_).alias(name) for name, kind_ in (("size", "bigint"), ("grams", "binary"), ("values", "binary"))]
    answered_words = words.select("block", "word").join(known, "word").select("block", *none, "word", "c")

    low = counted.filter("short is not null").groupBy("short").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    lower = Trie(low.column(0).to_numpy(), low.column(1).to_numpy(), SHORT - 1)
    sent = spark.sparkContext.broadcast(lower)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        # One row for each block: its grams in this part, in order, and their values.
        own = [restored(p, n, np.int64) for p, n in zip(group["grams"], group["size"])]
        gram, n = np.concatenate(own), np.concatenate([restored(p, n, np.int64) for p, n in zip(group["counts"], group["size"])])
        distinct = np.unique(gram)
        values = Trie(gram, n, order, SHORT, sent.value).log10(distinct)
        return pd.DataFrame({
            "block": group["block"], "size": group["size"], "grams": group["grams"], "values": [squeezed(values[np.searchsorted(distinct, g)]) for g in own],
            "word": None, "c": pd.array([None] * len(own), "Int64")})

    asked = counted.filter("part is not null").select("block", "part", "size", "grams", "counts")
    answers = asked.groupBy("part").applyInPandas(answer, answer_type).union(answered_words)

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        packed = right["word"].isna().to_numpy()
        sizes = right["size"][packed].astype(np.int64)
        # A hash table: a search in sorted grams takes several times as long.
        place = pd.Index(np.concatenate([restored(p, n, np.int64) for p, n in zip(right["grams"][packed], sizes)]))
        share = np.concatenate([restored(p, n, np.float64) for p, n in zip(right["values"][packed], sizes)])
        counts = dict(zip(right["word"][~packed], right["c"][~packed].astype(np.int64)))
        out = []
        for trains, text in zip(left["trains"], left["text"]):
            body = lowered(text)
            total = sum(float(share[place.get_indexer(g)].sum()) for g in grams(body, order))
            found = np.array([counts[w] for w in body.split()] + [size.ends], np.int64)
            base = float(np.log10(found + 0.5).sum() - floor * len(found))
            out.append((bool(trains), len(found), int((found > 0).sum()), tokens, base, total))
        columns = list(zip(*out)) if out else [[]] * 6
        return pd.DataFrame({"doc_id": left["doc_id"], **{f.name: pd.Series(c, index=left.index, dtype=k) for f, c, k in zip(fields[1:], columns, ("bool", "int64", "int64", "int64", "float64", "float64"))}})

    fields = [T.StructField("doc_id", kind), T.StructField("trained", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, T.StructType(fields))
