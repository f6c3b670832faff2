"""Best-fit packing of tokenised documents by exact complements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections import Counter
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measureframe.llm.store import short, written
from measureframe.llm.tokens import byte_bpe

def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``size``."""
    head = n % size if n % size or not n else size
    return [(0, head), *((i, size) for i in range(head, n, size))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids (little-endian u32), task, nth.

    (task, length, nth) numbers the pieces of each length without gaps within the task that
    made them.  A null text counts as empty and gives one piece, the end id alone.
    """
    def run(batches):
        task, seen, encoder = TaskContext.get().partitionId(), Counter(), byte_bpe(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in short(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc, k, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    types = [pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary, task int, nth bigint")


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths in it, how many such sequences), from how many pieces have each length.

    From the longest down, the gap that a piece leaves is filled exactly by one, two or
    three others while the counts last, as many sequences at once as the scarcest of
    the lengths allows, so each step uses up a length.  What has no exact complement goes
    best fit: into the smallest gap that takes it.  Work and result are bounded by the sizes 1 to
    ``size``, whatever the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[list[int], int]] = []
    rest: dict[int, int] = {}

    def pair(total: int, low: int = 1) -> tuple[int, int] | None:
        """Two lengths with this sum that are left, the larger as large as can be."""
        if total < 2:
            return None
        a = np.arange((total + 1) // 2, total)  # a >= total - a
        good = (left[a] > 0) & (left[total - a] > 0) & ((a != total - a) | (left[a] > 1))
        at = np.flatnonzero(good)
        return (int(a[at[-1]]), int(total - a[at[-1]])) if len(at) else None

    def complement(gap: int) -> list[int] | None:
        if left[gap]:
            return [gap]
        if two := pair(gap):
            return list(two)
        for c in np.flatnonzero(left[1:gap])[::-1] + 1:
            left[c] -= 1
            two = pair(gap - int(c))
            left[c] += 1
            if two:
                return [int(c), *two]
        return None

    for length in range(size, 0, -1):
        while left[length]:
            left[length] -= 1
            others = [] if length == size else complement(size - length)
            left[length] += 1
            if others is None:
                rest[length], left[length] = int(left[length]), 0
                break
            use = Counter([length, *others])
            n = min(int(left[x]) // k for x, k in use.items())
            for x, k in use.items():
                left[x] -= n * k
            done.append(([length, *others], n))

    bins: dict[int, list[tuple[list[int], int]]] = {}  # by gap
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = [g for g in bins if g >= length]
            if fits:
                gap = min(fits)
                held, k = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                take = min(n, k)
                if k > take:
                    bins.setdefault(gap, []).append((held, k - take))
                bins.setdefault(gap - length, []).append(([*held, length], take))
                n -= take
            else:
                each = min(n, size // length)
                take = n // each
                bins.setdefault(size - each * length, []).append(([length] * each, take))
                n -= take * each
    return done + [x for group in bins.values() for x in group]


def runs(planned: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, its sequence, offset); the ranks that follow lie in the sequences that follow."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = Counter(), 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.asarray(rows, np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ids and its place: sequence_id and offset.

    Tokenising is done once, into a written table.  The plan is made from how often each of
    the at most ``size`` lengths occurs, and is as small.  A piece's rank among those of its
    length is its number in its task plus the sum over earlier tasks, so equal
    lengths, however many, are never gathered.  Null texts count as empty, rows that
    repeat are packed each, an empty table gives no rows; other columns are not read.
    """
    cutting = written(pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces")
    by_task = written(cutting.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = runs(plan(counts, size))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = table[int(n)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                sequence[own], offset[own] = at[:, 1] + rank[own] - at[:, 0], at[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    kind = dict(cutting.dtypes)["doc_id"]
    return cutting.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids", "nth", "before").mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")
