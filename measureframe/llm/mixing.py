"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measureframe.llm.store import shard_count, shard_of

#: Rows that are ranked in one task, at most as an average.
SHARD_ROWS = 20_000
#: The name under which all sources without a weight of their own are mixed.
OTHER = "*"


def schedule(weights: dict[str, int]) -> list[tuple[str, int]]:
    """One period of earliest-deadline-first: (source, its block in the period) for each slot.

    The period has as many slots as the weights sum to.  With share u of a source, its block j
    (from 0) is released at floor(j / u) and due at ceil((j + 1) / u).  At every slot
    the released block with the nearest deadline goes, ties by the name.  Shares sum to one,
    so every block meets its deadline, and after any number of slots no source is a
    whole block away from its share.
    """
    period = sum(weights.values())
    release = lambda s, j: j * period // weights[s]
    deadline = lambda s, j: -(-(j + 1) * period // weights[s])
    waiting = [(0, s, 0) for s, w in weights.items() if w]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    slots = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a block misses its deadline")
        slots.append((s, j))
        heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return slots


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """Weights over their common divisor; zero or negative weights are an error."""
    if any(w <= 0 or w != int(w) for w in weights.values()):
        raise ValueError("weights are positive integers")
    common = gcd(*weights.values()) if weights else 1
    return {s: w // common for s, w in weights.items()}


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, dict[str, int], dict[str, int], int]]:
    """(first slot, blocks of each source gone before, weights, periods begun) of each phase.

    A phase ends with the period in which the first of its sources runs out; the next one goes
    on with the other sources and their weights.  There are no more phases than sources.
    """
    gone, first, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - gone[s] for s, n in blocks.items() if n > gone[s]}:
        own = reduced({s: weights[s] for s in left})
        rounds = min(-(-n // own[s]) for s, n in left.items())
        out.append((first, dict(gone), own, rounds))
        first += rounds * sum(own.values())
        for s in left:
            gone[s] += min(left[s], rounds * own[s])
    return out


class Slots:
    """Where each turn of a stream goes: for every stream its phases in order, as measured on the driver.

    All phases together are as long as their periods; a task looks its rows up in arrays.
    """

    def __init__(self, parts: list[tuple[int, dict[str, int], dict[str, int], int]]) -> None:
        self.phases: dict[str, list[tuple[int, int, int, np.ndarray]]] = {}
        for first, gone, own, _ in parts:
            at: dict[str, list[int]] = {s: [] for s in own}
            for k, (s, _) in enumerate(schedule(own)):
                at[s].append(k)
            period = sum(own.values())
            for s in own:
                self.phases.setdefault(s, []).append((gone[s], first, period, np.array(at[s], np.int64)))

    def of(self, stream: str, turns: np.ndarray) -> np.ndarray:
        phases = self.phases[stream]
        which = np.searchsorted([p[0] for p in phases], turns, side="right") - 1
        out = np.empty(len(turns), np.int64)
        for k in np.unique(which):
            gone, first, period, at = phases[k]
            rounds, nth = np.divmod(turns[which == k] - gone, len(at))
            out[which == k] = first + rounds * period + at[nth]
        return out


def _by_stream(streams: pd.Series, numbers: pd.Series, function) -> pd.Series:
    """``function(stream, numbers of its rows)`` brought back to the rows."""
    out = np.empty(len(streams), np.int64)
    codes, names = pd.factorize(streams)
    for k, name in enumerate(names):
        out[codes == k] = function(name, numbers.to_numpy(np.int64)[codes == k])
    return pd.Series(out, streams.index)


def ranked(docs: DataFrame, source_col: str, weights: dict[str, int], id_col: str) -> DataFrame:
    """Every row (in ``row``) with its mixed source ``stream`` and its rank in it, from 0.

    The order in a source is by a hash of the row, then by its id.  Ranks are counted in shards
    and carried over them, so a source is never in one task.
    """
    names = [F.lit(s) for s in weights if s != OTHER]
    stream = F.when(F.col(f"row.{source_col}").isin(*names), F.col(f"row.{source_col}")).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)
    shards = shard_count(docs.count(), SHARD_ROWS)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("order"), F.col(id_col).alias("id")).withColumn("stream", stream).withColumn("shard", shard_of(shards, F.col("order")))
    carried = rows.groupBy("stream", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("stream").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy("stream", "shard").orderBy("order", "id")) - 1)
    return inside.join(carried.drop("n"), ["stream", "shard"]).select("row", "stream", (F.col("nth") + F.col("before")).alias("rank"))


def mix(docs: DataFrame, weights: dict[str, int], block_docs: int = 64, repeat: bool = False, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Every row with its place in the mixture: stream, block, epoch, slot, place, and the row in ``row``.

    ``weights`` gives integer target weights by source; sources without one, and null, are
    mixed together under ``"*"`` (weight 1 unless given).  A source is cut into blocks of
    ``block_docs`` documents and slots are dealt to blocks by ``schedule``, one period after the
    other.  While all sources last, any run of slots from the start holds each of them
    to its share within less than a block.

    Without ``repeat`` every row comes once; a source that has run out leaves its share to the others.
    With it, sources that run out begin again (``epoch`` 1, 2 ...) until each has come
    whole at least once, so the shares hold to the end and no row is lost.

    The driver holds a period of the schedule for each phase, as long as the sum of the weights left in it, and block
    counts of the weighted sources; tasks get both as tables, the plan is the same for any number of sources.  Rows that repeat are mixed each; an empty table gives no rows;
    columns may have any names and types but maps in the order's hash.
    """
    weights = reduced({OTHER: 1} | weights)
    rows = ranked(docs, source_col, weights, id_col)
    counts = {r.stream: r.n for r in rows.groupBy("stream").agg((F.max("rank") + 1).alias("n")).collect()}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    weights = reduced({s: weights[s] for s in counts}) if counts else {}
    block = (F.col("rank") / block_docs).cast("long")
    placed = rows.withColumn("block", block).withColumn("place", (F.col("rank") % block_docs).cast("int"))
    spark = docs.sparkSession
    if repeat and counts:
        # As many periods as the source needs that takes longest; earlier epochs of others follow each other.
        periods = max(-(-n // weights[s]) for s, n in blocks.items())
        # A small table beside the rows: each Python function in a stage would keep workers of its own, with all that they have loaded.
        lengths = spark.createDataFrame(pa.table({"stream": list(blocks), "blocks": list(blocks.values()), "turns": [periods * weights[s] for s in blocks]}))
        placed = placed.join(F.broadcast(lengths), "stream")
        last = F.expr("(turns - block - 1) div blocks")
        placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        placed = placed.withColumn("turn", F.col("block") + F.col("epoch") * F.col("blocks"))
        parts = [(0, dict.fromkeys(counts, 0), weights, periods)]
    else:
        placed = placed.withColumn("epoch", F.lit(0).cast("long")).withColumn("turn", F.col("block"))
        parts = phases(blocks, weights)
    table = spark.sparkContext.broadcast(Slots(parts))

    def slots(streams: pd.Series, turn: pd.Series) -> pd.Series:
        return _by_stream(streams, turn, lambda s, t: table.value.of(s, t))

    return placed.select("row", "stream", "block", "epoch", F.pandas_udf(slots, "long")("stream", "turn").alias("slot"), "place")
