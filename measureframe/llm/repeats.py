"""Removal of long strings that occur before, by suffix arrays over the places that can repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm import suffixes
from measureframe.llm.store import shard_count, short, written
from measureframe.llm.words import mixed

#: Bytes of text that one task sorts, on average, and queue entries that it holds before they go to disk.
SHARD_BYTES, QUEUE_ENTRIES = 4 << 20, 1 << 24
#: Distinct stretches with one key beyond which they are dealt out anew, window by window.
HOT = 20_000
#: Bytes of a gram, at most; a window of the wanted length holds several.
GRAM = 32


def _gram_hashes(text: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at every place."""
    n = len(text) - size + 1
    padded = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    if size < 8:
        return mixed((words[:n] & np.uint64((1 << 8 * size) - 1)) * np.uint64(0x9E3779B97F4A7C15))
    hashes = mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15))
    for at in [*range(8, size - 7, 8), *([size - 8] if size % 8 else [])]:
        hashes = mixed((hashes + words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15))
    return hashes


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of ``width`` values from every place: two running extremes in blocks of that width."""
    pick, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    blocks = np.concatenate([values, np.full(-len(values) % width, fill, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key, twice) of the stretches that a text's windows of ``length`` bytes fall into.

    A window's key is the least hash among its grams, so equal windows have equal keys wherever they are.  A
    stretch is a run of windows with one key.  ``twice``: the gram comes more than once in it, without
    which no window can come twice in the stretch.
    """
    size = min(GRAM, max(1, length // 3))
    hashes = _gram_hashes(text, size)
    width = length - size + 1
    least = _sliding(hashes, width, True)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    windows = np.diff(np.append(start, len(least)))
    # Places whose gram is the least of some window; two neighbours among them with one hash are in one stretch or next to it.
    spread = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, False)
    chosen = np.flatnonzero(spread == hashes)
    twin = np.flatnonzero(hashes[chosen[1:]] == hashes[chosen[:-1]])
    twice = np.zeros(len(start), bool)
    for place in (chosen[twin], chosen[twin + 1]):
        for at in (np.maximum(place - width + 1, 0), np.minimum(place, len(least) - 1)):
            here = np.searchsorted(start, at, side="right") - 1
            for by in (-1, 0, 1):
                near = np.clip(here + by, 0, len(start) - 1)
                same = least[start[near]] == hashes[place]
                twice[near[same]] = True
    return start, windows, least[start], twice


def _stretched(length: int, id_type: T.DataType):
    """A function on batches (id, sum, text): a row for each stretch, told apart where its key repeats in the batch already."""
    def run(batches):
        for batch in short(batches, 1024):
            rows, parts, digests = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                body = (text or "").encode()
                if len(body) < length:
                    continue
                start, windows, key, twice = stretches(body, length)
                rows.append(np.full(len(start), i))
                parts.append((start, windows, key, twice))
                digests += [xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(start.tolist(), (start + windows + length - 1).tolist())]
            if not rows:
                continue
            row = np.concatenate(rows)
            start, windows, key, twice = (np.concatenate(c) for c in zip(*parts))
            values, where, times = np.unique(key, return_inverse=True, return_counts=True)
            known = (times > 1)[where] | twice
            # One row without a place tells other tasks of a key that repeats here.
            told = values[np.unique(where[known])]
            n, m = len(row), len(told)
            pad = lambda x, fill: pa.array(np.concatenate([x, np.full(m, fill, x.dtype)]))
            at = pa.array(np.concatenate([row, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([key, told]).view(np.int64)), pad(np.array(digests, np.uint64).view(np.int64), 0), batch.column(0).take(at), batch.column(1).take(at),
                pad(start.astype(np.int32), -1), pad(windows.astype(np.int32), 0), pad(twice, False), pad(known, False)], names)

    names = ["key", "digest", "id", "sum", "start", "windows", "twice", "known"]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("id", id_type), T.StructField("sum", T.LongType()),
                           T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("twice", T.BooleanType()), T.StructField("known", T.BooleanType())])
    return run, schema


def _cut(length: int, id_type: T.DataType):
    """A function on batches (id, sum, text, wanted): the bytes of the wanted stretches; hot ones window by window."""
    def run(batches):
        for batch in short(batches):
            out = []
            for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                body = text.encode()
                for w in wanted:
                    start, end = w["start"], w["start"] + w["windows"]
                    if w["hot"]:
                        out += [(i, xxhash.xxh3_64_intdigest(body[a : a + length]), a, body[a : a + length]) for a in range(start, end)]
                    else:
                        out.append((i, w["key"] & (2**64 - 1), start, body[start : end + length - 1]))
            if out:
                row, key, start, body = zip(*out)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(key, pa.uint64()).view(pa.int64()), pa.array(start, pa.int32()), pa.array(body, pa.binary())], names)

    names = ["id", "sum", "key", "start", "body"]
    return run, T.StructType([T.StructField("id", id_type), T.StructField("sum", T.LongType()), T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("body", T.BinaryType())])


def earlier_windows(strings: list[bytes], length: int, memory: int) -> list[tuple[int, int, int]]:
    """(string, first, end) of the runs of windows that also occur earlier, in an earlier string or in the same one.

    Of a string that is one period over and over only the first period's windows are sorted; all later ones repeat them.
    """
    strings, tails = list(strings), []
    for k, s in enumerate(strings):
        if len(s) >= 4 * length and (period := s.find(s[:length], 1)) > 0 and s[period:] == s[:-period]:
            strings[k] = s[: period + length - 1]
            tails.append((k, period, len(s) - length + 1))
    if not strings:
        return []
    ends = np.cumsum([len(s) + 1 for s in strings])
    starts = ends - [len(s) + 1 for s in strings]
    total = int(ends[-1])
    whole = np.zeros(total + 1, np.int32)  # +1 where windows begin, -1 behind the last one
    many = np.maximum(0, np.array([len(s) for s in strings], np.int64) - length + 1)
    np.add.at(whole, starts, many > 0)
    np.add.at(whole, starts + many, -(many > 0).astype(np.int32))
    whole = np.cumsum(whole) > 0
    covered = np.zeros(total + 1, bool)
    rest: list[np.ndarray] = []

    def settle(places: np.ndarray, new: np.ndarray) -> None:
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(places, first)
        later = places != np.repeat(least, np.diff(np.append(first, len(places))))
        covered[places[later]] = True

    def found(positions: np.ndarray, common: np.ndarray) -> None:
        """A run of suffixes that agree in ``length`` bytes may go on in the next batch, so the last run waits."""
        positions, new = positions.astype(np.int64), common < length
        if rest and not new.any():
            rest.append(positions)
            return
        held = sum(map(len, rest))
        places, new = np.concatenate([*rest, positions]), np.concatenate([np.zeros(held, bool), new])
        new[:1] = True
        if not len(places):
            return
        last = int(np.flatnonzero(new)[-1])
        rest[:] = [places[last:]]
        inside = whole[places[:last]]
        chosen, begins = places[:last][inside], np.cumsum(new[:last])[inside]
        if len(chosen):
            settle(chosen, np.concatenate([[True], begins[1:] != begins[:-1]]))

    suffixes.suffix_array(strings, length, memory, found)
    if rest:
        last = np.concatenate(rest)
        last = last[whole[last]]
        if len(last):
            settle(last, np.concatenate([[True], np.zeros(len(last) - 1, bool)]))
    steps = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    first, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    of = np.searchsorted(ends, first, side="right")
    return list(zip(of.tolist(), (first - starts[of]).tolist(), (end - starts[of]).tolist())) + tails


def _sorted(length: int, memory: int, id_type: T.DataType):
    """A function on batches sorted by (shard, place): runs of windows of each stretch that also occur earlier.

    Rows that repeat id and text bring a stretch more than once; it is one place.
    """
    def run(batches):
        shard, held = None, []

        def solved():
            runs = earlier_windows([b for _, _, _, b in held], length, memory)
            if runs:
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([held[k][0] for k, _, _ in runs]), pa.array([held[k][1] for k, _, _ in runs], pa.int64()),
                    pa.array([held[k][2] + a for k, a, _ in runs], pa.int32()), pa.array([b - a for _, a, b in runs], pa.int32())], ["id", "sum", "start", "windows"])

        for batch in batches:
            sums, starts, bodies = (batch.column(c).to_pylist() for c in ("sum", "start", "body"))
            for i, at in enumerate(batch.column("shard").to_pylist()):
                if at != shard:
                    yield from solved()
                    shard, held = at, []
                if not (held and held[-1][1:3] == (sums[i], starts[i]) and held[-1][0].equals(batch.column("id").slice(i, 1))):
                    held.append((batch.column("id").slice(i, 1), sums[i], starts[i], bodies[i]))
        yield from solved()

    return run, T.StructType([T.StructField("id", id_type), T.StructField("sum", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType())])


def covered_bytes(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _removed(length: int, docs_type: T.StructType, text_at: str):
    """A function on batches (row, nth, stretches, firsts, runs): the row, what is left of its text, and the removed runs."""
    def run(batches):
        for batch in short(batches):
            texts, spans = [], []
            columns = (batch.column(c).to_pylist() for c in ("nth", "places", "firsts", "runs"))
            for text, nth, places, firsts, runs in zip(batch.column("row").field(text_at).to_pylist(), *columns):
                body = (text or "").encode()
                if nth > 1:  # a row that repeats id and text
                    found = [(0, len(body))] if len(body) >= length else []
                else:
                    first = set(firsts or ())
                    found = [(p["start"], p["start"] + p["windows"] + length - 1) for p in places or () if p["start"] not in first]
                    found = covered_bytes(found + [(r["start"], r["start"] + r["windows"] + length - 1) for r in runs or ()])
                kept, at = [], 0
                for start, end in found:
                    kept.append(body[at:start])
                    at = end
                texts.append(b"".join([*kept, body[at:]]))
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["row", "kept", "removed"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return run, T.StructType([T.StructField("row", docs_type), T.StructField("kept", T.BinaryType()), T.StructField("removed", span)])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row, in ``row``, with the bytes that are ``kept`` of its text and the runs ``removed`` (start, end), in UTF-8 bytes.

    Each byte goes that lies in a string of ``length`` bytes which also starts earlier: in a document with a smaller id, or
    in the same one before.  Strings are judged on the input and do not cross documents.

    A window of that length is known by the least hash of its grams, so a text falls into stretches of windows
    with one key, and equal windows have equal keys.  Stretches whose key comes once are out.  Of stretches that are equal as a
    whole (64-bit key and 64-bit digest) only the first is looked into; the others go.  What is left is dealt into shards by
    key and each shard's strings are sorted by ``suffixes.suffix_array``: a run of suffixes with a common prefix of ``length``
    bytes keeps its earliest place.  A key with very many distinct stretches is dealt out by whole windows instead, so no
    group grows with the rows.

    A null text counts as empty; a null id comes last; rows with one id are ordered by a hash of their texts, and of rows that repeat
    both the others count as later.  Other columns pass through under any name.  An empty table gives no rows.
    """
    if length < 3:
        raise ValueError("strings to look for have three bytes or more")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))
    # As a field of a struct a null id equals a null id, so one plain key serves joins, groups and windows.
    at = F.struct("id", "sum").alias("at")
    id_type = docs.schema[id_col].dataType
    run, schema = _stretched(length, id_type)
    rows = keyed.mapInArrow(run, schema)
    # Rows that are known to repeat need no meeting; of the others a task sends each key once, so no key is hot.
    deal = F.when(F.col("known"), F.xxhash64("key", "id", "sum", "start")).otherwise(F.col("key"))
    seen = rows.withColumn("deal", deal).repartition("deal").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("deal")))
    places = written(seen.filter("(known or n > 1) and windows > 0").select("key", "digest", "id", "sum", "start", "windows", "twice"), "places")

    order = F.struct(F.col("id").isNull().alias("none"), "id", "sum", "start")
    firsts = written(places.groupBy("key", "digest").agg(F.min(order).alias("first"), F.first("windows").alias("windows"), F.max("twice").alias("twice")), "firsts")
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any_twice")).filter("n > 1 or any_twice")
    wanted = firsts.join(several, "key").select(F.col("first.id").alias("id"), F.col("first.sum").alias("sum"), F.struct("key", F.col("first.start").alias("start"), "windows", (F.col("n") > HOT).alias("hot")).alias("w"))
    lists = wanted.groupBy(at).agg(F.collect_list("w").alias("wanted"))
    size = wanted.agg(F.coalesce(F.sum(F.when(F.col("w.hot"), F.col("w.windows") * length).otherwise(F.col("w.windows") + length - 1)), F.lit(0)).alias("bytes")).first().bytes
    once = keyed.select(at, "text").join(lists, "at").select("at.id", "at.sum", "text", "wanted")
    run, schema = _cut(length, id_type)
    bodies = once.mapInArrow(run, schema)
    shards = shard_count(size, SHARD_BYTES)
    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("none", F.col("id").isNull())
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "none", "id", "sum", "start")
    run, schema = _sorted(length, QUEUE_ENTRIES, id_type)
    runs = written(dealt.select("shard", "id", "sum", "start", "body").mapInArrow(run, schema), "runs")

    return _applied(docs, places, firsts, runs, length, id_col, text_col)


def _applied(docs, places, firsts, runs, length, id_col, text_col):
    """The places of all stretches, of the first ones among equals, and of the runs found in those, brought to their texts."""
    none = lambda kind: F.lit(None).cast(kind)
    place, kind = F.struct("start", "windows"), "struct<start:int,windows:int>"
    told = places.select("id", "sum", place.alias("place"), none("int").alias("first"), none(kind).alias("run")).union(
        firsts.select("first.id", "first.sum", none(kind), F.col("first.start"), none(kind))).union(
        runs.select("id", "sum", none(kind), none("int"), place))
    lists = told.groupBy(F.struct("id", "sum").alias("at")).agg(F.collect_set("place").alias("places"), F.collect_set("first").alias("firsts"), F.collect_set("run").alias("runs"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(row, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("sum")).alias("at"))
    # Which of several equal rows comes first does not matter; rows of one id and text are few, or all but one of them go.
    found = rows.join(lists, "at", "left").withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(F.lit(0))))
    run, schema = _removed(length, T.StructType(docs.schema.fields), text_col)
    return found.select("row", "nth", "places", "firsts", "runs").mapInArrow(run, schema)


