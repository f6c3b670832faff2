"""Near duplicates by circulant MinHash, every link confirmed on the full shingle sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.components import components
from measureframe.llm.store import settled_in, short, written
from measureframe.llm.words import WordHashes, lower_words, mixed, shingle_set

#: A pair with similarity 0.75 shares none of 48 bands of 5 coordinates once in 430 000; one with more, far less often.
BANDS, ROWS = 48, 5
#: Members of a group of open nodes that are hubs in its first round; each further one has ``GROWTH`` times as many, up to ``MORE_HUBS``.
HUBS, GROWTH, MORE_HUBS = 4, 8, 1024
#: Pairs of each node that are tested one after the other, the likest first, before all that are left.
LIKEST = 3
#: Counters, a power of two, that tell common shingles from rare ones.
COUNTERS = 1 << 20
#: Bits of the parity map of a set, a multiple of 64.
PARITY = 512


def _permuted(x: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """A fixed permutation of the integers below 2**32, element by element, in place."""
    x *= np.uint32(seed[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(seed[1])
    return x


#: Odd multipliers of the two permutations (fixed values).
SIGMA, PI = (0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F)


def signatures(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of each set; sets lie one after the other and are not empty.

    A shingle's place among 2**32 is permuted once by sigma.  Coordinate k is the
    smallest value of pi shifted circularly by k: min over the set of pi(sigma(x) - k mod 2**32).
    """
    first = (shingles >> np.uint64(32)).astype(np.uint32)
    first ^= first >> np.uint32(16)
    _permuted(first, SIGMA)
    first ^= first >> np.uint32(16)
    out = np.empty((size, len(starts)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_permuted(first - np.uint32(k), PI), starts)
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mixed((key + parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
    return key


def features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set), bands (its keys)."""
    def run(batches):
        memo = WordHashes()
        for batch in short(batches):
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(memo.of(lower_words(t)), width) for t in texts]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, BANDS), np.uint64)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                signature = signatures(np.concatenate([sets[i] for i in full]), starts, BANDS * ROWS)
                keys = band_keys(signature, BANDS, ROWS)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) for t in texts], pa.uint64()).view(pa.int64()),
                pa.array(sizes),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(ends, keys.reshape(-1).view(np.int64)),
            ], ["doc_id", "text_hash", "n_shingles", "node", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, node binary, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * intersection >= 75 * union, on the full sets."""
    def run(batches):
        memo, last = WordHashes(), {}
        for batch in short(batches):
            a, b, text_a, text_b = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                if a[i] not in last:  # pairs come sorted by a, as a rule
                    last = {a[i]: shingle_set(memo.of(lower_words(text_a[i])), width)}
                one, two = last[a[i]], shingle_set(memo.of(lower_words(text_b[i])), width)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= 75 * (len(one) + len(two) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return written(with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"), "links")


def _alike_in_size(x: str, y: str):
    """Sets further apart in size cannot reach the similarity."""
    return 100 * F.least(F.col(x), F.col(y)) >= 75 * F.greatest(F.col(x), F.col(y))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def _rarity(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles come in the texts, in ``COUNTERS`` counters by hash; its size is fixed.

    It only orders shingles, so it need not be exact: any one order serves.
    """
    def run(batches):
        memo, counts = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in short(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(counts, _counter(shingle_set(memo.of(lower_words(text)), width)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    found = texts.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return total


def _prefixes(texts: DataFrame, width: int) -> DataFrame:
    """bucket, node, n, place, parity: the rarest shingles of each node, as many as decide a link; ``parity`` at place 0 only.

    In one order of all shingles, rare ones first, sets of sizes m and n with a similarity of 3/4 share o = ceil(3/7 (m + n)), so
    one of those is among the first m - o + 1 places of the one and the first n - o + 1 of the other.  No set needs more
    than its first n - ceil(3/4 n) + 1.  A bit of ``parity`` tells whether an odd number of shingles falls on it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_rarity(texts, width))

    def run(batches):
        memo = WordHashes()
        for batch in short(batches):
            parts, sizes, places, parity = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(memo.of(lower_words(text)), width)
                n = len(own)
                odd = np.bincount((own >> np.uint64(32) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                own = own[np.lexsort((own, sent.value[_counter(own)]))][: n + (-3 * n // 4) + 1]
                parts.append(own)
                sizes.append(n)
                places.append(np.arange(len(own)))
            times = [len(p) for p in parts]
            at = np.concatenate(places)
            maps = np.stack(parity)
            ends = np.concatenate([[0], np.cumsum(at == 0) * maps.shape[1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(parts).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(parts)), times))),
                pa.array(np.repeat(np.array(sizes, np.int64), times)), pa.array(at),
                pa.ListArray.from_arrays(ends, maps.ravel())], ["bucket", "node", "n", "place", "parity"])

    return texts.select("node", "text").mapInArrow(run, "bucket bigint, node binary, n bigint, place bigint, parity array<bigint>")


def _within(place: str, n: str, other_n):
    """Whether a place is among those that decide a link with a set of ``other_n`` shingles."""
    return F.col(place) < F.col(n) - F.ceil(3 * (F.col(n) + other_n) / 7) + 1


def _bits_apart(parity: str, other_parity: str):
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(parity, F.lit(k)).bitwiseXOR(F.get(other_parity, F.lit(k)))) for k in range(PARITY // 64)])


def _may_share(n: str, other_n: str, parity: str, other_parity: str):
    """Whether the sets may have the wanted similarity: each bit that differs is a shingle that only one of them has, at least."""
    both = F.col(n) + F.col(other_n)
    return both - _bits_apart(parity, other_parity) >= 2 * F.ceil(3 * both / 7)


def _apart(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components are not joined yet."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after further links: components of the roots that they join, carried over to the nodes."""
    if roots is None:
        return components(links)
    for end in ("a", "b"):
        links = links.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    found = written(components(written(links.select("a", "b"), "joined")), "merged")
    new = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(new.unionByName(found.join(roots.select("node"), "node", "left_anti")), "roots")


def linked(reps: DataFrame, texts_of, width: int) -> DataFrame:
    """(node, root) of the nodes that are linked with others.

    Nodes that share a band are candidates.  First each node is tested against the smallest
    hub among its buckets, one pair for each node at most, which settles families of copies.
    Buckets whose members still lie in several components are open.  Of their nodes only those go on that share a
    rare shingle, as sets with the wanted similarity must (``_prefixes``); strangers with a common passage share none.  In
    every group of nodes by such a shingle that has several components, some members of its smallest components are hubs:
    they are tested against the members of other components, each node's likest first, and leave the group, until what is left
    is one component or has the shingle nowhere at an indexed place.  A pair is left out only when its components are joined already, or sizes,
    shingles or parity maps (``_may_share``) exclude the link for certain; a round makes pairs in proportion to the members.
    The first hubs are few, as they join most of a family of near copies, and what has joined makes no pairs with later ones.
    """
    rows = reps.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    # Counted by the bare keys first: most buckets have one node and end there.
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(rows.join(shared.drop("size"), "bucket", "left_semi"), "shared")
    members = written(members.join(members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub")), "bucket"), "members")
    texts = texts_of(members.select("node").distinct())
    first = (
        members.filter(F.col("node") != F.col("hub.node")).withColumn("hub_n", F.col("hub.n")).filter(_alike_in_size("n", "hub_n"))
        .groupBy("node").agg(F.min("hub.node").alias("a")).select("a", F.col("node").alias("b"))
    )
    tested = [written(first, "tested")]
    roots = _merged(None, confirmed(tested[0], texts, width))
    placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    nodes = members.select("bucket", "node").join(several.select("bucket"), "bucket", "left_semi").select("node").distinct()
    groups = _prefixes(written(texts.join(nodes, "node", "left_semi"), "open-texts"), width)
    groups = written(groups, "prefixes")
    maps, groups = groups.filter("place = 0").select("node", "parity"), groups.drop("parity")
    # Places matter up to what the smallest set of the group asks for; a shingle that one node has brings no pair.
    sizes = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).filter("size > 1").drop("size")
    least = F.greatest("least", F.ceil(3 * F.col("n") / 4))
    groups = groups.join(sizes, "bucket").filter(_within("place", "n", least)).withColumn("indexed", _within("place", "n", F.col("n")))
    groups, hubs = written(groups.drop("least"), "groups"), HUBS
    while True:
        placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("part"), F.count_if("indexed").alias("marked"))
        several = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.sum("marked").alias("marked"), (F.sum("part") - F.max("part")).alias("outside"))
        # The smaller of a pair's sets has the shingle at an indexed place, and one of them lies outside the largest component: the fewer are hubs.
        several = several.filter("roots > 1 and marked > 0").select("bucket", (F.col("marked") <= F.col("outside")).alias("by_mark"))
        placed = written(placed.join(several, "bucket").join(parts.drop("marked"), ["bucket", "root"]).join(maps, "node"), "open")
        # Few rows a group leave each task, so no group is gathered for its ranks.
        order = F.row_number().over(Window.partitionBy("bucket").orderBy("part", "node"))
        chosen = written(placed.filter("indexed or not by_mark").withColumn("nth", order).filter(F.col("nth") <= hubs).select(
            "bucket", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "root", "place", "parity")]), "hubs")
        if not chosen.limit(1).count():
            return roots
        decides = _within("place", "n", F.col("hub_n")) & _within("hub_place", "hub_n", F.col("n"))
        pairs = placed.join(chosen, "bucket").filter("root != hub_root").filter(decides).filter(_alike_in_size("n", "hub_n")).filter(_may_share("n", "hub_n", "parity", "hub_parity")).select(
            F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"), (_bits_apart("parity", "hub_parity") / (F.col("n") + F.col("hub_n"))).alias("bits"))
        before = reduce(DataFrame.unionAll, tested)
        # A pair has its bits once, whichever group it comes from; it is one row before the tested ones are looked up.
        fresh = written(pairs.groupBy("a", "b").agg(F.first("bits").alias("bits")).join(before, ["a", "b"], "left_anti"), "fresh")
        # Each node first meets the one that looks most like it, in another component each time; few pairs of a family are left then.
        left = fresh
        for _ in range(LIKEST):
            if not left.limit(1).count():
                break
            each = left.select(F.explode(F.array("a", "b")).alias("node"), F.struct("bits", "a", "b").alias("pair"))
            likest = written(each.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct(), "likest")
            roots = _merged(roots, confirmed(likest, texts, width))
            left = written(_apart(roots, left.join(likest, ["a", "b"], "left_anti")), "left")
        roots = _merged(roots, confirmed(left.select("a", "b"), texts, width))
        tested = [written(before.unionAll(fresh.select("a", "b")), "tested")]
        gone = chosen.select("bucket", F.col("hub_node").alias("node"))
        groups = placed.select("bucket", "node", "n", "place", "indexed").join(gone, ["bucket", "node"], "left_anti")
        hubs = min(GROWTH * hubs, max(hubs, MORE_HUBS))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and text_hash, one row for each document.

    Documents with the same shingle set are one node of the graph, whatever their number;
    a copy is never expanded into pairs.  component_id is the smallest id that links reach; kept marks
    its document.  A text that is null, empty or without words has no set and is
    linked with nothing.  An id that is null counts as larger than any other; rows
    that repeat both id and text are kept or dropped together.  Other columns are not read; an
    empty table gives no rows.
    """
    return settled_in(docs.sparkSession, lambda: _near_dedup(docs, id_col, text_col, width), "near")


def _near_dedup(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    found = written(features(docs, id_col, text_col, width), "features")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    reps = written(
        found.filter("node is not null").groupBy("node").agg(
            F.min_by("bands", key).alias("bands"), F.first("n_shingles").alias("n_shingles"), F.min(key).alias("first")), "nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = reps.join(nodes, "node").select("node", F.col("first.doc_id").alias("want_id"), F.col("first.text_hash").alias("want_hash"))
        source = with_text_hash(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("row.*", "text_hash")
        same = F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_hash") == F.col("want_hash"))
        return written(source.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "texts")

    roots = linked(reps, texts_of, width)
    placed = found.drop("bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.filter("root is not null").groupBy("root").agg(F.min(key).alias("first"))
    none = F.col("root").isNull()
    return placed.join(firsts, "root", "left").select(
        "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (none | key.eqNullSafe(F.col("first"))).alias("kept"), "text_hash",
    )


def with_text_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row, in ``row``, with the hash of its text that ``near_dedup`` returns; null counts as empty."""
    def run(batches):
        for batch in short(batches):
            hashes = [xxhash.xxh3_64_intdigest((t or "").encode()) for t in batch.column(0).field(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.uint64()).view(pa.int64())], ["row", "text_hash"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("text_hash", T.LongType())]))
