"""Divergence of sources in their terms, after copies of a text have been collapsed."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measureframe.llm.store import short, written

#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Sums of terms in groups that a task holds before it hands them on.
MEMORY = 300_000
#: Groups of a lang whose pairs with as many others are summed in one task.
BLOCK = 512
#: Documents of its lang that a kept term is in, at least, and ranks of terms that are listed.
DOCS, RANKS = 3, 200

#: A-Z become a-z; bytes 0-64, 91-96 and 123-127 part the terms; all bytes of non-ASCII characters belong to them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of non-ASCII characters, in UTF-8."""
    return text.encode().translate(_FOLD).split()


def collapsed(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, text, sources, copies: each distinct text of a lang once, with its number of copies in each source.

    Copies are counted on digests of 128 bits, map-side first, so a text that a third of all rows repeat is
    a few rows.  The text itself is moved once, one row from each task that has it.
    """
    rows = docs.select(_plain(lang_col).alias("lang"), _plain(source_col).alias("source"), _plain(text_col).alias("text"))
    rows = rows.withColumn("high", F.xxhash64("text")).withColumn("low", F.xxhash64(F.lit(1), "text", F.octet_length("text")))
    copies = rows.groupBy("lang", "high", "low", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.groupBy("lang", "high", "low").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "high", "low").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "high", "low"]).select("lang", "text", F.col("copies.source").alias("sources"), F.col("copies.n").alias("copies"))


def _plain(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def weighted_terms(texts: DataFrame, numbers) -> DataFrame:
    """lang, term, g, n, docs: occurrences and documents of each term in each group, every text tokenized once and weighted by its copies.

    ``numbers`` is a broadcast of the numbers of langs and of groups, by lang and source.
    """
    def run(batches):
        at = numbers.value
        words: dict[tuple[int, int], Counter] = defaultdict(Counter)
        holders: dict[tuple[int, int], Counter] = defaultdict(Counter)

        def emitted():
            for (lang, g), found in words.items():
                own = holders[lang, g]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found), lang, np.int32)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(np.full(len(found), g, np.int32)),
                    pa.array(np.fromiter(found.values(), np.int64, len(found))), pa.array(np.fromiter(map(own.__getitem__, found), np.int64, len(found)))],
                    ["lang", "term", "g", "n", "docs"])
            words.clear()
            holders.clear()

        fresh = 0
        for batch in short(batches):
            for lang, text, sources, copies in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources", "copies"))):
                found = terms(text)
                distinct = set(found)
                for source, times in zip(sources, copies):
                    group = at[lang][source]
                    if times == 1:
                        words[group].update(found)
                        holders[group].update(distinct)
                    else:
                        words[group].update({t: n * times for t, n in Counter(found).items()})
                        holders[group].update(dict.fromkeys(distinct, times))
                fresh += len(distinct)
            if fresh >= MEMORY and sum(map(len, words.values())) >= MEMORY:
                yield from emitted()
                fresh = 0
        yield from emitted()

    return texts.mapInArrow(run, "lang int, term string, g int, n bigint, docs bigint")


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / (total + kept)), exact while total + kept is below 9e15; 1 where no term is kept."""
    if not kept:
        return np.ones(np.shape(count), np.int64)
    whole, rest = np.divmod(np.asarray(count, np.int64) + 1, total + kept)
    for _ in range(3):  # a long division, three decimal digits at once
        digits, rest = np.divmod(rest * 1000, total + kept)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p, q):
    """floor((p - q)^2 / q) in whole numbers."""
    return (p - q) * (p - q) // q


class Lang:
    """The groups of a lang, in the order of their sources, and the shares of a term that they do not have."""

    def __init__(self, sources: list[str], totals: list[int], kept: int) -> None:
        self.sources, self.totals, self.kept, self.total = sources, totals, kept, sum(totals)
        self.missing = np.array([int(shares(np.int64(0), n, kept)) for n in totals], np.int64)


def _cells(batch, langs: list[Lang]):
    """lang, and for its rows of the batch: row, group, share of each cell (a term in a group that has it)."""
    names = batch.column("lang").to_numpy()
    for name in np.unique(names).tolist():
        own, rows = langs[name], np.flatnonzero(names == name)
        part = batch.take(pa.array(rows))
        sizes = pc.list_value_length(part.column("groups")).to_numpy()
        group = part.column("groups").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.empty(len(count), np.int64)
        for g in np.unique(group):
            here = group == g
            share[here] = shares(count[here], own.totals[g], own.kept)
        yield name, own, part, np.repeat(np.arange(len(rows)), sizes), group, share


def _pair_sums(kept: DataFrame, sent, blocks: int) -> DataFrame:
    """lang, g, h, value, either: distances summed over the terms that g or h has, and the number of those terms.

    A term's cells meet the dense row of shares of its lang (its own where it is, the others' shares of a missing
    term); terms that neither group has are all alike and are added outside.  A task hands over one sum for each
    pair of groups that it met, never pairs of each term, and of many groups it looks at one block of pairs.
    """
    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            g_blocks, h_blocks = (batch.column(c).to_numpy() for c in ("g_block", "h_block"))
            for gb, hb in {*zip(g_blocks.tolist(), h_blocks.tolist())}:
                chosen = batch.take(pa.array(np.flatnonzero((g_blocks == gb) & (h_blocks == hb))))
                for piece in short([chosen], 1024):
                    for name, own, part, row, group, share in _cells(piece, sent.value):
                        add(sums, name, own, part.num_rows, row, group, share, gb, hb)
        for (name, gb, hb), value in sums.items():
            g, h = np.nonzero(value[1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(g), name, np.int32)), pa.array(g + gb * BLOCK), pa.array(h + hb * BLOCK), pa.array(value[0][g, h]), pa.array(value[1][g, h])],
                ["lang", "g", "h", "value", "either"])

    def add(sums, name, own, rows, row, group, share, gb, hb):
        g_missing, h_missing = own.missing[gb * BLOCK : (gb + 1) * BLOCK], own.missing[hb * BLOCK : (hb + 1) * BLOCK]
        total = sums.setdefault((name, gb, hb), np.zeros((2, len(g_missing), len(h_missing)), np.int64))
        in_g, in_h = group // BLOCK == gb, group // BLOCK == hb
        dense = np.tile(h_missing, (rows, 1))
        dense[row[in_h], group[in_h] - hb * BLOCK] = share[in_h]
        has = np.zeros((rows, len(g_missing)), bool)
        has[row[in_g], group[in_g] - gb * BLOCK] = True
        for g in np.unique(group[in_g]):
            of = group == g
            total[0, g - gb * BLOCK] += distance(share[of][:, None], dense[row[of]]).sum(axis=0)
            total[1, g - gb * BLOCK] += of.sum()
        for h in np.unique(group[in_h]):
            of = group == h
            lacks = ~has[row[of]]
            total[0, :, h - hb * BLOCK] += (distance(g_missing[None], share[of][:, None]) * lacks).sum(axis=0)
            total[1, :, h - hb * BLOCK] += lacks.sum(axis=0)

    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = kept.withColumn("g_block", F.explode(every)).withColumn("h_block", F.explode(every)) if blocks > 1 else kept.withColumn("g_block", F.lit(0)).withColumn("h_block", F.lit(0))
    found = rows.mapInArrow(run, "lang int, g bigint, h bigint, value bigint, either bigint")
    return found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("either").alias("either"))


def _over_shares(kept: DataFrame, sent) -> DataFrame:
    """lang, g, item, value of every kept term whose share in a group is above its share in the lang."""
    def run(batches):
        for batch in short(batches, 4096):
            for name, own, part, row, group, share in _cells(batch, sent.value):
                usual = shares(part.column("n").to_numpy(), own.total, own.kept)[row]
                over = np.flatnonzero(share > usual)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(over), name, np.int32)), pa.array(group[over]), part.column("term").take(pa.array(row[over])),
                    pa.array(distance(share[over], usual[over]))], ["lang", "g", "item", "value"])

    return kept.mapInArrow(run, "lang int, g bigint, item string, value bigint")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", docs_at_least: int = DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a lang is from the others, and by which terms.

    Copies of a text are collapsed in each lang and its terms are counted once, weighted by the copies in each
    source.  A lang keeps the terms in at least ``docs_at_least`` of its documents, repeated rows counted each.  With p the
    smoothed share of a term in the group (lang, source), in parts of 10**9, part ``pair`` sums
    floor((p - q)^2 / q) over all kept terms for each other source (share q) of the lang; part ``term`` has the
    terms of the group with p above the lang's share q, the ``ranks`` largest values.  Values fall with the rank,
    ties go by the item's bytes.

    Null text, lang and source count as empty; a group whose texts are all empty has its pairs and no terms; a lang with one
    source has no pairs.  Other columns are not read; an empty table gives no rows.  The driver holds one
    row for each (lang, source), as the result has their square.
    """
    spark = docs.sparkSession
    groups = sorted((r.lang, r.source) for r in docs.select(_plain(lang_col).alias("lang"), _plain(source_col).alias("source")).distinct().collect())
    by_lang: dict[str, list[str]] = defaultdict(list)
    for lang, source in groups:
        by_lang[lang].append(source)
    numbers = spark.sparkContext.broadcast({lang: {s: (i, k) for k, s in enumerate(sources)} for i, (lang, sources) in enumerate(by_lang.items())})
    kept = written(
        weighted_terms(collapsed(docs, text_col, lang_col, source_col), numbers)
        .groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(F.collect_list(F.struct("g", "n")).alias("cells"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= docs_at_least).select("lang", "term", "n", F.col("cells.g").alias("groups"), F.col("cells.n").alias("counts")),
        "terms")
    cells = kept.select("lang", F.explode(F.arrays_zip("groups", "counts")).alias("cell")).groupBy("lang", F.col("cell.groups").alias("g")).agg(F.sum("cell.counts").alias("n"))
    totals = {(r.lang, r.g): r.n for r in cells.collect()}
    sizes = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = [Lang(sources, [totals.get((i, k), 0) for k in range(len(sources))], sizes.get(i, 0)) for i, sources in enumerate(by_lang.values())]
    sent = spark.sparkContext.broadcast(langs)
    table = written(spark.createDataFrame(
        [(i, name, k, s, int(own.missing[k]), own.kept, len(own.sources)) for i, (name, own) in enumerate(zip(by_lang, langs)) for k, s in enumerate(own.sources)],
        "lang int, name string, g bigint, source string, missing bigint, kept bigint, groups bigint"), "groups")
    blocks = max((-(-len(own.sources) // BLOCK) for own in langs), default=1)

    pairs = table.filter("groups > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("h")).filter("g != h")
    other = table.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("missing").alias("h_missing"))
    apart = (F.col("missing") - F.col("h_missing")) * (F.col("missing") - F.col("h_missing"))
    pairs = pairs.join(other, ["lang", "h"]).join(_pair_sums(kept, sent, blocks), ["lang", "g", "h"], "left").na.fill(0, ["value", "either"]).select(
        F.col("name").alias("lang"), "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("kept") - F.col("either")) * F.call_function("div", apart, F.col("h_missing"))).alias("value"))
    over = _over_shares(kept, sent).join(table.select("lang", "name", "g", "source"), ["lang", "g"]).select(F.col("name").alias("lang"), "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).filter(F.col("rank") <= ranks))
