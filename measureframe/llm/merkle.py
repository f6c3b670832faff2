"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.store import short
from measureframe.plans.ordering import slice_of

#: A run of words ends behind a word whose hash is divisible by so much, and after so many words at the latest.
RUN, LONGEST = 6, 24
#: Rows of a stretch of ids, as an average, until there are so many stretches.
STRETCH_ROWS, STRETCHES = 4096, 20_000
_SECTION = re.compile(r"\n[ \t]*\n\s*")


def _leaf_hash(words: list[bytes]) -> str:
    return xxhash.xxh3_64_hexdigest(b" ".join(words))[:12]


def _node_hash(kind: str, children: list[str]) -> str:
    return hashlib.sha256(f"{kind}:{','.join(children)}".encode()).hexdigest()[:16]


class WordEnds(dict):
    """Whether a run ends behind a word; a bounded memory of a pure function."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % RUN == 0
        return value


def tree(text: str | None, ends: WordEnds) -> list[list[list[str]]]:
    """Leaf hashes by section and paragraph.

    Blank lines part sections, line ends part paragraphs.  A paragraph is cut into
    runs of words where its own words say so, so an edit changes the runs it touches
    and leaves those before and behind it as they are.
    """
    sections = []
    for section in _SECTION.split(text or ""):
        paragraphs = []
        for paragraph in section.split("\n"):
            words = paragraph.encode().split()
            leaves, first = [], 0
            for last, end in enumerate(map(ends.__getitem__, words), 1):
                if end or last - first == LONGEST:
                    leaves.append(_leaf_hash(words[first:last]))
                    first = last
            if first < len(words):
                leaves.append(_leaf_hash(words[first:]))
            paragraphs.append(leaves)
        sections.append(paragraphs)
    return sections


def fingerprint(text: str | None, ends: WordEnds) -> str:
    """``root|section=paragraph:leaf,leaf;paragraph:...|section=...`` in hexadecimal.

    The root is the hash of the sections' hashes, a section's that of its paragraphs', a paragraph's that
    of its leaves, together with the text's own digest in the root, so equal roots mean equal texts,
    white space included.
    """
    parts, tops = [], []
    for section in tree(text, ends):
        hashes = [_node_hash("p", leaves) for leaves in section]
        tops.append(_node_hash("s", hashes))
        parts.append(f"{tops[-1]}=" + ";".join(f"{h}:{','.join(leaves)}" for h, leaves in zip(hashes, section)))
    root = _node_hash("r", [*tops, hashlib.sha256((text or "").encode()).hexdigest()])
    return "|".join([root, *parts])


def _sections(print_: str) -> Iterator[tuple[str, str]]:
    for part in print_.split("|")[1:]:
        top, _, rest = part.partition("=")
        yield top, rest


def likeness(one: str, two: str) -> float:
    """Twice the leaves that two fingerprints share, over all their leaves; 1 for equal roots.

    Equal roots end the comparison; then equal sections and equal paragraphs are matched whole, and only
    the branches that differ are opened to their leaves.
    """
    if one.partition("|")[0] == two.partition("|")[0]:
        return 1.0
    shared, sizes, rest = 0, [0, 0], [Counter(), Counter()]
    open_ = [Counter(_sections(p)) for p in (one, two)]
    paragraphs = []
    for side in (0, 1):
        left = Counter()
        for key, n in (open_[side] - open_[1 - side]).items():
            for paragraph in key[1].split(";"):
                h, _, leaves = paragraph.partition(":")
                left[(h, leaves)] += n
        paragraphs.append(left)
    for key, n in (open_[0] & open_[1]).items():
        leaves = sum(len(p.partition(":")[2].split(",")) if p.partition(":")[2] else 0 for p in key[1].split(";")) * n
        shared += leaves
        sizes[0] += leaves
        sizes[1] += leaves
    for key, n in (paragraphs[0] & paragraphs[1]).items():
        leaves = (key[1].count(",") + 1 if key[1] else 0) * n
        shared += leaves
        sizes[0] += leaves
        sizes[1] += leaves
    for side in (0, 1):
        for (_, leaves), n in (paragraphs[side] - paragraphs[1 - side]).items():
            for leaf in leaves.split(",") if leaves else ():
                rest[side][leaf] += n
        sizes[side] += rest[side].total()
    shared += (rest[0] & rest[1]).total()
    return 2 * shared / sum(sizes) if sum(sizes) else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of ``following``, or all it has."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


_RESULT = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))


def _compared(text: str, own: str, following: str, other: str, ends: WordEnds) -> tuple:
    new = edited(text, following)
    print_ = fingerprint(new, ends)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, other)


def stretches(ids: DataFrame) -> tuple[Column, DataFrame]:
    """The stretch of a row by its ``id``, and (stretch, first id) of every stretch, in order.

    Stretches are cut at approximate quantiles of the ids, so each holds about as many rows.  The driver
    receives two numbers a stretch, of which there are at most ``STRETCHES``.
    """
    n = ids.count()
    parts = max(1, min(STRETCHES, n // STRETCH_ROWS))
    cuts = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    stretch = F.when(F.col("id").isNull(), 0).otherwise(slice_of(F.col("id"), cuts)).cast("int")
    firsts = ids.groupBy(stretch.alias("stretch")).agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("first"))
    return stretch, firsts.select("stretch", "first.id").orderBy("stretch")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, one row a document.

    Rows are dealt into stretches of the (numeric) ids and sorted inside, so a document's successor is the next
    row.  The first rows of a stretch are sent to the one before as well, as guests that
    only end it; so each text moves once.  The successor of the last document is the first.

    A null text counts as empty; an id that is null comes first; rows with the same id follow each other in
    the order of their texts.  Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stretch, firsts = stretches(rows.select("id"))
    found = [tuple(r) for r in firsts.collect()]
    host = {first: found[i - 1][0] for i, (_, first) in enumerate(found)}
    # Guests are few: one id a stretch.  The join's small side has as many rows.
    guests = docs.sparkSession.createDataFrame([(k, v) for k, v in host.items()], T.StructType([T.StructField("first", rows.schema["id"].dataType), T.StructField("host", T.IntegerType())]))
    sent = rows.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("first")), "left").select(
        "id", "text", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(stretch.alias("stretch"), F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct(stretch.alias("stretch"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("stretch"), F.lit(True).alias("guest"))))).alias("at"))
    dealt = sent.select("id", "text", "at.*").repartition("stretch").sortWithinPartitions("stretch", "guest", "id", "text")

    def run(batches):
        ends, held, at = WordEnds(), None, None
        for batch in short(batches):
            ids, out = batch.column("id"), []
            for i, (text, stretch_, guest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "stretch", "guest")))):
                if stretch_ != at:
                    held, at = None, stretch_
                if guest and held is None:
                    continue  # a further guest
                row = (ids.slice(i, 1), text, fingerprint(text, ends))
                if held:
                    out.append((held[0], *_compared(held[1], held[2], text, row[2], ends)))
                held = None if guest else row
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(columns[0])), *(pa.array(c, k) for c, (_, k) in zip(columns[1:], _RESULT))], ["doc_id", *(n for n, _ in _RESULT)])

    return dealt.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["id"].dataType), *_FIELDS]))


_FIELDS = [T.StructField(n, T.LongType() if k == pa.int64() else T.DoubleType() if k == pa.float64() else T.StringType()) for n, k in _RESULT]
