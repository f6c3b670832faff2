"""Token counts of documents in flat token files, found by a scan for the end-of-document id."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measureframe.llm.store import short

#: Tokens that are searched at once.
BLOCK = 1 << 20
#: Documents in a file, at most.
FILE_DOCS = 20_000


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_docs: int = FILE_DOCS) -> None:
    """Write ``kind=ids/stream=n`` folders of flat files of little-endian unsigned 16-bit ids, ``end_id`` behind each document.

    A stream is what one task reads; nothing is shuffled, and a stream is cut into files of at most ``file_docs`` documents.
    The same job writes ``kind=docs/stream=n``: the number and the id of each document, for
    who wants to know whose tokens they are.  Spark's own text writer makes the files, on any file
    system that it knows: a document's bytes are a line and the bytes of ``end_id`` part the
    lines, so these have to be valid UTF-8, as those of small ids are.
    """
    separator = _separator(end_id)

    def run(batches):
        model, task, first = _pieces(tokenizer), TaskContext.get().partitionId(), 0
        for batch in short(batches):
            n = batch.num_rows
            ids = [np.asarray(i, "<u2").tobytes() for i in model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)]
            names = [b"%d:%s" % (first + i, b"" if d is None else str(d).encode()) for i, d in enumerate(batch.column(0).to_pylist())]
            numbers = np.arange(first, first + n, dtype=np.int64)
            first += n
            yield pa.RecordBatch.from_arrays([
                pa.array(["ids"] * n + ["docs"] * n, pa.string()), pa.array(np.full(2 * n, task, np.int32)), pa.array(np.tile(numbers, 2)), pa.array(ids + names, pa.binary()),
            ], ["kind", "stream", "number", "value"])

    rows = docs.select(id_col, text_col).mapInArrow(run, "kind string, stream int, number bigint, value binary")
    ordered = rows.sortWithinPartitions("kind", "stream", "number").select("kind", "stream", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("kind", "stream").option("lineSep", separator).option("maxRecordsPerFile", file_docs).text(path)


def _separator(end_id: int) -> str:
    return np.asarray([end_id], "<u2").tobytes().decode()


def scan_token_files(files: DataFrame, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """stream, doc_no, start, n_tokens, ended of every document, from rows (stream, part, content).

    The parts of a stream, in the order of their names (numbers count as numbers), are one flat run of ids; a document may run over any number of
    parts and blocks.  Each block is searched for ``end_id`` at once and gives its number of tokens, of
    ends, and its last end.  A prefix scan over these sums, a few numbers a block, tells every
    block where in the stream it lies, how many documents ended before it and where the
    last of them did; with that, the ends found become documents.

    Ids behind the last end are a document that has not ended; one that ends at once has 0 tokens.
    A part whose length is no multiple of the id's width is an error.  A stream without ids gives no rows.
    """
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in short(batches):
            for stream, part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = content.as_buffer()
                if len(raw) % width:
                    raise ValueError(f"part {part} of stream {stream} has {len(raw)} bytes")
                ids = np.frombuffer(raw, dtype)
                rows = [(stream, part, i, len(ids[i : i + block]), np.flatnonzero(ids[i : i + block] == end_id)) for i in range(0, len(ids), block)]
                if rows:
                    a, b, c, d, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int32()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.list_(pa.int64()))],
                        ["stream", "part", "at", "tokens", "ends"])

    blocks = files.select(F.col("stream").cast("int"), F.col("part").cast("string"), "content").mapInArrow(
        run, "stream int, part string, at bigint, tokens bigint, ends array<bigint>")
    # Spark counts a task's files .c000 ... .c999, .c1000, so numbers are filled up to one width.
    pieces = F.regexp_extract_all("part", F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    name = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^[0-9]{1,40}$"), F.lpad(x, 40, "0")).otherwise(x)), "")
    order = Window.partitionBy("stream").orderBy(name, "part", "at")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("ends")
    placed = blocks.withColumn("begin", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).withColumn("before", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    placed = placed.withColumn("last", F.when(size > 0, F.col("begin") + F.try_element_at("ends", F.lit(-1))))
    placed = placed.withColumn("open", F.coalesce(F.max("last").over(earlier) + 1, F.lit(0))).withColumn("final", F.lead("at").over(order).isNull())
    whole = placed.select("stream", "before", "open", "begin", "ends", F.posexplode("ends").alias("i", "end")).select(
        "stream", (F.col("before") + F.col("i")).alias("doc_no"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("begin") + F.try_element_at("ends", F.greatest("i", F.lit(1))) + 1).alias("start"),
        (F.col("begin") + F.col("end")).alias("stop"), F.lit(True).alias("ended"))
    total = F.col("begin") + F.col("tokens")
    rest = placed.filter("final").select(
        "stream", (F.col("before") + size).alias("doc_no"), F.coalesce(F.col("last") + 1, F.col("open")).alias("start"), total.alias("stop"), F.lit(False).alias("ended")).filter("stop > start")
    return whole.union(rest).select("stream", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, part, content) of the ids' files; the part is the file's name.

    Spark reads a file as one value, so a file is at most 2 GB; longer ones are cut anywhere
    between two ids, as the scan stitches over parts.
    """
    return spark.read.format("binaryFile").load(f"{path}/kind=ids").select("stream", F.element_at(F.split("path", "/"), -1).alias("part"), "content")


def written_documents(spark: SparkSession, path: str, end_id: int = 2) -> DataFrame:
    """(stream, doc_no, doc_id as text) of the documents in the files."""
    names = spark.read.option("lineSep", _separator(end_id)).text(f"{path}/kind=docs")
    return names.select("stream", F.split_part("value", F.lit(":"), F.lit(1)).cast("long").alias("doc_no"), F.nullif(F.expr("substr(value, instr(value, ':') + 1)"), F.lit("")).alias("doc_id"))


def count_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_docs: int = FILE_DOCS) -> DataFrame:
    """doc_id, stream, doc_no, start, n_tokens, ended of every document, by writing token files and scanning them.

    A null text counts as empty and has 0 tokens; rows that repeat an id are counted each; an id may be null.
    Other columns are not read; an empty table gives no rows.
    """
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col, file_docs)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if docs.limit(1).count():
        found = scan_token_files(read_token_files(spark, path), end_id).join(written_documents(spark, path, end_id), ["stream", "doc_no"])
    else:
        found = spark.createDataFrame([], "doc_id string, stream int, doc_no bigint, start bigint, n_tokens bigint, ended boolean")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "stream", "doc_no", "start", "n_tokens", "ended")
