"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept.
All but the last return the columns of ``documents``, whatever further ones there are; they pass through
under any name.  A stage's result has to be written before the next stage is called: that one deletes the tables
which its predecessor wrote on the way.  Empty tables go through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measureframe.llm.exact_dedup import exact_dedup
from measureframe.llm.language import fit, identify
from measureframe.llm.minhash import near_dedup, with_text_hash
from measureframe.llm.mixing import mix
from measureframe.llm.packing import pack
from measureframe.llm.queries import WEIGHTS, tokenizer_path
from measureframe.llm.store import delete, next_stage, shared_folder

#: Slots of the mixture that are written by one task.
SLOTS_A_TASK = 256
#: Rows of a batch that goes to Python.
BATCH_ROWS = "256"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        next_stage(spark)
        # Workers live on from stage to stage with what they once held, so the batches sent to them are small.  No result depends on it.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run


@stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; it learns from the labelled rows.

    A text that is null or has no letter goes.  Rows that repeat share their fate; without labelled rows all go.
    """
    return identify(docs, fit(docs, F.lit(True))).filter("not rejected").select("row.*")


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; null and empty texts are equal.  Of rows that repeat, one stays."""
    return exact_dedup(docs).filter("kept").select("row.*")


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies, the row with the smallest id; every text without words stays.

    An id that is null counts as the largest.  Of rows that repeat id and text, one stays.
    """
    kept = near_dedup(docs).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")).distinct()
    rows = with_text_hash(docs)
    same = F.col("row.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    once = rows.join(kept, same).groupBy("keep_id", "keep_hash").agg(F.first("row").alias("row"))
    return once.select("row.*")


@stage
def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in its order: sources that run out begin again until each has come whole, so a document may come again.

    Null sources and those without a weight are one stream; texts are not looked at.
    """
    mixed = mix(docs, WEIGHTS, block_docs=64, repeat=True)
    slots = mixed.agg(F.max("slot")).first()[0] or 0
    return mixed.repartitionByRange(1 + slots // SLOTS_A_TASK, "slot").sortWithinPartitions("slot", "place").select("row.*")


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: the pieces of documents, their ids and their places; a null text is an empty one, one token long."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, size=1024)


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", weighted),
    ("best-fit packing", packed),
]

#: No SQL fits a language model or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; of the results between, only the last one is kept, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
