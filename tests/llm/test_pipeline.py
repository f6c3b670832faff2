"""The pipeline, stage by stage, each on what its predecessor kept."""

import random
from collections import Counter

import corpus_pipeline
from measureframe.llm.store import shared_folder
from pyspark.sql import functions as F

from .test_copies import brute_near
from .test_packing import checked

SF = "/root/testdata/sf0.001"


def written(df, name):
    """A stage's result, written by who runs the stages."""
    path = f"{shared_folder(df.sparkSession)}/result-{name}-{random.randrange(1 << 60)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000, None), (10_001, ""), (10_002, "12 34 %"), (10_003, "the of and to in that"), (10_003, "the of and to in that"), (10_004, "the of and to in that"), (10_005, "THE of and to in that")]
    extra = source.withColumn("row", F.lit("x")).withColumn("keep_id", F.lit(1)).unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"), allowMissingColumns=True)
    docs, sets = written(extra, "test"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns
        sets.append(([tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]))
        docs = out
    ident, exact, near, mixed = sets

    gone = {r[0] for r in ident[0]} - {r[0] for r in ident[1]}
    assert gone >= {10_000, 10_001, 10_002} and len(gone) <= 4 and not Counter(ident[1]) - Counter(ident[0])

    texts = {r[1]: max(x[0] for x in exact[0] if x[1] == r[1]) for r in exact[0]}
    assert sorted((r[0], r[1]) for r in exact[1]) == sorted((i, t) for t, i in texts.items())

    want = {i for i, (_, _, kept) in brute_near([(r[0], r[1]) for r in near[0]]).items() if kept}
    assert sorted(r[0] for r in near[1]) == sorted(want)

    assert set(mixed[1]) == set(mixed[0])
    last = corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), SF).collect()
    checked(last, [(r[0], r[1]) for r in set(mixed[1])], 1024)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_near_copies_that_repeat_leave_one(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, None), (None, None)]
    random.Random(1).shuffle(rows)
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "a b c d e f"), (None, None)]
