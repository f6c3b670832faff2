"""Operators on texts leave the session as it is."""

from measureframe.llm.feistel import pseudonymise
from measureframe.llm.language import fit, identify
from measureframe.llm.minhash import near_dedup
from pyspark.sql import functions as F

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")


def test_no_setting_changes(spark):
    def settings():
        return [spark.conf.get(k) for k in KEYS], spark.conf.get("spark.checkpoint.dir", None)

    before = settings()
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "eins zwei drei", "de")], "doc_id bigint, text string, lang string")
    pseudonymise(docs, b"key").collect()
    near_dedup(docs).collect()
    identify(docs, fit(docs, F.lit(True))).collect()
    assert settings() == before
