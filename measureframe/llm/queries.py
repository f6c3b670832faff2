"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measureframe.llm import url_filter
from measureframe.llm.alignment import align
from measureframe.llm.divergence import divergence
from measureframe.llm.exact_dedup import exact_dedup
from measureframe.llm.feistel import KINDS, pseudonymise
from measureframe.llm.language import fit, identify
from measureframe.llm.merkle import compare_edits
from measureframe.llm.minhash import near_dedup
from measureframe.llm.mixing import mix
from measureframe.llm.packing import pack
from measureframe.llm.ppm import score
from measureframe.llm.repeats import remove_repeats
from measureframe.llm.store import new_path
from measureframe.llm.token_files import count_tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(divisor: int):
    """crc32 of the id as text, modulo ``divisor``; an id that is null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score(documents(spark, sf_dir), id_remainder(5) != 1)
    return scores.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages).select("row.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


#: The key of the pseudonyms; a user gives one of their own.
KEY = b"measureframe pseudonyms"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs, KEY).select("row.doc_id", F.col("new_text").alias("text"), *[f"n_{k}" for k in KINDS])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, id_remainder(4) != 2, per_label=1500)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score", "rejected").withColumn("held_out", id_remainder(4) == 2)


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2, size=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)
    return exact_dedup(documents(spark, sf_dir)).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", sha.alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), new_path(spark, "tokens"), tokenizer_path("piece_bpe_32k.model"), end_id=2)


#: Target weights of the known sources: one has ten parts, the nineteen others one each.
WEIGHTS = {f"src{i}": 10 if i == 0 else 1 for i in range(20)}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source"), WEIGHTS, block_docs=64)
    return mixed.select("row.doc_id", "row.source", "stream", "block", "epoch", "slot", "place")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), groups="sha256")
    return docs.withColumnRenamed("groups", "groups_sha256")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=100)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r.end - r.start)
    return found.select(
        "row.doc_id", F.octet_length(F.coalesce(F.col("row.text"), F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_ppm": op2_ppm,
    "op3_url_filter": op3_url_filter,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_language": op5_language,
    "op6_merkle": op6_merkle,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": url_filter.oracle(),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_divergence": """
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
        size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        cells AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        grp AS (SELECT lang, source, coalesce(any_value(t.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs)
                LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
        dense AS (
            SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 1)) // (grp.n + size.v) AS p,
                   1 + (1000000000 * (kept.n + 1)) // (size.n + size.v) AS usual
            FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cells USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(any_value(d.value), 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                       FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) d
            ON d.lang = a.lang AND d.source = a.source AND d.other = b.source GROUP BY ALL),
        over AS (SELECT lang, source, term AS item, (((p - usual) * (p - usual)) // usual)::BIGINT AS value FROM dense WHERE c > 0 AND p > usual),
        everything AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM over)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM everything
        QUALIFY part = 'pair' OR rank <= 200
    """,
}
