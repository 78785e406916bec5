"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrain.llm import (
    alignment, exact_dedup, jaccard, lm_score, mixing, periodic, pieces, pu_quality, quality, sharding, toxicity, url_filter,
    warc,
)

#: Verdict, host and path of each URL rule (fixed values).
URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]

#: Host labels whose addresses make up the list of the URL filter.
UNWANTED = "(^|[.])(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)[.]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = (
        url_filter.with_host_and_path(pages.select("url")).where(F.col("host").rlike(UNWANTED))
        .select(F.concat("host", "path").alias("address"))
    )
    return url_filter.judge(pages, listed, URL_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file())


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_planted_runs(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix": op2_mix,
    "op3_near_copies": op3_near_copies,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_pieces": op6_pieces,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_shards": op9_shards,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_pu_quality": op11_pu_quality,
    "op12_alignment": op12_alignment,
    "op13_periodic": op13_periodic,
}

ORACLES = {
    "op7_url_filter": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        named AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
                regexp_matches(host, '{UNWANTED}') AS listed
            FROM named)
        SELECT page_id, host, path, rule, listed, CASE
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op10_exact_dedup": """
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS p
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY p) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(p) AS text_sha256
        FROM plain WINDOW best AS (PARTITION BY p ORDER BY points DESC, doc_id NULLS LAST)
    """,
}
