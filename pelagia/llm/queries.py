"""The registered queries over whole tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import decontaminate, html_text, mixing, quality, rules, secrets, shards, simhash, tokens, warc
from pelagia.llm.common import new_path, table, written

#: Vocabularies by the name under which every executor finds the public tokenizers' file.
BYTES, MANY_LANGUAGES, PIECES = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of mixing.WEIGHTS, as many tokens as there are."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        mixing.domain().alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        mixing.words("text").alias("tokens"),
    )
    docs = written(docs, "tokens")  # the texts are read once
    return mixing.mix(
        docs, [F.col("domain"), F.col("lang"), F.col("source")], F.col("tokens"), mixing.WEIGHTS,
        max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED,
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the byte-level BPE vocabulary."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), BYTES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label classifier fitted on, and applied to, all documents."""
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight shards of near-equal bytes."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document, fertility by the many-language and the piece vocabulary."""
    return rules.quality(table(spark, sf_dir, "documents"), MANY_LANGUAGES, PIECES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("long")
    return warc.stored(spark, path, with_payload=False).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
        "error",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_decontaminate, op3_token_counts, op4_quality_classifier, op5_secrets, op6_main_text, op7_shards, op8_quality_rules, op9_simhash, op10_warc
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least({decontaminate.WINDOW}, len(w)) AS k FROM items WHERE len(w) > 0))),
spots AS (SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
  SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM wins))),
found AS (SELECT row, k, i, item FROM spots JOIN wins USING (k, win)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM found) GROUP BY row),
named AS (SELECT row, list_sort(list(DISTINCT item)) AS names FROM found WHERE item IS NOT NULL GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(names, []))::BIGINT AS n_items,
  sha256(array_to_string(coalesce(names, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, CASE WHEN strlen(html) >= {warc.REVISIT_BYTES} AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, NULL::VARCHAR AS error FROM r""",
}
