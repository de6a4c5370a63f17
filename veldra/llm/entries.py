"""Registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldra.llm import hilbert_search, impact_search, license_scan, packing, pii, quality, sentencepiece_codec, simhash, token_counts, toxicity
from veldra.llm.common import table
from veldra.llm.license_texts import TEMPLATES

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), divisor=100)


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(table(spark, sf_dir, "embeddings"), divisor=20)


_drawn: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The session's ``spark.veldra.pii.key``; without one, a key drawn for this application, whose pseudonyms no other run repeats."""
    return spark.conf.get("spark.veldra.pii.key", None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES)
    return found.select("doc_id", "license", "containment", "first_word")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), remember=True)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_search": op1_exact_search,
        "op2_hilbert_neighbours": op2_hilbert_neighbours,
        "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_license_scan": op4_license_scan,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality": op8_quality,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
    }


#: Every pair of a query and another row.
SEARCH_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def license_sql() -> str:
    """Of each template, the best of the windows of its size class, by the distinct shingles of the template in it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda text: f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
    shingles = "list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))"
    templates = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in TEMPLATES.items())
    return f"""
WITH tw AS (SELECT license, {words("text")} AS w FROM (VALUES {templates}) x(license, text)),
tl AS (SELECT license, w, least({license_scan.SHINGLE}, len(w)) AS size FROM tw),
ts AS (SELECT DISTINCT license, size, unnest({shingles}) AS s FROM tl),
n AS (SELECT license, count(*) AS n, CAST(1 AS BIGINT) << CAST(floor(log2(count(*))) AS INTEGER) AS step FROM ts GROUP BY license),
dw AS (SELECT row_number() OVER () AS row_id, doc_id, {words("text")} AS w FROM documents),
dl AS (SELECT row_id, doc_id, w, size FROM dw, (SELECT DISTINCT size FROM tl)),
ds AS (SELECT row_id, doc_id, size, unnest({shingles}) AS s, unnest(range(0, len(w) - size + 1)) AS k FROM dl),
hits AS (SELECT row_id, doc_id, license, n, step, ds.s, k FROM ds JOIN ts USING (size, s) JOIN n USING (license)),
seen AS (SELECT *, unnest(range(greatest(0, CAST(ceil((k - 4 * step + 1) / step) AS BIGINT)), k // step + 1)) AS place FROM hits),
windows AS (SELECT row_id, doc_id, license, place, CAST(count(DISTINCT s) AS DOUBLE) / n AS containment, min(k) AS first_word FROM seen GROUP BY row_id, doc_id, license, n, place),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id, license ORDER BY containment DESC, place) AS r FROM windows)
SELECT doc_id, license, containment, first_word FROM best WHERE r = 1 AND containment >= {license_scan.CONTAINMENT}
"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force."""
    return {"op1_exact_search": SEARCH_SQL, "op4_license_scan": license_sql()}
