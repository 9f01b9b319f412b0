"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, license, lm, packing, quality, sharding, toxicity, warc
from .jaccard import jaccard_components
from .shared import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held(n: int, k: int) -> Column:
    """Rows whose crc32(doc_id as text) leaves the remainder ``k`` modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n == k


def tokenizer_path() -> str:
    """The byte-level BPE tokenizer's file, as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from positive and unlabelled ones outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"), ~_held(5, 0))
    return _judged(toxicity.score(docs, model), 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the rule ensemble, learned outside the held-out fifth."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, _read(spark, sf_dir, "labels"), ~_held(5, 0))
    return _judged(quality.score(docs, rules), 0.3)


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the log-bilinear model, and the smoothed unigram base."""
    got = lm.score(_read(spark, sf_dir, "documents"), ~_held(7, 2))
    return got.select("doc_id", _held(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in all documents."""
    return license.scan(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles reach a Jaccard similarity of 0.85."""
    return jaccard_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records: written, normalised to one member each, and read back."""
    got = warc.round_trip(_read(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards, compacted, and read back through the newest manifest."""
    docs = _read(spark, sf_dir, "documents")
    shards = sharding.Shards(spark, shared_dir(spark, "shards"))
    first = shards.append(docs)
    newest = shards.compact()
    if newest > first:
        shards.vacuum(first)
    name = F.substring_index("shard_path", "/", -1).alias("shard")
    return shards.read(docs.schema).select("doc_id", name, "level", "shard_rows", "row_in_shard", F.octet_length("text").cast("long").alias("text_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprint.versions(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, word for word or re-parameterised."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_log_bilinear": op2_log_bilinear,
        "op3_quality": op3_quality,
        "op4_license_scan": op4_license_scan,
        "op5_packing": op5_packing,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_warc": op7_warc,
        "op8_sharding": op8_sharding,
        "op9_fingerprints": op9_fingerprints,
        "op10_decontamination": op10_decontamination,
    }


#: Shingles of four words, links at 85 % and what they reach; ties to the same definition as the operator.
_OP6 = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT r.a AS doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id FROM (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r LEFT JOIN sizes s ON s.doc_id = r.a
"""

#: SHA-1 as base32: five hexadecimal digits are four base32 ones.
_OP7 = """
WITH d AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the joins and records; learned models, rules, token ids, sketches and shard names are beyond it."""
    return {"op6_jaccard_join": _OP6, "op7_warc": _OP7}
