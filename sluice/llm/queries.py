"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, mixing, quality_rules, simhash, substring_dedup, token_counts, toxicity, warc
from .common import bucket_of, kept, table

#: How op9's files and PCM are stored: pages as long as Zstandard's window at this level.
PACKED = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    # Labels are drawn before their texts are read: the sample is bounded, so it may be broadcast.
    drawn = toxicity.drawn_labels(labels)
    model = toxicity.fit_sample(toxicity.labelled_sample(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"), window=35)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = kept(media.media_column(table(spark, sf_dir, "documents")), "media", PACKED)
    # The PCM is stored, packed without loss; its digest is that of the PCM read back.
    features = media.media_features(stored, packed=True).drop("pcm_sha256")
    return media.unpacked(kept(features, "pcm", PACKED))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    return langid.identify(docs, model).select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_simhash": op5_simhash,
        "op6_mixing": op6_mixing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_warc": op8_warc,
        "op9_telephony": op9_telephony,
        "op10_language_id": op10_language_id,
    }


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), top AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN top USING (h)
"""

_WINDOWS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM twice, range(35) AS t(k)),
per AS (SELECT r, list(p) AS g, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT d.r, p, w[p] AS x FROM d JOIN per USING (r), unnest(range(1, len(w) + 1)) AS t(p)),
cut AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN cut USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE_SQL, "op7_substring_dedup": _WINDOWS_SQL, "op8_warc": _WARC_SQL}
