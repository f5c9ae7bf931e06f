"""The queries of the training-data operators: thin wrappers that apply each to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path(name: str = "word_bpe_49k.json", variable: str = "TOKENIZER_FILE") -> str:
    """Where the vocabulary file lies: as the environment's variable says, else the installed public one."""
    given = os.environ.get(variable)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.quality_classifier import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.token_output import token_round_trip

    return token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.media import read_media, store_media
    from corpusmill.llm.shared import written

    return read_media(written(store_media(_table(spark, sf_dir, "documents")), "media"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.best_fit import best_fit

    return best_fit(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json", "BYTE_TOKENIZER_FILE"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.conversation_repair import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_score_quality": op1_score_quality,
    "op2_find_pii": op2_find_pii,
    "op3_pack": op3_pack,
    "op4_mix_sources": op4_mix_sources,
    "op5_scan_licenses": op5_scan_licenses,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc": op7_warc,
    "op8_media": op8_media,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_shards": op10_token_shards,
    "op11_best_fit": op11_best_fit,
    "op12_whiten": op12_whiten,
    "op13_repair_conversations": op13_repair_conversations,
}

#: The base32 alphabet over 20 bits at a time, as hex digits give them.
_OP7 = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), b AS (SELECT s, max(page_id) AS m FROM p GROUP BY s)
SELECT page_id, strlen(h) AS payload_bytes, url, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (k // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
FROM p JOIN b USING (s)"""

#: Words, windows and lines of each text; then hosts with a beta prior by moments, and verdicts against the other hosts.
_OP9 = r"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: {'i': i, 'k': array_to_string(ws[i:i + 4], ' ')})) AS x FROM w),
r AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.k) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM r WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, host, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
e AS (SELECT *, base_failed OR n_symbols > 0.2 * n_words OR n_dup_lines > 0.3 * n_lines OR word_chars > 12 * n_words AS soft_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(soft_failed::INT)::DOUBLE AS k FROM e GROUP BY host),
a AS (SELECT sum(n)::DOUBLE AS total, sum(k) AS fails, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS square, count(*) AS hosts FROM h),
m AS (SELECT *, greatest(greatest(square - mean * mean, 0) - mean * (1 - mean) * hosts / total, mean * (1 - mean) * 1e-4) AS between_hosts FROM a),
q AS (SELECT *, CASE WHEN between_hosts > 0 THEN greatest(mean * (1 - mean) / between_hosts - 1, 1) ELSE 1 END AS weight FROM m),
z AS (SELECT host, (k + mean * weight) / (n + weight) AS rate, CASE WHEN total > n THEN (fails - k) / (total - n) END AS others FROM h, q),
b AS (SELECT host, rate, coalesce(rate > 2 * others AND rate >= 0.05, false) AS bad FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft_failed) AS kept, e.host AS host, round(rate, 6) AS host_rate, bad AS host_bad, soft_failed
FROM e JOIN b ON e.host IS NOT DISTINCT FROM b.host"""

#: The other operators' models, schedules, parsers, tokenizer and similarity joins cannot be said in SQL.
ORACLE_SQL: dict[str, str] = {"op7_warc": _OP7, "op9_quality_rules": _OP9}
