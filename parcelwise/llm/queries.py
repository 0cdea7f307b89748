"""The registered queries of the operators here, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import fingerprints, html_text, language, mixing, near_duplicates, passages, pieces, quality, token_counts, urls
from parcelwise.llm._common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(docs, language.fit(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeated(table(spark, sf_dir, "documents"), digests=True, keep=["doc_id"])


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_source_mixing, op4_quality_rules, op5_suffix_array_dedup, op6_url_filters, op7_minhash_near_dedup, op8_sentencepiece, op9_fingerprints, op10_html_extraction)}

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM k),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM m, (VALUES (0), (1), (2)) v(j) WHERE m.n > 1 GROUP BY r),
b AS (SELECT w.doc_id, t, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.r = c.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n_words * 2 OR word_chars > n_words * 20
    OR len(regexp_replace(t, '[^\p{L}]+', '', 'g')) * 2 < word_chars
    OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-•*·]'))) * 10 > n_lines * 9
    OR len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(…|\.\.\.)[ \t]*$'))) * 10 > n_lines * 3) AS kept
FROM f
"""

ORACLE_SQL = {"op4_quality_rules": _OP4}
