"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import ngram_join, nn_descent, page_text, quality_knn, quality_rules, streaming_bpe, suffix_dedup, token_pack, url_filter, warc
from fieldloom.llm.common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    read = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark, sf_dir, tokenizer=None):
    return token_pack.pack_documents(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark, sf_dir, tokenizer=None):
    return streaming_bpe.digest_documents(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_quality_knn(spark, sf_dir):
    return quality_knn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_nn_descent(spark, sf_dir):
    return nn_descent.search(_table(spark, sf_dir, "embeddings"))


def op8_page_text(spark, sf_dir):
    return page_text.extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir, vocabulary=None):
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), vocabulary or public_tokenizers.path("word_bpe_49k.json")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_warc, op2_packing, op3_bpe, op4_ngram_join, op5_quality_knn, op6_suffix_dedup, op7_nn_descent, op8_page_text, op9_quality_rules, op10_url_filter)}

_OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (d, n)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT spot) AS n FROM dup GROUP BY doc_id),
l AS (SELECT doc_id, source, text, lower(regexp_replace(trim(x, E' \t\n\x0b\x0c\r'), '[ \t-\r]+', ' ', 'g')) AS line,
             len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> '')) AS k FROM (SELECT doc_id, source, text, unnest(lines) AS x FROM w)),
f AS (SELECT source, line, count(DISTINCT text) AS c FROM l GROUP BY source, line),
h AS (SELECT source, count(DISTINCT text) AS c FROM d GROUP BY source),
hot AS (SELECT f.source, line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE f.c > greatest(20, least(0.1 * h.c, 20 * sqrt(h.c)))),
gone AS (SELECT doc_id, sum(k) AS k FROM l WHERE EXISTS (SELECT 1 FROM hot WHERE hot.source IS NOT DISTINCT FROM l.source AND hot.line = l.line) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, coalesce(gone.k, 0) AS removed FROM w LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed <= 0.5 * n_words AS kept, removed::BIGINT AS removed_words
FROM b
"""

ORACLE_SQL = {"op1_warc": _OP1, "op9_quality_rules": _OP9}
