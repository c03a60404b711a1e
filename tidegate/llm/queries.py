"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express.

A query applies its operator with production parameters to its whole table; vocabularies come from
the installed package of public tokenizers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.bpe import bpe_round_trip
from tidegate.llm.common import read_table
from tidegate.llm.exact_dedup import exact_dedup
from tidegate.llm.lattice_lm import lattice_scores
from tidegate.llm.line_dedup import line_members
from tidegate.llm.packing import pack
from tidegate.llm.qda import quality_scores
from tidegate.llm.quality_rules import quality_rules
from tidegate.llm.secrets import secret_scan
from tidegate.llm.simhash import simhash_components
from tidegate.llm.warc import archive_round_trip


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_members(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
sizes(size, share) AS (VALUES (5, 0.15::DOUBLE), (6, 0.14::DOUBLE), (8, 0.12::DOUBLE), (10, 0.10::DOUBLE)),
starts AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
windows AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM starts),
found AS (SELECT doc_id, size, i, count(*) OVER (PARTITION BY doc_id, size, w) AS n, row_number() OVER (PARTITION BY doc_id, size, w ORDER BY i) AS k FROM windows),
twice AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM found WHERE size = 5 AND n > 1) GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, size, j FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS j FROM found WHERE k > 1)),
shares AS (SELECT c.doc_id, c.size, sum(length(word)) AS chars FROM covered c JOIN words ON words.doc_id = c.doc_id AND words.i = c.j GROUP BY c.doc_id, c.size),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM again WHERE k > 1 GROUP BY doc_id),
counts AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_chars
  FROM d LEFT JOIN twice ON d.doc_id = twice.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id),
over AS (SELECT DISTINCT c.doc_id FROM shares s JOIN sizes ON s.size = sizes.size JOIN counts c ON c.doc_id = s.doc_id WHERE s.chars > share * word_chars)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR dup_chars > 0.2::DOUBLE * word_chars OR doc_id IN (SELECT doc_id FROM over)) AS kept FROM counts
"""

OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS whole FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = whole THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = whole THEN NULL ELSE whole END AS refers_to
FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_best_fit_packing, op3_secret_scan, op4_lattice_lm, op5_bpe, op6_quality_rules,
        op7_warc, op8_exact_dedup, op9_quality_classifier, op10_simhash,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL}
