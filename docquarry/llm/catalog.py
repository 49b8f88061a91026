"""The registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, chat, licenses, lines, minhash, mixing, quality, rules, vectors, warc
from docquarry.llm.shared import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spark, table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", "n_unknown", F.size("notices").cast("long").alias("n_notices"), "family", "probability")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.faulty_calls(table(spark, sf_dir, "conversations"))
    linked = chat.linked_calls(calls, results, chat.REPLY)
    return linked.select("conv_id", "call_id", "turn", "level", "status", F.size("problems").cast("long").alias("n_problems"), "n_results", F.md5("json").alias("json_md5"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("clean", F.lit(""))).alias("clean_md5"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return rules.judge(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).drop("text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages")).drop("url")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


#: DuckDB: what op5 returns. Calls that depend forwards wait for the rest of their run of turns, two apart.
CHAT_SQL = """
WITH base AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
one AS (SELECT conv_id, turn, min(to_json(coalesce(text, ''))::VARCHAR) AS t FROM base WHERE role = 'user' GROUP BY conv_id, turn),
run AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM one),
calls AS (SELECT conv_id, turn, CASE WHEN conv_id % 8 = 3 THEN row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn DESC) - 1 ELSE 0 END AS level,
  CASE WHEN conv_id % 8 = 5 OR conv_id % 8 = 6 THEN 1 ELSE 0 END AS problems,
  CASE WHEN conv_id % 8 = 5 THEN '{"text":' || t || ',"turn":"' || turn || '"}' WHEN conv_id % 16 = 6 THEN '{"turn":' || turn || '}' WHEN conv_id % 16 = 14 THEN '{"more":15,"text":' || t || ',"turn":' || turn || '}' ELSE '{"text":' || t || ',"turn":' || turn || '}' END AS a
  FROM run),
results AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n, min(text) AS content, min(turn) AS at FROM base WHERE role = 'assistant' GROUP BY conv_id, turn - 1),
rows AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS call, coalesce(c.turn, r.at) AS turn, coalesce(c.level, 0) AS level, coalesce(c.problems, 0) AS problems, coalesce(r.n, 0) AS n, c.a, r.content,
  CASE WHEN c.turn IS NULL THEN 'orphan' WHEN c.problems > 0 THEN 'invalid' WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT conv_id, 't' || call AS call_id, turn, level::BIGINT AS level, status, problems::BIGINT AS n_problems, n::BIGINT AS n_results,
       md5('{"call":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"arguments":' || a || ',"id":"t' || call || '","name":"reply"}' END ||
           ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}') AS json_md5
FROM rows
"""

#: DuckDB: what op4 returns, by comparing all pairs.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v WHERE e IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.s > 0 AND b.s > 0
          WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least l ON l.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mix, op2_quality, op3_licenses, op4_vectors, op5_chat, op6_bpe, op7_lines, op8_rules, op9_warc, op10_minhash)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_vectors": VECTORS_SQL, "op5_chat": CHAT_SQL, "op7_lines": lines.LINES_SQL, "op9_warc": warc.WARC_SQL, "op10_minhash": minhash.MINHASH_SQL}
