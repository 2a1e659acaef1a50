"""Query op1: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.decontamination import benchmark_windows, covered_words, find_hits, hit_items

OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item, k, array_to_string(words[s + 1 : s + k], ' ') AS gram
  FROM (SELECT item, words, k, unnest(range(len(words) - k + 1)) AS s
        FROM (SELECT *, least(10, len(words)) AS k FROM b WHERE len(words) > 0))),
p AS (
  SELECT rid, k, s, array_to_string(words[s + 1 : s + k], ' ') AS gram
  FROM (SELECT rid, words, k, unnest(range(len(words) - k + 1)) AS s
        FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k)),
h AS (SELECT p.rid, p.s, p.k, w.item FROM p JOIN w ON p.gram = w.gram AND p.k = w.k),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = benchmark_windows(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = find_hits(table(spark, sf_dir, "documents"), "text", windows, ["doc_id"])
    found = found.select("doc_id", "n_words", covered_words(F.col("hits")).alias("n_hit"), hit_items(F.col("hits")).alias("ids"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
