"""Query op10: how many words of every document the mix takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.mixing import mix, taken_words, word_count
from rankloom.operators.chunks import written_once

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () * 1.5 AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
fill AS (
  SELECT 0 AS step, s.*, CAST(NULL AS DOUBLE) AS fixed FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, total,
         CASE WHEN fixed IS NOT NULL THEN fixed
              WHEN w * (total - coalesce(sum(fixed) OVER (), 0)) / sum(CASE WHEN fixed IS NULL THEN w END) OVER () > 2 * source_size
              THEN 2.0 * source_size END
  FROM fill WHERE step < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size,
         coalesce(fixed, w * (total - coalesce(sum(fixed) OVER (), 0)) / sum(CASE WHEN fixed IS NULL THEN w END) OVER ())::DOUBLE AS target
  FROM fill WHERE step = (SELECT count(*) FROM s)),
p AS (
  SELECT d.*, source_size, target, round_even(target, 0)::BIGINT AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size, rid) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start) + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken
FROM p
"""


@query("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written_once(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    taken = taken_words(mix(sized, WEIGHTS, SHARE, MOST))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
