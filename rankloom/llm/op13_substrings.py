"""Query op13: words of all documents outside passages of 50 words that a lesser id holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import query, table
from rankloom.llm.substrings import with_repeats

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
p AS (
  SELECT rid, doc_id, s, md5(array_to_string(words[s + 1 : s + 50], ' ')) AS gram
  FROM (SELECT rid, doc_id, words, unnest(range(len(words) - 49)) AS s FROM d WHERE len(words) >= 50)),
m AS (SELECT gram, min(doc_id) AS low FROM p GROUP BY gram),
h AS (SELECT rid, s FROM p JOIN m USING (gram) WHERE low < doc_id),
c AS (SELECT DISTINCT rid, unnest(range(s, s + 50)) AS pos FROM h),
w AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM w ANTI JOIN c USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


@query("op13_substrings", OP13_SQL)
def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
