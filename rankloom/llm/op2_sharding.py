"""Query op2: a shard for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm.common import query, table
from rankloom.llm.sharding import place

SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: a prime of more than 100 slots a shard
SLOTS = 2039

OP2_SQL = f"""
WITH RECURSIVE s AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard FROM range({len(SHARDS)}) r(i)),
prefs AS (
  SELECT i, (('0x' || substr(md5('start:' || shard), 1, 15))::BIGINT % {SLOTS}) AS start,
         (('0x' || substr(md5('step:' || shard), 1, 15))::BIGINT % {SLOTS - 1}) + 1 AS step FROM s),
lists AS (SELECT list(start ORDER BY i) AS starts, list(step ORDER BY i) AS steps FROM prefs),
turns AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner FROM lists
  UNION ALL
  SELECT turn + 1, list_transform(range({SLOTS}), lambda x: CASE WHEN x = pick THEN (turn % {len(SHARDS)})::INTEGER ELSE owner[x + 1] END)
  FROM (SELECT turn, owner, list_filter(
               list_transform(range({SLOTS}), lambda j: (starts[turn % {len(SHARDS)} + 1] + j * steps[turn % {len(SHARDS)} + 1]) % {SLOTS}),
               lambda p: owner[p + 1] < 0)[1] AS pick
        FROM turns, lists WHERE turn < {SLOTS})),
filled AS (SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS i FROM turns WHERE turn = {SLOTS})
SELECT doc_id, slot::INTEGER AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
JOIN filled USING (slot) JOIN s USING (i)
"""


@query("op2_sharding", OP2_SQL)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)
