"""Keyed state with timers: recent items per key that expire.

It runs on the RocksDB state store.  A key is shared by ``salts`` states, so
one with very many events is worked on by as many tasks; a state's rows come
in chunks, and what it holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECENT_STATE = "at bigint, id bigint, item bigint, known int"


class RecentItems(StatefulProcessor):
    """List state of the newest ``n`` (time, event, item); a timer empties a state that had no event for a while."""

    def __init__(self, names: list[str], n: int, expire_us: int | None):
        self.names, self.n, self.expire_us = names, n, expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", RECENT_STATE)

    def _row(self, key: tuple, kept: pd.DataFrame) -> pd.DataFrame:
        lists = [[kept[c].tolist()] for c in ("at", "id", "item", "known")]
        return pd.DataFrame({**{c: [v] for c, v in zip(self.names, key)}, **dict(zip(("at", "id", "item", "known"), lists))})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.items.get()), columns=["at", "id", "item", "known"], dtype="int64")
        for chunk in rows:
            both = pd.concat([kept, chunk[["at", "id", "item", "known"]].astype("int64")])
            kept = both.drop_duplicates().sort_values(["at", "id", "item"], ascending=False).head(self.n)
        self.items.put([tuple(r) for r in kept.to_numpy().tolist()])
        if self.expire_us is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(kept["at"].max() + self.expire_us) // 1000)
        yield self._row(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        yield self._row(key, pd.DataFrame([], columns=["at", "id", "item", "known"], dtype="int64"))

    def close(self) -> None:
        pass


def start_keyed(
    rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, store, checkpoint: str, timed: bool, available_now: bool
) -> StreamingQuery:
    """Run a processor over ``rows`` and hand each micro-batch of its output to ``store``.

    The state-store setting of the session is put back once the query has it.
    """
    spark: SparkSession = rows.sparkSession
    before = spark.conf.get(STORE_CONF, None)
    out = rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "EventTime" if timed else "None")
    writer = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    spark.conf.set(STORE_CONF, ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(STORE_CONF)
        else:
            spark.conf.set(STORE_CONF, before)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def salted(event_id: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(salts)).cast("int")


def key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {types[k]}" for k in keys)
