"""Realtime counter groups over shared partial panes, with a side output for late rows.

Every micro-batch is counted once into small panes (time slice, group, key, one
count per kind); what several windows need is a sum over panes, so a 30-day and
a 1-hour window share the same stored counts.  A row is late when the watermark
of the batches before has passed the end of its pane; late rows are stored as
they came, not dropped.  Panes and late rows of a batch are published under its
number, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.streaming.learning import start_batches
from rankloom.streaming.processors import micros
from rankloom.streaming.versions import VersionedTable

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class CounterGroup:
    """Counters of one key: a slot for each kind and window, kinds outermost.  Windows are whole panes."""

    name: str
    key: str
    kinds: Sequence[str]
    windows: Sequence[int]

    @property
    def width(self) -> int:
        return len(self.kinds) * len(self.windows)


class PaneTable:
    """Panes, late rows and watermarks of one stream under a root."""

    def __init__(self, spark: SparkSession, root: str, pane_us: int = HOUR_US, lateness_us: int = HOUR_US):
        self.spark, self.pane_us, self.lateness_us = spark, pane_us, lateness_us
        self.panes, self.late, self.marks = (VersionedTable(spark, f"{root}/{part}") for part in ("panes", "late", "marks"))

    def watermark(self, below: int | None = None) -> int | None:
        """Microseconds up to which time has passed, from the batches below this number."""
        held = self.marks.latest(below)
        last = held.first()["last_us"] if held is not None else None
        return None if last is None else last - self.lateness_us

    def counted(self, rows: DataFrame, groups: Sequence[CounterGroup], kind: str, ts: str) -> DataFrame:
        """(pane, group, key, a count for each kind) of all groups, in one scan and one shuffle."""
        kinds = list(dict.fromkeys(k for g in groups for k in g.kinds))
        targets = F.array(*[F.struct(F.lit(g.name).alias("group"), F.col(g.key).cast("string").alias("key")) for g in groups])
        pane = F.floor(micros(ts) / self.pane_us).cast("bigint").alias("pane")
        long = rows.where(F.col(kind).isin(kinds)).select(pane, F.col(kind).alias("kind"), F.explode(targets).alias("t"))
        return long.groupBy("pane", "t.group", "t.key").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])

    def add(self, batch: DataFrame, batch_id: int, groups: Sequence[CounterGroup], kind: str, ts: str, fold_every: int) -> None:
        """Count a micro-batch; rows without a time go with the late ones."""
        before = self.watermark(batch_id)
        batch = batch.persist()
        try:
            at = micros(ts)
            end = (F.floor(at / self.pane_us).cast("bigint") + 1) * self.pane_us
            late = at.isNull() if before is None else F.coalesce(end <= F.lit(before), F.lit(True))
            self.panes.write(batch_id, self.counted(batch.where(~late), groups, kind, ts))
            self.late.write(batch_id, batch.where(late))
            last = batch.agg(F.max(at).alias("last_us"))
            if before is not None:
                last = last.select(F.coalesce(F.greatest("last_us", F.lit(before + self.lateness_us)), F.lit(before + self.lateness_us)).alias("last_us"))
            self.marks.write(batch_id, last)
        finally:
            batch.unpersist()
        self.panes.fold(batch_id, fold_every, summed)
        self.late.fold(batch_id, fold_every, lambda df: df)
        self.marks.fold(batch_id, fold_every, lambda df: df.agg(F.max("last_us").alias("last_us")))

    def read(self, closed: bool = True) -> DataFrame:
        """(pane, group, key, counts); ``closed`` leaves out panes that rows may still come for."""
        found = summed(self.panes.union_all())
        mark = self.watermark()
        return found.where((F.col("pane") + 1) * self.pane_us <= F.lit(mark)) if closed else found

    def late_rows(self) -> DataFrame:
        """Late rows as they came."""
        return self.late.union_all()


def summed(panes: DataFrame) -> DataFrame:
    keys = ["pane", "group", "key"]
    return panes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in panes.columns if c not in keys])


def stream_counter_groups(
    stream: DataFrame,
    groups: Sequence[CounterGroup],
    root: str,
    checkpoint: str,
    kind: str = "event_type",
    ts: str = "ts",
    pane_us: int = HOUR_US,
    lateness_us: int = HOUR_US,
    fold_every: int = 100,
    available_now: bool = True,
) -> StreamingQuery:
    """All counter groups from one stream; a hot key is combined before the shuffle of each batch."""
    table = PaneTable(stream.sparkSession, root, pane_us, lateness_us)
    return start_batches(stream, lambda df, n: table.add(df, n, groups, kind, ts, fold_every), checkpoint, available_now)


def window_slots(panes: DataFrame, group: CounterGroup, asof_pane: Column) -> DataFrame:
    """(key, slots) of one group: counts of the windows that end where pane ``asof_pane`` begins, in one aggregation."""
    mine = panes.where((F.col("group") == group.name) & (F.col("pane") < asof_pane) & (F.col("pane") >= asof_pane - max(group.windows)))
    inside = lambda k, w: F.coalesce(F.sum(F.when(F.col("pane") >= asof_pane - w, F.col(k))), F.lit(0))
    return mine.groupBy("key").agg(F.array(*[inside(k, w) for k in group.kinds for w in group.windows]).alias("slots"))
