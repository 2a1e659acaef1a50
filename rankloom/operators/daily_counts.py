"""Horizon counts that move by one day without reading the days before again.

Every day's events are counted once into a stored table of partial counts.
The counts of all horizons as of the next day are those of the day before,
plus the new day, minus for each horizon the day that has left it: one union
of small tables and one shuffle, whatever the longest horizon is.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.checks import require_columns
from rankloom.plans.contract import HORIZONS
from rankloom.sources.files import is_complete
from rankloom.sources.writers import write_compressed


def day_counts(events: DataFrame, keys: Sequence[str], kinds: dict[str, str], day: date, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """(keys, one count for each kind) of one day; the day's limits reach the scan as a filter."""
    require_columns(events, [*keys, kind, ts])
    start, end = (F.lit(f"{d} 00:00:00").cast(events.schema[ts].dataType) for d in (day, day + timedelta(days=1)))
    rows = events.where((F.col(ts) >= start) & (F.col(ts) < end) & F.col(kind).isin(list(kinds.values())))
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(kind) == v).alias(n) for n, v in kinds.items()])


class RollingCounts:
    """Counts of kinds per key over several horizons, one finished folder for each day under a root."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], kinds: dict[str, str], horizons: Sequence[int] = tuple(HORIZONS)):
        self.spark, self.root, self.keys, self.kinds, self.horizons = spark, root.rstrip("/"), list(keys), kinds, sorted(horizons)

    def _path(self, part: str, day: date) -> str:
        return f"{self.root}/{part}/{day:%Y%m%d}"

    def _stored(self, part: str, day: date) -> DataFrame | None:
        path = self._path(part, day)
        return self.spark.read.parquet(path) if is_complete(self.spark, path) else None

    def names(self) -> list[str]:
        return [f"{n}_{h}d" for h in self.horizons for n in self.kinds]

    def _signed(self, counts: DataFrame, sign: Column) -> DataFrame:
        """Day counts as changes of the horizon counts: ``sign`` is an array with a factor for each horizon."""
        return counts.select(*self.keys, *[(F.col(n) * sign[i]).alias(f"{n}_{h}d") for i, h in enumerate(self.horizons) for n in self.kinds])

    def _summed(self, parts: Sequence[DataFrame]) -> DataFrame:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sums = every.groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.names()])
        # a key that has left the longest horizon has left the table
        return sums.where(" + ".join(f"`{n}_{self.horizons[-1]}d`" for n in self.kinds) + " > 0")

    def count_day(self, events: DataFrame, day: date, **names: str) -> DataFrame:
        """The day's partial counts, made from its events unless they are stored already."""
        held = self._stored("days", day)
        if held is None:
            write_compressed(day_counts(events, self.keys, self.kinds, day, **names), self._path("days", day))
            held = self._stored("days", day)
        return held

    def roll(self, events: DataFrame, day: date, **names: str) -> DataFrame:
        """Counts of the windows that end with ``day``, from those of the day before.

        Only ``day`` is read from ``events``.  Without the table of the day
        before it is made from the stored partial counts.  A day that is
        finished is not made again.
        """
        done = self._stored("state", day)
        if done is not None:
            return done
        today = self.count_day(events, day, **names)
        before = self._stored("state", day - timedelta(days=1))
        if before is None:
            return self.rebuild(day)
        parts = [before, self._signed(today, F.array(*[F.lit(1)] * len(self.horizons)))]
        for i, h in enumerate(self.horizons):
            gone = self._stored("days", day - timedelta(days=h))
            if gone is not None:
                parts.append(self._signed(gone, F.array(*[F.lit(-1 if k == i else 0) for k in range(len(self.horizons))])))
        write_compressed(self._summed(parts), self._path("state", day))
        return self._stored("state", day)

    def rebuild(self, day: date) -> DataFrame:
        """The same from all stored partial counts of the longest horizon."""
        parts = []
        for back in range(self.horizons[-1]):
            counts = self._stored("days", day - timedelta(days=back))
            if counts is not None:
                parts.append(self._signed(counts, F.array(*[F.lit(1 if back < h else 0) for h in self.horizons])))
        if not parts:
            raise ValueError(f"no counted day up to {day}")
        write_compressed(self._summed(parts), self._path("state", day))
        return self._stored("state", day)
