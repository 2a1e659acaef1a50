"""What several of the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: words of the contracts: anything between the six white-space characters of ASCII
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def split_words(text: Column, gap: str) -> Column:
    """Words between matches of ``gap``; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def join_rows(docs: DataFrame, keys: Sequence[str], other: DataFrame, how: str) -> DataFrame:
    """Join on ``keys`` of ``docs`` and the first columns of ``other``; null equals null.

    No name of ``other`` clashes with one of ``docs``: its keys are dropped
    after a join that shows them, its other columns keep their names.
    """
    names = [free_name([*docs.columns, *other.columns], f"_key{i}") for i in range(len(keys))]
    other = other.toDF(*names, *other.columns[len(keys) :])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return docs.join(other, same, how).drop(*names)


def digest_of(*columns: Column) -> Column:
    """16 bytes that tell rows apart by these texts; null is taken as empty."""
    one = lambda c: F.unhex(F.md5(F.coalesce(c.cast("string"), F.lit(""))))
    return one(columns[0]) if len(columns) == 1 else F.unhex(F.md5(F.concat(*[one(c) for c in columns])))


#: bytes of a batch that goes to a Python worker
BATCH_LIMIT = "8m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: its functions run there by name."""
    context = spark.sparkContext
    if any("rankloom-src" in name for name in context._python_includes):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="rankloom-src-")) / "rankloom-src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))


def python_workers(spark: SparkSession) -> None:
    """Make ready for Python workers.

    They get the package, and batches are bounded by bytes where the session
    has Spark's own, larger limit.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_CONF) == "67108864b":
        spark.conf.set(BATCH_CONF, BATCH_LIMIT)


small_batches = python_workers
