"""Readers of sample tables, date ranges, feature maps and fixed-width records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.checks import is_unset, require_columns
from rankloom.sources.files import path_exists

DAY_LAYOUTS = {
    "nested": "%Y/%m/%d",  # <root>/2024/01/31
    "dash": "%Y-%m-%d",  # <root>/2024-01-31
    "hive": "dt=%Y-%m-%d",  # <root>/dt=2024-01-31
}
DAY_PATTERNS = {
    "nested": r"/(\d{4})/(\d{2})/(\d{2})/[^/]*$",
    "dash": r"/(\d{4})-(\d{2})-(\d{2})/[^/]*$",
    "hive": r"/dt=(\d{4})-(\d{2})-(\d{2})/[^/]*$",
}


def read_dataset(spark: SparkSession, root: str, suffix: str | None) -> DataFrame | None:
    """Parquet under <root>/<suffix>; an unset suffix means no dataset, a missing path is an error."""
    if is_unset(suffix):
        return None
    path = f"{root}/{suffix}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} not exists!")
    return spark.read.parquet(path)


def parse_day(text: str | date) -> date:
    if isinstance(text, date):
        return text
    return datetime.strptime(text, "%Y%m%d" if len(text) == 8 else "%Y-%m-%d").date()


def date_list(begin: str | date, end: str | date, step: int = 1) -> list[date]:
    """Inclusive list of days."""
    first, last = parse_day(begin), parse_day(end)
    return [first + timedelta(days=i) for i in range(0, (last - first).days + 1, step)]


def lookback_list(end: str | date, days: int) -> list[date]:
    """The ``days`` days before ``end`` and ``end`` itself: days + 1 entries."""
    last = parse_day(end)
    return date_list(last - timedelta(days=days), last)


def date_partitions(df: DataFrame, begin: Column, end: Column, step: int = 1, out: str = "day") -> DataFrame:
    """One row per day between two date columns, inclusive; ``df`` holds one row per range."""
    days = F.sequence(begin.cast("date"), end.cast("date"), F.make_interval(days=F.lit(step)))
    return df.select("*", F.explode(days).alias(out))


def lookback_partitions(df: DataFrame, end: Column, days: int, out: str = "day") -> DataFrame:
    return date_partitions(df, F.date_sub(end.cast("date"), days), end, out=out)


def read_date_range(
    spark: SparkSession, root: str, begin: str, end: str, with_date: bool = False, layout: str = "hive"
) -> DataFrame:
    """All days begin..end inclusive (yyyyMMdd); a missing day is an error.

    Only the folders of these days are listed, whatever else the root holds.
    ``with_date`` adds ``_date`` (yyyyMMdd) taken from the file path.
    """
    days = date_list(begin, end)
    paths = [f"{root}/{d.strftime(DAY_LAYOUTS[layout])}" for d in days]
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"{missing} not exists!")
    if layout == "hive":
        df = spark.read.option("basePath", root).parquet(*paths)
        return df.withColumn("_date", F.date_format("dt", "yyyyMMdd")) if with_date else df
    df = spark.read.parquet(*paths)
    if not with_date:
        return df
    path = F.col("_metadata.file_path")
    parts = [F.regexp_extract(path, DAY_PATTERNS[layout], i) for i in (1, 2, 3)]
    return df.withColumn("_date", F.concat(*parts))


def read_feature_map(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(idx, name) from tab separated text; names are trimmed and must be unique.

    ``by_line`` numbers slots by line order instead of by the first field.  A
    feature map is a small configuration file.
    """
    lines = spark.read.schema("idx string, name string, kind string").csv(path, sep="\t")
    named = lines.select("idx", F.trim("name").alias("name"), F.monotonically_increasing_id().alias("_at"))
    if by_line:
        slot = F.row_number().over(Window.orderBy("_at")) - 1
    else:
        slot = F.col("idx").cast("int")
    fmap = named.select(slot.cast("int").alias("idx"), "name")
    repeated = fmap.groupBy("name").count().where("count > 1").select("name").limit(10).collect()
    if repeated:
        raise ValueError(f"duplicate feature names: {sorted(r[0] for r in repeated)}")
    return fmap


def check_fixed_width(df: DataFrame, widths: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose arrays all have the stated number of elements, and the others."""
    require_columns(df, widths)
    ok = F.lit(True)
    for name, n in widths.items():
        ok = ok & F.coalesce(F.size(F.col(name)) == n, F.lit(False))
    return df.where(ok), df.where(~ok)


def read_fixed_width_records(
    spark: SparkSession,
    path: str,
    widths: dict[str, int],
    types: dict[str, str] | None = None,
    on_error: str = "fail",
    fmt: str = "parquet",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Arrays of fixed length, cast to float (or the stated element type).

    ``fail``: a wrong length fails the job; ``quarantine``: returns (good, bad).
    """
    source = spark.read.format(fmt).load(path)
    require_columns(source, widths)
    types = types or {}
    cast = source.withColumns({n: F.col(n).cast(f"array<{types.get(n, 'float')}>") for n in widths})
    if on_error == "quarantine":
        return check_fixed_width(cast, widths)
    checked = {}
    for n, w in widths.items():
        message = F.concat(F.lit(f"{n} needs {w} values, found "), F.coalesce(F.size(n).cast("string"), F.lit("none")))
        checked[n] = F.when(F.size(n) == w, F.col(n)).otherwise(F.raise_error(message))
    return cast.withColumns(checked)


def read_part_files(spark: SparkSession, path: str, pattern: str = "part-*", fmt: str = "parquet") -> DataFrame:
    """Read only the task output files of a folder."""
    return spark.read.format(fmt).option("pathGlobFilter", pattern).load(path)


def read_embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding [, dt]) from ``id TAB v1,v2,...`` text."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path)
    rest = [c for c in lines.columns if c != "value"]
    return lines.select(
        parts[0].cast("bigint").alias("id"), F.split(parts[1], ",").cast("array<float>").alias("embedding"), *rest
    )


def dated_suffixes(paths: Sequence[str], days: Sequence[date], layout: str = "dash") -> list[str]:
    """Every root crossed with every day folder (configuration-sized)."""
    return [f"{p}/{d.strftime(DAY_LAYOUTS[layout])}" for p in paths for d in days]
