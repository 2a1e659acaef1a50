"""Annotation sources: XML objects, class lists, multi-label lines, labelled folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.masks import CATEGORIES

ANNOTATION_SCHEMA = """filename string, size struct<width: string, height: string>,
object array<struct<name: string, bndbox: struct<xmin: string, ymin: string, xmax: string, ymax: string>>>,
_corrupt_record string"""


def annotation_rows(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", "annotation")
        .option("mode", "PERMISSIVE")
        .schema(ANNOTATION_SCHEMA)
        .load(path)
    )


def unreadable_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, image, content) of what ``read_object_annotations`` has to leave out; image as far as it could be read."""
    raw = annotation_rows(spark, path).select(F.input_file_name().alias("file"), "filename", "_corrupt_record")
    bad = raw.where(F.col("_corrupt_record").isNotNull())
    return bad.select("file", F.col("filename").alias("image"), F.col("_corrupt_record").alias("content"))


def read_object_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated object; coordinates written as decimals are truncated to integers.

    Files that do not parse are left out; ``unreadable_annotations`` lists them.
    Every object carries its own name.
    """
    raw = annotation_rows(spark, path)
    parsed = raw.where(F.col("_corrupt_record").isNull()).select(
        "filename", "size", F.posexplode("object").alias("box_no", "o")
    )
    whole = lambda c: c.cast("double").cast("int")
    box = F.col("o.bndbox")
    return parsed.select(
        F.col("filename").alias("image"),
        F.col("o.name").alias("category"),
        "box_no",
        *[whole(box[n]).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")],
        whole(F.col("size.width")).alias("width"),
        whole(F.col("size.height")).alias("height"),
    )


def read_class_lists(spark: SparkSession, path: str) -> DataFrame:
    """(split, image, category) from lists ``<category>_<split>.txt`` with lines ``image flag``; flag 1 only.

    A list is a file or a folder of files; other files are left out.
    """
    whole = r"/([^/]+)_([^/_]+)\.txt(?:/[^/]*)?$"
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), whole, i)
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(part(1) != "")
    return lines.where(F.element_at(words, -1) == "1").select(
        F.url_decode(part(2)).alias("split"), words[0].alias("image"), F.url_decode(part(1)).alias("category")
    )


def read_multi_labels(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """(image, labels) from lines ``image label1 label2 ...``; ``multi`` keeps images with at least two labels."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = rows.select(words[0].alias("image"), F.slice(words, 2, F.size(words) - 1).alias("labels"))
    return rows.where(F.size("labels") >= 2) if multi else rows


def read_labelled_dirs(spark: SparkSession, root: str, categories: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """(path, category, label) of every file under <root>/<category>/; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    category = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    order = F.array(*[F.lit(c) for c in categories])
    label = (F.array_position(order, F.col("category")) - 1).cast("int")
    return files.select("path", category.alias("category")).withColumn("label", label).where("label >= 0")
