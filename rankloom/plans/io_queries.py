"""Sources and sinks: what is written comes back the same.

Every query writes a given table to the shared scratch folder and reads it
through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators.encoders import dense_index
from rankloom.plans.embedding_queries import boxes
from rankloom.plans.metric_queries import LABEL, predictions
from rankloom.plans.registry import query, table
from rankloom.session import scratch_path
from rankloom.sources import annotations, readers, writers


@query("read_dataset", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders")
def read_dataset(spark, sf_dir):
    df = readers.read_dataset(spark, sf_dir, "orders.parquet")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


def daily_events(spark, sf_dir, layout):
    """events rewritten into one folder per day."""
    root = scratch_path(spark, f"events-{layout}")
    events = table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    if layout == "hive":
        events.write.partitionBy("dt").parquet(root)
    else:
        # yyyy/MM/dd folders: what partitionBy wrote under "y=.../m=.../d=..." cannot be named so, hence one write a day
        for (day,) in events.select("dt").distinct().orderBy("dt").collect():
            events.where(F.col("dt") == F.lit(day)).drop("dt").coalesce(1).write.parquet(f"{root}/{day.strftime(readers.DAY_LAYOUTS[layout])}")
    return root


_RANGE_SQL = """SELECT strftime(ts, '%Y%m%d') AS _date, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1"""


@query("read_date_range", _RANGE_SQL)
def read_date_range(spark, sf_dir):
    root = daily_events(spark, sf_dir, "hive")
    df = readers.read_date_range(spark, root, "20240105", "20240120", with_date=True)
    return df.groupBy("_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("read_date_range_nested", _RANGE_SQL)
def read_date_range_nested(spark, sf_dir):
    root = daily_events(spark, sf_dir, "nested")
    df = readers.read_date_range(spark, root, "20240105", "20240120", with_date=True, layout="nested")
    return df.groupBy("_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "date_partitions",
    """
WITH d AS (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 2 DAY)) AS day FROM events)
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d.day AS DATE) GROUP BY 1""",
)
def date_partitions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("b"), F.max("ts").alias("e"))
    days = readers.date_partitions(span, F.col("b"), F.col("e"), step=2).select("day")
    joined = days.join(events.select(F.to_date("ts").alias("day"), "event_id"), "day", "left")
    return joined.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("event_id").alias("n"))


@query(
    "lookback_partitions",
    """
WITH d AS (SELECT unnest(generate_series(CAST(max(ts) AS DATE) - INTERVAL 16 DAY, CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS day FROM events)
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d.day AS DATE) GROUP BY 1""",
)
def lookback_partitions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    span = events.agg(F.max("ts").alias("e"))
    days = readers.lookback_partitions(span, F.col("e"), 16).select("day")
    joined = days.join(events.select(F.to_date("ts").alias("day"), "event_id"), "day", "left")
    return joined.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("event_id").alias("n"))


@query(
    "fixed_width_records",
    """SELECT label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1""",
)
def fixed_width_records(spark, sf_dir):
    records = readers.read_fixed_width_records(spark, f"{sf_dir}/embeddings.parquet", {"embedding": 64})
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return records.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 4).alias("total"))


@query("read_part_files", "SELECT s_suppkey, s_name FROM supplier")
def read_part_files(spark, sf_dir):
    path = scratch_path(spark, "parts")
    table(spark, sf_dir, "supplier").write.parquet(path)
    return readers.read_part_files(spark, path).select("s_suppkey", "s_name")


@query("write_compressed", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def write_compressed(spark, sf_dir):
    path = scratch_path(spark, "customer")
    writers.write_compressed(table(spark, sf_dir, "customer"), path, rows_per_file=500)
    back = spark.read.parquet(path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("materialize_once", f"SELECT {LABEL} AS label, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def materialize_once(spark, sf_dir):
    path = scratch_path(spark, "samples")
    build = lambda: predictions(spark, sf_dir).where("l_quantity > 10")
    writers.materialize_once(spark, path, build)

    def never():
        raise AssertionError("a finished table is not built again")

    again = writers.materialize_once(spark, path, never)
    return again.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_predictions",
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS goods_id, CAST({LABEL} AS DOUBLE) AS label,
       round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 6) AS probability FROM lineitem""",
)
def write_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(predictions(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select(
        "user_id", "goods_id", F.col("label").cast("double").alias("label"), F.round(F.col("probability").cast("double"), 6).alias("probability")
    )


@query(
    "export_embeddings",
    """SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(v AS DOUBLE), 5) AS v, '2024-01-31' AS dt
FROM (SELECT vec_id, unnest(generate_series(1, 64)) AS i, unnest(embedding) AS v FROM embeddings)""",
)
def export_embeddings(spark, sf_dir):
    path = scratch_path(spark, "embedding-text")
    writers.export_embeddings(table(spark, sf_dir, "embeddings"), path, "2024-01-31", "vec_id", "embedding")
    back = readers.read_embeddings_text(spark, path)
    rows = back.select("id", F.posexplode("embedding").alias("pos", "v"), F.date_format("dt", "yyyy-MM-dd").alias("dt"))
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 5))


@query(
    "write_feature_scores",
    """SELECT l_partkey AS name_key, 'part_' || CAST(l_partkey AS VARCHAR) AS name, round(sum(l_quantity), 2) AS score FROM lineitem
GROUP BY 1 ORDER BY score DESC, name LIMIT 100""",
)
def write_feature_scores(spark, sf_dir):
    path = scratch_path(spark, "scores")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    scores = grouped.select(F.concat(F.lit("part_"), "l_partkey").alias("name"), "score", F.col("l_partkey").alias("name_key"))
    return writers.write_feature_scores(scores, path).select("name_key", "name", "score")


@query(
    "read_feature_map",
    """SELECT CAST(row_number() OVER (ORDER BY n DESC, p_name) - 1 AS INTEGER) AS idx, p_name AS name
FROM (SELECT trim(p_name) AS p_name, count(*) AS n FROM part GROUP BY 1)""",
)
def read_feature_map(spark, sf_dir):
    path = scratch_path(spark, "fmap")
    index = dense_index(table(spark, sf_dir, "part"), "p_name")
    index.select("idx", "p_name").write.csv(path, sep="\t")
    return readers.read_feature_map(spark, path)


#: annotations in one file
RECORDS_PER_FILE = 100_000


@query(
    "read_object_annotations",
    """SELECT CAST(l_orderkey AS VARCHAR) AS image, l_returnflag AS category, count(*) AS n, CAST(sum(l_linenumber * 10) AS BIGINT) AS xmin_total,
       CAST(sum(CAST(l_suppkey + floor(l_tax * 100) AS INTEGER)) AS BIGINT) AS ymax_total FROM lineitem GROUP BY 1, 2""",
)
def read_object_annotations(spark, sf_dir):
    """One annotation per order line, written as XML text and read back; an order's objects come from all its records."""
    path = scratch_path(spark, "annotations")
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    record = boxes(spark, sf_dir).select(
        F.col("image").cast("string").alias("filename"),
        F.struct("width", "height").alias("size"),
        F.array(F.struct(F.col("category").alias("name"), box.alias("bndbox"))).alias("object"),
    )
    # a file of XML is read by one task; its tags take most of its bytes
    text = record.write.format("xml").option("rowTag", "annotation").option("compression", "gzip")
    text.option("maxRecordsPerFile", RECORDS_PER_FILE).save(path)
    rows = annotations.read_object_annotations(spark, path)
    return rows.groupBy("image", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("xmin").alias("xmin_total"), F.sum("ymax").alias("ymax_total")
    )


@query(
    "read_multi_labels",
    """
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS image, array_to_string(kinds, ' ') AS labels FROM s WHERE len(kinds) >= 2""",
)
def read_multi_labels(spark, sf_dir):
    path = scratch_path(spark, "multi-labels")
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    lines = kinds.select(F.concat_ws(" ", F.col("user_id").cast("string"), F.array_join("k", " ")).alias("value"))
    lines.write.text(path)
    rows = annotations.read_multi_labels(spark, path, multi=True)
    return rows.select("image", F.array_join("labels", " ").alias("labels"))


@query(
    "read_class_lists",
    """SELECT l_linestatus AS split, l_returnflag AS category, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS images
FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2""",
)
def read_class_lists(spark, sf_dir):
    """One list for each class and split, written from all rows; flags 1, 0 and -1."""
    root = scratch_path(spark, "lists")
    flag = F.when(F.col("l_quantity") > 25, "1").when(F.col("l_quantity") > 20, "0").otherwise("-1")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.concat_ws("  ", F.col("l_orderkey").cast("string"), flag).alias("value")
    )
    for category in "ANR":
        for split in "FO":
            mine = (F.col("l_returnflag") == category) & (F.col("l_linestatus") == split)
            rows.where(mine).select("value").write.text(f"{root}/{category}_{split}.txt")
    found = annotations.read_class_lists(spark, root)
    return found.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("image").cast("bigint")).alias("images"))


FOLDERS = ["bird", "cat", "cow", "dog", "horse", "sheep", "tree"]


@query(
    "read_labelled_dirs",
    f"""SELECT category, CAST(list_position({FOLDERS!r}, category) - 1 AS INTEGER) AS label, 4 AS files, count(*) AS n
FROM (SELECT ({FOLDERS!r})[l_linenumber] AS category FROM lineitem) WHERE category <> 'tree' GROUP BY 1""",
)
def read_labelled_dirs(spark, sf_dir):
    """All rows in folders by class, four files each; a folder of no class is left out."""
    root = scratch_path(spark, "folders")
    rows = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_orderkey").cast("string"))
    for number, category in enumerate(FOLDERS, 1):
        rows.where(F.col("l_linenumber") == number).select("value").repartition(4).write.text(f"{root}/{category}")
    files = annotations.read_labelled_dirs(spark, root)
    lines = spark.read.option("recursiveFileLookup", "true").text(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1).alias("file")
    found = files.select("category", "label", name("path")).join(lines.select(name("path"), "n"), "file", "left")
    return found.groupBy("category", "label").agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("n").alias("n"))
