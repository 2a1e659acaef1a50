"""Sample preparation and categorical dictionaries."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rankloom.functions import arrays, scalars, vectors
from rankloom.operators import encoders, joins, samples
from rankloom.operators.chunks import positions
from rankloom.plans.metric_queries import LABEL
from rankloom.plans.registry import query, table
from rankloom.session import scratch_path

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RAND = "(CAST((CAST(l_orderkey AS HUGEINT) * 2654435761) % 1000 AS DOUBLE) / 1000)"


def sample_table(spark, sf_dir):
    """user, item, label, rand and a four-slot feature vector from lineitem."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("goods_id"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        scalars.key_fraction(F.col("l_orderkey")).alias("rand"),
        *FEATURES,
    )
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).drop(*FEATURES)


def _slots(vector, n):
    return [F.round(vector[i], 6).alias(f"f{i}") for i in range(n)]


@query(
    "densify_features",
    "SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM lineitem",
)
def densify_features(spark, sf_dir):
    dense = vectors.densify(vectors.to_ml_vector(sample_table(spark, sf_dir)))
    return dense.select("l_orderkey", "l_linenumber", *_slots(vector_to_array("features"), 4))


@query(
    "merge_category_features",
    """SELECT l_orderkey, l_linenumber, 6 AS width, CAST(l_suppkey AS DOUBLE) AS f0, CAST(l_partkey AS DOUBLE) AS f1,
       l_quantity AS f2, l_extendedprice AS f3, l_discount AS f4, l_tax AS f5 FROM lineitem""",
)
def merge_category_features(spark, sf_dir):
    merged = samples.merge_category_features(sample_table(spark, sf_dir), "user_id,goods_id")
    values = vector_to_array("features")
    return merged.select("l_orderkey", "l_linenumber", F.size(values).alias("width"), *_slots(values, 6))


@query(
    "exclude_features",
    """
SELECT vec_id, 64 AS width, round(sum(CASE WHEN i IN (3, 17, 40) THEN 0 ELSE v END), 5) AS total,
       CAST(sum(CASE WHEN i IN (3, 17, 40) OR v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros
FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""",
)
def exclude_features(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    width = emb.agg(F.max(F.size("features")).alias("w"))
    fmap = width.select(F.posexplode(F.sequence(F.lit(0), F.col("w") - 1)).alias("idx", "slot")).select(
        "idx", F.concat(F.lit("f"), F.col("slot")).alias("name")
    )
    out = samples.exclude_features(emb, fmap, "f3,f17,f40,not_a_feature")
    zeros = F.size(F.filter("features", lambda v: v == 0)).cast("bigint")
    return out.select(
        "vec_id", F.size("features").alias("width"), F.round(arrays.array_sum(F.col("features")), 5).alias("total"), zeros.alias("zeros")
    )


@query(
    "drop_columns_merge",
    """SELECT p_partkey, concat_ws(',', CAST(p_size AS VARCHAR), CAST(CAST(trunc(p_retailprice) AS BIGINT) AS VARCHAR),
       coalesce(CAST(CASE WHEN p_size > 25 THEN p_size END AS VARCHAR), '-1')) AS features FROM part""",
)
def drop_columns_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.when(F.col("p_size") > 25, F.col("p_size")).alias("large")
    )
    return samples.drop_columns_merge(part, ["p_partkey"])


@query(
    "stratified_downsample",
    f"""SELECT l_orderkey, l_linenumber, CAST({LABEL} AS DOUBLE) AS label, {RAND} AS rand FROM lineitem
WHERE (l_returnflag = 'R' AND {RAND} <= 0.9) OR (l_returnflag <> 'R' AND {RAND} <= 0.2)""",
)
def stratified_downsample(spark, sf_dir):
    rows = sample_table(spark, sf_dir).select("l_orderkey", "l_linenumber", "label", "rand")
    return samples.stratified_downsample(rows, "label", 0.9, 0.2, "rand")


@query(
    "split_train_test",
    f"""SELECT CASE WHEN {RAND} < 0.25 THEN 'test' ELSE 'train' END AS side, {LABEL} AS label, count(*) AS n,
       CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2""",
)
def split_train_test(spark, sf_dir):
    rows = sample_table(spark, sf_dir).withColumn("label", F.col("label").cast("int"))
    train, test = samples.split_train_test(rows, fold=4, fraction=F.col("rand"))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "head_split",
    f"""SELECT CASE WHEN {RAND} < 0.05 THEN 'test' ELSE 'train' END AS side, count(*) AS n,
       CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE {RAND} < 0.85 GROUP BY 1""",
)
def head_split(spark, sf_dir):
    test, train = samples.head_split(sample_table(spark, sf_dir), F.col("rand"), 0.05, 0.8)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("file_split", "SELECT 16 AS files, 0 AS on_both_sides, true AS split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def file_split(spark, sf_dir):
    """Sixteen files of all rows: each falls wholly on one side, both sides have some, and no row is lost."""
    root = scratch_path(spark, "files")
    table(spark, sf_dir, "lineitem").repartition(16).write.parquet(root)
    sides = samples.file_split(spark.read.parquet(root), 0.5)
    name = F.col("_metadata.file_name").alias("file")
    train, valid = (df.select(F.lit(n).alias("side"), name, "l_orderkey") for n, df in zip(("train", "valid"), sides))
    files = train.unionByName(valid).groupBy("file").agg(
        F.count_distinct("side").alias("sides"), F.max("side").alias("side"), F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")
    )
    return files.agg(
        F.count(F.lit(1)).cast("int").alias("files"),
        F.count_if(F.col("sides") > 1).cast("int").alias("on_both_sides"),
        (F.count_distinct("side") == 2).alias("split"),
        F.sum("n").alias("n"),
        F.sum("keys").alias("keys"),
    )


@query(
    "binarize_target",
    "SELECT label, CASE WHEN label = 3 THEN 1 ELSE 0 END AS is_target, count(*) AS n FROM embeddings GROUP BY 1, 2",
)
def binarize_target(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", scalars.is_target(F.col("label"), 3).alias("is_target"))
    return rows.groupBy("label", "is_target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "multi_hot",
    """
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1)
SELECT user_id, CAST(list_contains(kinds, 'view') AS INTEGER) AS is_view, CAST(list_contains(kinds, 'click') AS INTEGER) AS is_click,
       CAST(list_contains(kinds, 'signup') AS INTEGER) AS is_signup, CAST(list_contains(kinds, 'purchase') AS INTEGER) AS is_purchase
FROM s WHERE len(kinds) >= 2""",
)
def multi_hot(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    vocabulary = ["view", "click", "signup", "purchase"]
    rows = kinds.where(F.size("kinds") >= 2).select("user_id", arrays.multi_hot(F.col("kinds"), vocabulary).alias("hot"))
    return rows.select("user_id", *[F.col("hot")[i].alias(f"is_{v}") for i, v in enumerate(vocabulary)])


@query(
    "parse_pair",
    f"""SELECT l_orderkey, l_linenumber, l_discount AS score, CAST({LABEL} AS DOUBLE) AS label FROM lineitem""",
)
def parse_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    packed = F.concat_ws(";", F.col("l_discount").cast("string"), (F.col("l_returnflag") == "R").cast("double").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", packed.alias("packed")).select(
        "l_orderkey",
        "l_linenumber",
        scalars.parse_pair(F.col("packed"), 0).alias("score"),
        scalars.parse_pair(F.col("packed"), 1).alias("label"),
    )


@query(
    "trim_nonempty",
    """SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
WHERE length(line) > 0""",
)
def trim_nonempty(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return samples.trim_nonempty(lines, "line")


@query(
    "fill_unknown",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_unknown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return samples.fill_unknown(joined, ["quality"]).select("doc_id", "quality", "toxic")


@query("label_distribution", f"SELECT {LABEL} AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_distribution(spark, sf_dir):
    rows = sample_table(spark, sf_dir).select(F.col("label").cast("int").alias("label"))
    return samples.label_distribution(rows)


@query(
    "dataset_profile",
    """SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels, min(len(embedding)) AS min_width,
       max(len(embedding)) AS max_width, count(*) = 0 AS is_empty FROM embeddings""",
)
def dataset_profile(spark, sf_dir):
    out = samples.dataset_profile(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("min_width", "max_width")})


@query("value_frequency", "SELECT p_type, count(*) AS n FROM part WHERE length(trim(p_type)) > 0 GROUP BY 1")
def value_frequency(spark, sf_dir):
    return samples.value_frequency(table(spark, sf_dir, "part"), "p_type")


@query(
    "distinct_counts",
    "SELECT count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_orderkey) AS l_orderkey FROM lineitem",
)
def distinct_counts(spark, sf_dir):
    return samples.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey"])


@query(
    "dedup_predictions",
    f"""SELECT user_id, goods_id, label, score FROM (SELECT l_suppkey AS user_id, l_partkey AS goods_id, CAST({LABEL} AS DOUBLE) AS label,
  l_discount AS score, row_number() OVER (PARTITION BY l_suppkey, l_partkey, {LABEL} ORDER BY l_discount DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("goods_id"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        F.col("l_discount").alias("score"),
    )
    return samples.dedup(rows, ["user_id", "goods_id", "label"], [F.col("score").desc()])


@query("top_n", "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 100")
def top_n(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return samples.top_n(rows, 100, [F.col("l_extendedprice").desc(), "l_orderkey"])


@query(
    "order_by_score",
    """SELECT l_orderkey, l_linenumber, l_discount AS probability,
row_number() OVER (ORDER BY l_discount DESC, l_orderkey, l_linenumber) - 1 AS position FROM lineitem""",
)
def order_by_score(spark, sf_dir):
    """Every row with the place it has come to."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("probability"))
    return positions(samples.order_by_score(rows, "probability", ["l_orderkey", "l_linenumber"]))


@query(
    "union_positional",
    """SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_custkey AS k FROM customer
UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY 1""",
)
def union_positional(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("supplier"), "s_suppkey")
    return samples.union_positional(customers, suppliers).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_by_name",
    "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return samples.union_by_name(customers, suppliers)


@query(
    "shuffle_rows",
    "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, CAST(sum(n) AS BIGINT) AS places, true AS moved, true AS again FROM (SELECT o_orderkey, row_number() OVER () - 1 AS n FROM orders)",
)
def shuffle_rows(spark, sf_dir):
    """All keys once and all places once; hardly a row stays where it would be by key, and a second run gives the same places."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    run = lambda df, out: positions(samples.shuffle_rows(df, ["o_orderkey"]), out)
    sorted_ = positions(keys.orderBy("o_orderkey"), "sorted")
    both = run(keys, "one").join(run(keys.repartition(7), "two"), "o_orderkey").join(sorted_, "o_orderkey")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_orderkey").alias("keys"),
        F.sum("one").alias("places"),
        (F.avg((F.col("one") != F.col("sorted")).cast("int")) > 0.9).alias("moved"),
        (F.count_if(F.col("one") != F.col("two")) == 0).alias("again"),
    )


@query("repartition_for_training", "SELECT 16 AS partitions, true AS even, true AS held, count(*) AS n FROM lineitem")
def repartition_for_training(spark, sf_dir):
    """Sixteen partitions of about the same size, held in memory until they are released."""
    even = samples.repartition_for_training(sample_table(spark, sf_dir).select("label"), 16)
    try:
        sizes = even.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.count(F.lit(1)), F.max("n") <= 1.1 * F.avg("n") + 8, F.sum("n")).first()
        held = even.storageLevel.useMemory and even.storageLevel.useDisk
    finally:
        even.unpersist()
    return spark.createDataFrame([(row[0], row[1], held, row[2])], "partitions int, even boolean, held boolean, n bigint")


# ---------------------------------------------------------------- dictionaries

_PART_LONG = """(SELECT 'p_brand' AS col, trim(p_brand) AS v FROM part UNION ALL SELECT 'p_type', trim(p_type) FROM part
 UNION ALL SELECT 'p_name', trim(p_name) FROM part)"""
PART_DICTIONARY = f"""(SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) - 1 AS idx
 FROM (SELECT col, v, count(*) AS n FROM {_PART_LONG} WHERE length(v) > 0 GROUP BY 1, 2))"""
PART_COLUMNS = ["p_brand", "p_type", "p_name"]


@query("dense_index", "SELECT p_name, row_number() OVER (ORDER BY n DESC, p_name) - 1 + 5 AS idx FROM (SELECT trim(p_name) AS p_name, count(*) AS n FROM part GROUP BY 1)")
def dense_index(spark, sf_dir):
    return encoders.dense_index(table(spark, sf_dir, "part"), "p_name", start=5)


@query("fit_dictionary", f'SELECT col AS "column", v AS value, idx FROM {PART_DICTIONARY}')
def fit_dictionary(spark, sf_dir):
    return encoders.FrequencyEncoder(PART_COLUMNS).fit(table(spark, sf_dir, "part")).dictionary


@query(
    "encode_columns",
    f"""
WITH d AS {PART_DICTIONARY}
SELECT p_partkey, b.idx AS p_brand, t.idx AS p_type, n.idx AS p_name FROM part
LEFT JOIN d b ON b.col = 'p_brand' AND b.v = trim(p_brand)
LEFT JOIN d t ON t.col = 'p_type' AND t.v = trim(p_type)
LEFT JOIN d n ON n.col = 'p_name' AND n.v = trim(p_name)""",
)
def encode_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    return encoders.FrequencyEncoder(PART_COLUMNS).fit(part).transform(part)


@query(
    "encode_columns_long",
    f"""
WITH d AS {PART_DICTIONARY}
SELECT p_partkey, b.idx AS p_brand, t.idx AS p_type, n.idx AS p_name FROM part
LEFT JOIN d b ON b.col = 'p_brand' AND b.v = trim(p_brand)
LEFT JOIN d t ON t.col = 'p_type' AND t.v = trim(p_type)
LEFT JOIN d n ON n.col = 'p_name' AND n.v = trim(p_name)""",
)
def encode_columns_long(spark, sf_dir):
    """The same without any broadcast: one join with a bucketed dictionary for all columns, one regrouping."""
    part = table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    known = encoders.save_bucketed(encoders.fit_dictionary(part, PART_COLUMNS), f"dictionary_{uuid.uuid4().hex}")
    return encoders.encode_columns(part, known, PART_COLUMNS, 0)


_OLD = "l_shipdate < TIMESTAMP '1996-06-01'"
_LINE_LONG = """(SELECT 'l_orderkey' AS col, CAST(l_orderkey AS VARCHAR) AS v, l_shipdate FROM lineitem
 UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR), l_shipdate FROM lineitem)"""
_EXTENDED = f"""
o AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) - 1 AS idx
      FROM (SELECT col, v, count(*) AS n FROM {_LINE_LONG} WHERE {_OLD} GROUP BY 1, 2)),
m AS (SELECT col, max(idx) AS top FROM o GROUP BY 1),
f AS (SELECT a.col, a.v, count(*) AS n FROM {_LINE_LONG} a LEFT JOIN o ON o.col = a.col AND o.v = a.v WHERE o.v IS NULL GROUP BY 1, 2),
x AS (SELECT col, v, idx FROM o UNION ALL
      SELECT f.col, f.v, m.top + row_number() OVER (PARTITION BY f.col ORDER BY f.n DESC, f.v) FROM f JOIN m ON f.col = m.col)"""


def _yesterday(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows, rows.where(F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz"))


@query("extend_dictionary", f'WITH {_EXTENDED} SELECT col AS "column", v AS value, idx FROM x')
def extend_dictionary(spark, sf_dir):
    rows, old = _yesterday(spark, sf_dir)
    first = encoders.FrequencyEncoder(["l_orderkey", "l_partkey"]).fit(old)
    return first.extend(rows).dictionary


@query(
    "encode_one_row_per_item",
    f"""
WITH {_EXTENDED},
e AS (SELECT l_partkey AS goods_id, x.idx AS l_orderkey, l_quantity FROM lineitem JOIN x ON x.col = 'l_orderkey' AND x.v = CAST(l_orderkey AS VARCHAR))
SELECT goods_id, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY goods_id ORDER BY l_orderkey, l_quantity) AS rn FROM e) WHERE rn = 1""",
)
def encode_one_row_per_item(spark, sf_dir):
    rows, old = _yesterday(spark, sf_dir)
    encoder = encoders.FrequencyEncoder(["l_orderkey", "l_partkey"]).fit(old).extend(rows)
    encoder = encoders.FrequencyEncoder(["l_orderkey"], encoder.dictionary)
    items = rows.select(F.col("l_partkey").alias("goods_id"), "l_orderkey", "l_quantity")
    return encoder.transform(items, unique_key="goods_id", order=["l_orderkey", "l_quantity"])


@query(
    "split_seen_unseen",
    f"""
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE {_OLD})
SELECT CASE WHEN o.l_orderkey IS NULL THEN 'unseen' ELSE 'seen' END AS part, count(*) AS n, count(DISTINCT l.l_orderkey) AS keys
FROM lineitem l LEFT JOIN o ON o.l_orderkey = l.l_orderkey GROUP BY 1""",
)
def split_seen_unseen(spark, sf_dir):
    rows, old = _yesterday(spark, sf_dir)
    dictionary = encoders.fit_dictionary(old, ["l_orderkey"])
    counts = encoders.value_counts(rows, "l_orderkey")
    seen, unseen = encoders.split_seen_unseen(counts, dictionary, "l_orderkey")
    both = seen.withColumn("part", F.lit("seen")).unionByName(unseen.withColumn("part", F.lit("unseen")))
    return both.groupBy("part").agg(F.sum("n").alias("n"), F.count("l_orderkey").alias("keys"))


@query("max_index", f'WITH {_EXTENDED} SELECT col AS "column", max(idx) AS max_idx FROM x GROUP BY 1')
def max_index(spark, sf_dir):
    rows, old = _yesterday(spark, sf_dir)
    columns = ["l_orderkey", "l_partkey"]
    return encoders.max_index(encoders.extend_dictionary(rows, encoders.fit_dictionary(old, columns), columns))


# ---------------------------------------------------------------- side tables


@query(
    "reattach_side_table",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
def reattach_side_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    side = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return joins.reattach(rows, side, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_size")


@query(
    "attach_weight",
    """
WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS weight FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, coalesce(w.weight, 1.0) AS weight FROM events e LEFT JOIN w ON w.user_id = e.user_id AND w.day = CAST(e.ts AS DATE)""",
)
def attach_weight(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    weights = events.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.round(F.sum("value"), 4).alias("weight"))
    rows = events.select("event_id", "user_id", "day")
    return joins.attach_weight(rows, weights, ["user_id", "day"]).select("event_id", "weight")


@query(
    "name_slots",
    """
WITH s AS (SELECT i, round(avg(v), 6) AS score FROM (SELECT unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1)
SELECT CAST(i AS INTEGER) AS idx, CASE WHEN i = 0 THEN 'user' WHEN i = 1 THEN 'item' WHEN i < 42 THEN 'f' || CAST(i - 2 AS VARCHAR) ELSE 'slot_' || CAST(i AS VARCHAR) END AS name, score FROM s""",
)
def name_slots(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("idx", "v"))
    scores = emb.groupBy("idx").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("score"))
    names = spark.range(40).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("f"), "id").alias("name"))
    return joins.name_slots(scores, names, ["user", "item"])
