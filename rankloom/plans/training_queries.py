"""Training, scoring and evaluation on lineitem samples.

SQL cannot fit a learner; where it can, it states what must hold for the scores of every test row.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rankloom.functions.scalars import key_fraction
from rankloom.operators import training
from rankloom.operators.chunks import written_once
from rankloom.operators.ranking_metrics import auc, ndcg_at_k
from rankloom.operators.samples import split_train_test
from rankloom.plans.jobs import JobPaths, run_job
from rankloom.plans.registry import query, table
from rankloom.plans.sample_queries import LABEL, RAND, sample_table
from rankloom.session import scratch_path
from rankloom.sources.models import load_model, train_or_load
from rankloom.sources.writers import predict_and_store

GBT = {"model": "lgb", "maxDepth": 3, "iterations": 5, "learningRate": 0.1, "baggingFraction": 0.8, "lambda1": "-", "workers": 8}
LR = {"model": "lr", "iterations": 20, "regParam": 0.01, "workers": 8}
FM = {"model": "fm", "iterations": 10, "factorSize": 4, "learningRate": 0.01, "workers": 8}


def sides(spark, sf_dir):
    rows = sample_table(spark, sf_dir).select("l_orderkey", "l_linenumber", "user_id", "goods_id", "label", "rand", "features")
    return split_train_test(rows, fold=4, fraction=F.col("rand"))


#: of each class on the test side: all rows, and those for which a statement about the scores holds
CHECKED = f"SELECT {LABEL} AS label, count(*) AS n, count(*) AS holds FROM lineitem WHERE {RAND} < 0.25 GROUP BY 1"


def checked(rows, holds):
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(holds).alias("holds"))


def near(a, b):
    return F.abs(a - b) < 1e-9


#: samples whose label the features tell: one linear rule, one that needs two features at once
LINEAR, BOTH = "l_quantity > 25", "(l_quantity > 25) <> (l_discount > 0.05)"
AUC_FLOOR = 0.95


def scaled_sides(spark, sf_dir, rule):
    rows = table(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000, F.col("l_discount") * 10, F.col("l_tax") * 10)
    rows = rows.select(F.expr(rule).cast("double").alias("label"), array_to_vector(x).alias("features"), key_fraction(F.col("l_orderkey")).alias("rand"))
    return split_train_test(rows, fold=4, fraction=F.col("rand"))


def _learned_sql(rule):
    return f"""SELECT CAST({rule} AS INTEGER) AS label, count(*) AS n, count(*) AS holds, true AS learned
FROM lineitem WHERE {RAND} < 0.25 GROUP BY 1"""


def _fit_and_score(cfg, slope, rule):
    """Every test row has a probability that is the logistic function of its margin, and the exact AUC of the test
    side reaches the floor: a constant or untrained model does not."""

    def run(spark, sf_dir):
        train, test = scaled_sides(spark, sf_dir, rule)
        scored = written_once(training.score(training.train(train, cfg), test).select("label", "prob", "predict"), "scored")
        found = auc(scored, "prob", "label").first()[0]
        rows = checked(scored, near(F.col("prob"), 1 / (1 + F.exp(-slope * F.col("predict")))))
        return rows.withColumn("learned", F.lit(found > AUC_FLOOR))

    return run


query("train_gbt", _learned_sql(BOTH))(_fit_and_score(GBT, 2, BOTH))
query("train_lr", _learned_sql(LINEAR))(_fit_and_score(LR, 1, LINEAR))
query("train_fm", _learned_sql(LINEAR))(_fit_and_score({**FM, "iterations": 40, "learningRate": 0.1}, 1, LINEAR))


@query("train_lr_gradient", "SELECT CAST(unnest(range(5)) AS INTEGER) AS slot, 0.0 AS gradient")
def train_lr_gradient(spark, sf_dir):
    """At the fitted weights the gradient of loss and penalty vanishes in every slot and in the intercept (slot 4).

    Slots are measured in their standard deviations, as the penalty is; rounded to three places.
    """
    train, _ = scaled_sides(spark, sf_dir, "l_returnflag = 'R' or l_quantity > 40")
    model = training.train(train, {**LR, "iterations": 200, "tol": 1e-10})
    rows = training.score(model, train).select(vector_to_array("features").alias("x"), (F.col("prob") - F.col("label")).alias("e"))
    long = rows.select("e", F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("slot", "x"))
    found = long.groupBy("slot").agg(F.avg(F.col("e") * F.col("x")).alias("g"), F.stddev_samp("x").alias("sd"))
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients], F.lit(0.0))
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    whole = F.col("g") / scale + LR["regParam"] * F.get(weights, F.col("slot")) * F.col("sd")
    return found.select("slot", (F.round(whole, 3) + 0.0).alias("gradient"))


@query(
    "score_with_leaves",
    f"""SELECT CAST(t AS INTEGER) AS tree, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys
FROM lineitem, (SELECT unnest(range(5)) AS t) WHERE {RAND} < 0.25 GROUP BY 1""",
)
def score_with_leaves(spark, sf_dir):
    """Every test row has a leaf that exists in each of the trees."""
    train, test = sides(spark, sf_dir)
    model = training.train(train, GBT)
    scored = training.score(model, test, leaf_col="leaves")
    leaves = F.array(*[F.lit((t.numNodes + 1) // 2) for t in model.trees])
    rows = scored.select("l_orderkey", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    rows = rows.where((F.col("leaf") >= 0) & (F.col("leaf") < F.get(leaves, F.col("tree"))))
    return rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("positive_probability", CHECKED)
def positive_probability(spark, sf_dir):
    """The renamed and the split outputs fit each other on every row."""
    train, test = sides(spark, sf_dir)
    model = training.train(train, LR)
    keys = ["l_orderkey", "l_linenumber"]
    pick = lambda v, *c: training.score(model, test, variant=v).withColumn("_at", F.xxhash64(*keys, "user_id", "goods_id", "features")).select(*c)
    renamed = pick("rename", "_at", "label", F.col("rawPrediction").alias("both"), F.col("probability").alias("p")).dropDuplicates()
    split = pick("split", "_at", F.col("prediction").alias("margin"), F.col("probability").alias("q"))
    pair = split.join(renamed, "_at")
    same = near(F.col("p"), F.col("q")) & near(F.col("p"), 1 / (1 + F.exp(-F.col("margin")))) & near(vector_to_array("both")[1], F.col("p"))
    return checked(pair, same)


@query("train_pairwise_ranker")
def train_pairwise_ranker(spark, sf_dir):
    """Requests are orders, the grade is the quantity bucket; returns NDCG of the learned order per request."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.floor((F.col("l_quantity") - 1) / 13).cast("double").alias("label"),
        F.array("l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("features"),
        "l_linenumber",
    )
    cfg = {"model": "lgb_ranker", "group": "request_id", "maxPosition": 10, "iterations": 3}
    model = training.train(rows, cfg)
    return ndcg_at_k(model.transform(rows), "label", "prediction", 3, "request_id", ["l_linenumber"])


@query("grid_search")
def grid_search(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    results, _, _ = training.grid_search(train, test, {**LR, "regParam": "0.0,0.1"}, ["regParam"])
    return results


@query("feature_importance")
def feature_importance(spark, sf_dir):
    train, _ = sides(spark, sf_dir)
    model = training.train(train, GBT)
    both = [training.feature_importance(model, spark, k).withColumn("kind", F.lit(k)) for k in ("gain", "split")]
    return both[0].unionByName(both[1])


@query("feature_importance_totals", "SELECT * FROM (VALUES ('gain', 4, true, true), ('split', 4, true, true)) AS v(kind, slots, adds_up, told)")
def feature_importance_totals(spark, sf_dir):
    """Gains add up to 1 and splits to the inner nodes of all trees; the two slots that tell the label lead."""
    train, _ = scaled_sides(spark, sf_dir, BOTH)
    model = training.train(train, GBT)
    inner = sum((t.numNodes - 1) // 2 for t in model.trees)
    found = None
    for kind, total in (("gain", 1.0), ("split", float(inner))):
        rows = training.feature_importance(model, spark, kind)
        told = F.sum(F.when(F.col("idx").isin(0, 2), F.col("score"))) > 0.9 * F.sum("score")
        one = rows.agg(F.count(F.lit(1)).cast("int").alias("slots"), (F.abs(F.sum("score") - total) < 1e-9).alias("adds_up"), told.alias("told"))
        one = one.select(F.lit(kind).alias("kind"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("dump_trees", "SELECT 5 AS trees, 0 AS unnamed, true AS only_known, true AS whole FROM (SELECT count(*) FROM lineitem)")
def dump_trees(spark, sf_dir):
    """The text holds all trees and nodes, and names instead of slot numbers."""
    train, _ = scaled_sides(spark, sf_dir, BOTH)
    model = training.train(train, GBT)
    names = dict(enumerate(["quantity", "price", "discount", "tax"]))
    lines = spark.createDataFrame([(line,) for line in training.dump_trees(model, names).splitlines()], "line string")
    tested = F.regexp_extract("line", r"^\s*If \((\S+) ", 1)
    nodes = F.count_if(F.col("line").rlike(r"^\s*(If|Predict)"))
    return lines.agg(
        F.count_if(F.col("line").rlike(r"^\s*Tree \d+")).cast("int").alias("trees"),
        F.count_if(F.col("line").contains("feature ")).cast("int").alias("unnamed"),
        (F.count_if((tested != "") & ~tested.isin(list(names.values()))) == 0).alias("only_known"),
        (nodes == sum(t.numNodes for t in model.trees)).alias("whole"),
    )


@query("predict_and_store", f"{CHECKED.replace('count(*) AS holds', 'count(*) AS holds, true AS once')}")
def predict_and_store_query(spark, sf_dir):
    """Scores are stored without the features, and a second call reads them and does not score again."""
    train, test = sides(spark, sf_dir)
    model = training.train(train, LR)
    path = scratch_path(spark, "stored")
    first = predict_and_store(lambda d: training.score(model, d), test, path)

    def never(_):
        raise AssertionError("scored twice")

    again = predict_and_store(never, test, path)
    once = "features" not in first.columns and again.columns == first.columns
    return checked(again, near(F.col("prob"), 1 / (1 + F.exp(-F.col("predict"))))).withColumn("once", F.lit(once))


@query("save_and_load_model", CHECKED)
def save_and_load_model(spark, sf_dir):
    """The trained model and the one that was stored and loaded again agree on every row."""
    train, test = sides(spark, sf_dir)
    path = scratch_path(spark, "model")
    first = train_or_load(spark, "lr", path, lambda: training.train(train, LR))
    scored = training.score(first, test).select("label", "features", F.col("prob").alias("trained"))
    both = training.score(load_model("lr", path), scored)
    return checked(both, F.col("prob") == F.col("trained"))


@query("run_job")
def run_job_query(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    root = scratch_path(spark, "job")
    train.write.parquet(f"{root}/train")
    test.write.parquet(f"{root}/test")
    paths = JobPaths(root, "train", "test", f"{root}/model", root)
    return run_job(spark, {**LR, "groupCols": "user_id,goods_id", "categoricalSlotNames": "goods_id"}, paths, add_category=True)
