"""Factorisation machine fitted on packed blocks of rows.

The steps are those of Spark's FMClassifier with its adamW solver over all rows
(logistic loss, mean gradient, decoupled decay of weights), from its own first
coefficients, and the result is its model.  That learner keeps every row as an
object and visits them one by one; here rows are packed once into matrices of
about a megabyte, which stay in memory or on local disk, and a step multiplies
matrices.  No task holds more than its own partition, and one number for each
coefficient reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.vectors import to_array

#: bytes of rows in a block
BLOCK_BYTES = 1 << 20
#: rates of decay of the moments, and the least root of the second
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def packed(df: DataFrame, label: str, features: str) -> DataFrame:
    """One row for each block: its width, and label and features of its rows as the bytes of a matrix of doubles."""
    rows = to_array(df.select(F.col(label).cast("double").alias("_y"), F.col(features).alias("_x")), "_x")
    most = BLOCK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, width, step = [], 0, None, 1

        def out() -> pa.RecordBatch:
            columns = [pa.array([width], pa.int32()), pa.array([np.concatenate(held).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["width", "block"])

        for batch in batches:
            if width is None and batch.num_rows:
                width = len(batch.column(1)[0].as_py() or [])
                step = max(1, most // (8 * (width + 1)))
            for start in range(0, batch.num_rows, step):
                y, x = batch.slice(start, step).columns
                if y.null_count or x.null_count or not np.all(x.value_lengths().to_numpy() == width):
                    raise ValueError("a row without a label, without features or with another number of them")
                part = np.column_stack([y.to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
                if np.isnan(part).any() or not np.isin(part[:, 0], (0.0, 1.0)).all():
                    raise ValueError("labels must be 0 or 1 and features must be numbers")
                held.append(part)
                n += len(part)
                if n >= step:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return rows.mapInArrow(pack, "width int, block binary")


def block_gradient(data: np.ndarray, intercept: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Summed gradient of the logistic loss: factors by slot, linear part, intercept; then the number of rows."""
    y, x = data[:, 0], data[:, 1:]
    pulled, squares = x @ factors, x * x
    raw = intercept + x @ linear + 0.5 * ((pulled * pulled).sum(axis=1) - squares @ (factors * factors).sum(axis=1))
    off = 0.5 * (1.0 + np.tanh(0.5 * raw)) - y
    crossed = x.T @ (off[:, None] * pulled) - factors * (off @ squares)[:, None]
    return np.concatenate([crossed.ravel(), off @ x, [off.sum(), len(y)]])


def fit_blocks(df: DataFrame, learner: FMClassifier) -> FMClassificationModel:
    """The model of ``learner`` over all rows of ``df``."""
    blocks = packed(df, learner.getLabelCol(), learner.getFeaturesCol()).persist()
    try:
        return fit_packed(blocks, learner)
    finally:
        blocks.unpersist()


def fit_packed(blocks: DataFrame, learner: FMClassifier) -> FMClassificationModel:
    least, width = blocks.agg(F.min("width"), F.max("width")).first()
    if width is None or least != width:
        raise ValueError("no rows, or rows with different numbers of features")
    blank = blocks.sparkSession.createDataFrame([(0.0, Vectors.dense(np.zeros(width)))], [learner.getLabelCol(), learner.getFeaturesCol()])
    start = learner.copy({learner.maxIter: 0}).fit(blank)
    factors, linear, size = start.factors.toArray(), start.linear.toArray(), learner.getFactorSize()

    def mean_gradient(w: np.ndarray) -> np.ndarray:
        parts = w[: width * size].reshape(width, size), w[width * size : -1], w[-1]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for batch in batches:
                for block in batch.column(1):
                    total += block_gradient(np.frombuffer(block.as_buffer()).reshape(-1, width + 1), parts[2], parts[1], parts[0])
            slots = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([slots, pa.array(total)], ["slot", "g"])

        rows = blocks.mapInArrow(summed, "slot int, g double").groupBy("slot").agg(F.sum("g").alias("g")).collect()
        total = np.array([r["g"] for r in sorted(rows)])
        return total[:-1] / total[-1]

    w = np.concatenate([factors.ravel(), linear, [start.intercept]])
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for i in range(1, learner.getMaxIter() + 1):
        g = mean_gradient(w)
        first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g * g
        move = learner.getStepSize() * (first / (1 - BETA1**i)) / (np.sqrt(second / (1 - BETA2**i)) + EPSILON)
        before, w = w, w - move - learner.getRegParam() * w
        if i > 1 and np.linalg.norm(before - w) < learner.getTol() * max(np.linalg.norm(w), 1.0):
            break
    return model_of(start, w[: width * size].reshape(width, size), w[width * size : -1], float(w[-1]))


def model_of(start: FMClassificationModel, factors: np.ndarray, linear: np.ndarray, intercept: float) -> FMClassificationModel:
    """``start`` with other coefficients."""
    context = SparkContext.getOrCreate()
    matrix = DenseMatrix(*factors.shape, factors.ravel(order="F"))
    made = context._jvm.org.apache.spark.ml.classification.FMClassificationModel
    java = made(start.uid, intercept, _py2java(context, Vectors.dense(linear)), _py2java(context, matrix))
    return start._copyValues(FMClassificationModel(java))
