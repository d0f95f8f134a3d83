"""Kernel features and support vector regression (ML-20).

* ``KernelMap`` (Nyström): landmarks are at most ``nComponents`` distinct rows with
  the least seeded hash; a row becomes ``k(x, landmarks) K^(-1/2)``, so inner
  products of the new features approximate the kernel and equal it on the
  landmarks. The linear SVM and SVR on top are kernel machines whose cost grows
  with the rows, not with their square. Only the landmarks reach the driver.
* ``EpsilonRegression`` minimises ``|w|^2 / 2 + C sum max(0, |y - w x - b| -
  epsilon)``. The corner of the loss is rounded over a tenth of epsilon; each
  step sums loss and gradient inside the tasks over blocks of rows, one vector
  per task goes to the driver, which takes L-BFGS steps from the least squares
  solution. Features are centred and scaled inside, the penalty is not changed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.lbfgs import minimise
from tabloom.session import cut_lineage

KERNELS = ("linear", "poly", "rbf")
SLICE = 1024  # rows whose kernel with all landmarks is held at once


def kernel_matrix(x: np.ndarray, z: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "rbf":
        d = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * x @ z.T
        return np.exp(-gamma * np.maximum(d, 0.0))
    if kernel == "poly":
        return (gamma * x @ z.T + coef0) ** degree
    return x @ z.T


class _KernelParams(HasInputCol, HasOutputCol, HasSeed):
    kernel = Param(Params._dummy(), "kernel", "linear, poly or rbf", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", lambda v: v if isinstance(v, str) else float(v))
    degree = Param(Params._dummy(), "degree", "degree of poly", TypeConverters.toInt)
    coef0 = Param(Params._dummy(), "coef0", "constant of poly", TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "most landmarks", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="features", outputCol="kernel_features", kernel="rbf", gamma="scale", degree=3, coef0=0.0, nComponents=256, seed=42)


class KernelMap(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel_features", kernel="rbf", gamma="scale", degree=3, coef0=0.0, nComponents=256, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KernelMapModel":
        kernel = self.getOrDefault("kernel")
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}")
        rows = df.select(vector_to_array(self.getInputCol()).alias("x"))
        gamma = self.getOrDefault("gamma")
        if isinstance(gamma, str):
            width = F.max(F.size("x"))
            if gamma == "scale":
                v = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).head()[0] or 1.0
                gamma = 1.0 / ((rows.agg(width).head()[0] or 1) * v)
            elif gamma == "auto":
                gamma = 1.0 / (rows.agg(width).head()[0] or 1)
            else:
                raise ValueError("gamma must be 'scale', 'auto' or a number")
        order = F.xxhash64(F.lit(self.getOrDefault("seed")), "x")
        found = rows.distinct().orderBy(order, "x").limit(self.getOrDefault("nComponents")).collect()
        if not found:
            raise ValueError("no rows to fit")
        z = np.array([r.x for r in found])
        size, turn = np.linalg.eigh(kernel_matrix(z, z, kernel, gamma, self.getOrDefault("degree"), self.getOrDefault("coef0")))
        live = size > size.max() * len(z) * 1e-13
        whiten = turn[:, live] / np.sqrt(size[live])
        model = KernelMapModel()
        return self._copyValues(model._set(parts=json.dumps({"gamma": gamma, "landmarks": z.tolist(), "whiten": whiten.tolist()})))


class KernelMapModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    parts = Param(Params._dummy(), "parts", "landmarks and their root", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        p = json.loads(self.getOrDefault("parts"))
        z, whiten, gamma = np.array(p["landmarks"]), np.array(p["whiten"]), p["gamma"]
        kernel, degree, coef0 = (self.getOrDefault(c) for c in ("kernel", "degree", "coef0"))

        @F.pandas_udf("array<double>")
        def mapped(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_list())
            parts = [kernel_matrix(rows[i:i + SLICE], z, kernel, gamma, degree, coef0) @ whiten for i in range(0, len(rows), SLICE)]
            return pd.Series(list(np.concatenate(parts)))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class WeightedMachine(Estimator):
    """Kernel map and linear classifier, fitted on one weighted row per (features, label):
    the same loss, while the mapped table is as long as the distinct rows only."""

    def __init__(self, kernel_map, classifier):
        super().__init__()
        self.kernel_map, self.classifier = kernel_map, classifier

    def _fit(self, df: DataFrame) -> PipelineModel:
        features, label = self.kernel_map.getInputCol(), self.classifier.getLabelCol()
        mapped = self.kernel_map.fit(df)
        rows = cut_lineage(df.groupBy(vector_to_array(features).alias("x"), label).agg(F.count(F.lit(1)).cast("double").alias("__tb_w")))
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        rows = mapped.transform(rows.select(array_to_vector("x").alias(features), label, "__tb_w").repartition(tasks))
        return PipelineModel([mapped, self.classifier.copy({self.classifier.weightCol: "__tb_w"}).fit(rows)])


# -- support vector regression ----------------------------------------------------

class _RegressionParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter):
    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this cost nothing", TypeConverters.toFloat)
    tol = Param(Params._dummy(), "tol", "least relative gain of a step", TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(C=1.0, epsilon=0.1, tol=1e-6, maxIter=100)


def insensitive_loss(e: np.ndarray, epsilon: float, corner: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and slope by error, with a corner rounded over ``corner``."""
    over = np.maximum(np.abs(e) - epsilon, 0.0)
    soft = over < corner
    return np.where(soft, over * over / (2 * corner), over - corner / 2), np.sign(e) * np.where(soft, over / corner, 1.0)


def _row_blocks(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([v.tobytes()], pa.binary()) for v in (
                batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()))], names=["n", "x", "y"])


def _summed(blocks: DataFrame, of) -> np.ndarray:
    """Sum of ``of(x, y)`` (a vector) over all rows: one vector per task, added in task order."""
    def run(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column("n")[r].as_py()
                v = of(np.frombuffer(batch.column("x")[r].as_buffer()).reshape(n, -1), np.frombuffer(batch.column("y")[r].as_buffer()))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total], pa.list_(pa.float64()))], names=["at", "v"])
    return sum(np.array(r.v) for r in sorted(blocks.mapInArrow(run, "at long, v array<double>").collect()))


class EpsilonRegression(Estimator, _RegressionParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", C=1.0, epsilon=0.1, maxIter=100):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "EpsilonRegressionModel":
        c, epsilon = self.getOrDefault("C"), self.getOrDefault("epsilon")
        data = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).filter("y IS NOT NULL")
        blocks = cut_lineage(data.mapInArrow(_row_blocks, "n long, x binary, y binary"))
        if not blocks.head(1):
            raise ValueError("no rows to fit")
        sums = _summed(blocks, lambda x, y: np.r_[len(y), y.sum(), x.sum(axis=0)])
        n, mean_y, mean = sums[0], sums[1] / sums[0], sums[2:] / sums[0]
        squares = _summed(blocks, lambda x, y: np.r_[((y - mean_y) ** 2).sum(), ((x - mean) ** 2).sum(axis=0)])
        spread, unit = np.sqrt(squares[0] / n), np.sqrt(squares[1:] / n)
        unit[unit == 0] = 1.0
        width, penalty, corner = len(mean), 1.0 / (c * n) / unit ** 2, max(epsilon / 10, 1e-4 * spread, 1e-12)

        def normal(x, y):
            v = (x - mean) / unit
            return np.r_[(v.T @ v).ravel(), v.T @ (y - mean_y)]

        both = _summed(blocks, normal) / n
        gram = both[:width * width].reshape(width, width)
        start = np.linalg.solve(gram + np.diag(penalty + 1e-9), both[width * width:])

        def value(w):
            def part(x, y):
                v = (x - mean) / unit
                loss, slope = insensitive_loss(v @ w[:-1] + w[-1] - y, epsilon, corner)
                return np.r_[loss.sum(), v.T @ slope, slope.sum()]
            total = _summed(blocks, part) / n
            return total[0] + (penalty * w[:-1] ** 2).sum() / 2, total[1:] + np.r_[penalty * w[:-1], 0.0]

        w = minimise(value, np.r_[start, mean_y], self.getOrDefault("maxIter"), self.getOrDefault("tol"))
        weights = w[:-1] / unit
        model = EpsilonRegressionModel()
        return self._copyValues(model._set(weights=weights.tolist(), intercept=float(w[-1] - weights @ mean)))


class EpsilonRegressionModel(Model, _RegressionParams, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(v) for v in self.getOrDefault("weights")])
        terms = F.zip_with(vector_to_array(self.getFeaturesCol()), w, lambda a, b: a * b)
        return df.withColumn(self.getPredictionCol(), F.aggregate(terms, F.lit(self.getOrDefault("intercept")), lambda s, v: s + v))
