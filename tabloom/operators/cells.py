"""Trees on cells: training rows with equal bins count as one weighted row (ML-5, FSC-1, FSL-1/3/4).

A histogram tree sees a row only by the bins of its features. From ``CELL_ROWS``
training rows on, features are cut into at most ``MAX_BINS`` bins (Spark's own
default), rows are summed by cell (the bins of all features) in one shuffle, and
the trees are grown on the cells:

* decision trees and boosted trees are Spark's, on (bins, weight, mean label) or,
  for classes, (bins, class, weight). Gains are differences of sums of squares, so
  the spread of labels inside a cell cancels and the trees are those of the rows.
  ``minInstancesPerNode`` becomes the same share of the weight.
* forests draw a Poisson(1) count per row and tree, as Spark's do. Classes: the sum
  of a cell's draws is Poisson(its count). Numbers: one pass over the rows adds draws
  and drawn labels by cell and tree. Every tree then grows in a task of its own.

With p features there are at most ``min(rows, MAX_BINS ** p)`` cells, whatever the data
are; when they times the trees exceed ``CELL_SUMS``, a forest is Spark's on all rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import qcol
from tabloom.operators.boosting import leaves
from tabloom.session import cut_lineage

CELL_ROWS = 200_000       # training rows from which trees are fitted on cells
MAX_BINS = 32
CELL_SUMS = 1 << 23       # most (cell, tree) sums of a task, 16 bytes each
ROWS_PER_TASK = 1_000_000
CELLS_PER_TASK = 20_000
TABLE_CELLS = 1 << 15     # up to this many possible cells predictions are looked up
_PARAMS = {"n_estimators", "max_depth", "learning_rate", "min_samples_leaf", "max_features", "max_iter", "random_state",
           "min_info_gain"}


def suits(model_type: str, params, n_rows: int | None, n_features: int) -> bool:
    """Trees without row samples of their own, on a table that is large enough."""
    if isinstance(params, str):
        params = json.loads(params) if params.strip() else {}
    return (n_rows or 0) >= CELL_ROWS and n_features <= 12 and set(params or {}) <= _PARAMS and \
        model_type.startswith(("decision_tree_", "random_forest_", "gradient_boosting_"))


def bin_columns(n: int) -> list[str]:
    return [f"__tb_bin{i}" for i in range(n)]


def cut_points(df: DataFrame, columns, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Cuts of every column: between all values when they are few, else at quantiles."""
    rows = df.select(*[qcol(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).na.drop()
    probs = [i / max_bins for i in range(1, max_bins)]
    found = rows.agg(*[F.percentile_approx(f"v{i}", probs, 10_000).alias(f"q{i}") for i in range(len(columns))],
                     *[F.approx_count_distinct(f"v{i}").alias(f"d{i}") for i in range(len(columns))]).head()
    cuts = []
    for i in range(len(columns)):
        values = []
        if found[f"d{i}"] <= 2 * max_bins:
            values = sorted(r[0] for r in rows.select(f"v{i}").distinct().limit(max_bins + 1).collect())
        if 1 < len(values) <= max_bins:
            at = [a + (b - a) / 2 if math.isfinite(b - a) else b for a, b in zip(values, values[1:])]
        else:
            at = found[f"q{i}"] or [0.0]
        cuts.append(sorted({v for v in at if math.isfinite(v)}) or [0.0])
    return cuts


class Bins(Estimator):
    """Columns to bin numbers; the model is a ``Bucketizer``."""

    def __init__(self, columns, max_bins: int = MAX_BINS):
        super().__init__()
        self.columns, self.max_bins = list(columns), max_bins

    def _fit(self, df: DataFrame) -> Bucketizer:
        splits = [[-math.inf, *c, math.inf] for c in cut_points(df, self.columns, self.max_bins)]
        return Bucketizer(splitsArray=splits, inputCols=self.columns, outputCols=bin_columns(len(self.columns)),
                          handleInvalid="skip")


def weighted(df: DataFrame, columns, label: str, task: str, groups=()) -> DataFrame:
    """One row per cell (and class): its columns, the label (mean label) and ``__tb_w`` rows.
    A cell with a missing label has no label, so fits refuse it as they refuse the row."""
    keys, y = [*groups, *columns], qcol(label)
    n = F.count(F.lit(1))
    if task == "classification":
        return df.groupBy(*keys, label).agg(n.cast("double").alias("__tb_w"))
    return df.groupBy(*keys).agg(n.cast("double").alias("__tb_w"), F.when(F.count(y) == n, F.avg(y)).alias(label),
                                  (F.var_pop(y) * n).alias("__tb_m2"))


def weighted_score(pred: DataFrame, task: str, target: str, metric: str) -> float:
    """``score_of`` on cells: errors about the cell's mean plus the spread of its labels."""
    from tabloom.operators.ml import classification_metrics
    w = F.col("__tb_w")
    if task == "classification":
        return classification_metrics(pred, "label", "prediction", "__tb_w").first()[metric]
    y, p = qcol(target), F.col("prediction")
    mean = pred.agg(F.sum(w * y) / F.sum(w)).first()[0]
    r = pred.agg(F.sum(w).alias("n"), F.sum(F.col("__tb_m2") + w * (y - p) ** 2).alias("sse"),
                 F.sum(F.col("__tb_m2") + w * (y - F.lit(mean)) ** 2).alias("sst")).first()
    if metric == "r2":
        return 1 - r.sse / r.sst if r.sst else 0.0
    return -r.sse / r.n if metric == "mse" else -math.sqrt(r.sse / r.n)


def few_tasks(rows: DataFrame, n: int) -> DataFrame:
    return rows.coalesce(-(-max(n, 1) // CELLS_PER_TASK))


def assembled(rows: DataFrame, columns, features: str) -> DataFrame:
    """Bins as numbers: a ``Bucketizer`` marks them as categories, whose order trees ignore."""
    plain = rows.drop(features).withColumns({c: F.col(c) + F.lit(0.0) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=features).transform(plain)


def fit_weighted(est, rows: DataFrame, total: float):
    """Fit a tree estimator on weighted rows; least instances become a share of the weight."""
    tree = est.getClassifier() if est.hasParam("classifier") else est
    least = tree.getMinInstancesPerNode()
    if least > 1:
        tree = tree.copy({tree.minInstancesPerNode: 1, tree.minWeightFractionPerNode: min((least - 0.5) / total, 0.499)})
    if est.hasParam("classifier"):
        return est.copy({est.classifier: tree, est.weightCol: "__tb_w"}).fit(rows)
    return tree.copy({tree.weightCol: "__tb_w"}).fit(rows)


class OnCells(Estimator):
    """Fits ``estimator`` (its features are the bins ``columns``) on one weighted row per cell."""

    def __init__(self, estimator, columns, task: str):
        super().__init__()
        self.estimator, self.columns, self.task = estimator, list(columns), task

    def _fit(self, df: DataFrame):
        est = self.estimator
        rows = cut_lineage(weighted(df, self.columns, est.getLabelCol(), self.task))
        n, total = rows.agg(F.count(F.lit(1)), F.sum("__tb_w")).head()
        rows = few_tasks(rows, n)
        return fit_weighted(est, assembled(rows, self.columns, est.getFeaturesCol()), total or 1.0)


# -- forests -----------------------------------------------------------------------

def subset_size(strategy: str, n: int, task: str, trees: int) -> int:
    """Features tried per node, as Spark reads ``featureSubsetStrategy``."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else ("onethird" if task == "regression" else "sqrt")
    named = {"all": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    v = float(strategy)
    return min(n, int(v)) if v.is_integer() and "." not in strategy else max(1, math.ceil(v * n))


def grow(bins: np.ndarray, stats: np.ndarray, weight: np.ndarray, depth: int, tried: int, least: float, least_gain: float, rng) -> dict:
    """One tree on cells: ``stats`` are (cells, 1) label sums or (cells, classes) counts."""
    width, n_bins = bins.shape[1], int(bins.max()) + 1 if len(bins) else 1
    feature, cut, left, right, gains = [-1], [0], [0], [0], [0.0]
    node, active = np.zeros(len(bins), np.int64), [0]
    for _ in range(depth):
        if not active or n_bins < 2:
            break
        place = np.full(len(feature), -1)
        place[active] = np.arange(len(active))
        live = np.flatnonzero((place[node] >= 0) & (weight > 0))
        at, size = place[node[live]], len(active) * n_bins
        allowed = np.argsort(rng.random((len(active), width)), axis=1)[:, :tried]
        best, where, which = np.zeros(len(active)), np.zeros(len(active), int), np.full(len(active), -1)
        for f in range(width):
            key = at * n_bins + bins[live, f]
            w = np.bincount(key, weight[live], size).reshape(-1, n_bins)
            s = np.stack([np.bincount(key, stats[live, k], size).reshape(-1, n_bins) for k in range(stats.shape[1])])
            wl, sl = w.cumsum(axis=1)[:, :-1], s.cumsum(axis=2)[:, :, :-1]
            all_w, all_s = w.sum(axis=1, keepdims=True), s.sum(axis=2, keepdims=True)
            wr, sr = all_w - wl, all_s - sl
            ok = (wl >= max(least, 0.5)) & (wr >= max(least, 0.5))
            whole = (all_s ** 2).sum(axis=0) / np.maximum(all_w, 1e-300)
            gain = (sl ** 2).sum(axis=0) / np.where(ok, wl, 1.0) + (sr ** 2).sum(axis=0) / np.where(ok, wr, 1.0) - whole
            gain = np.where(ok & (gain > whole * 1e-12) & (gain >= least_gain * all_w), gain, 0.0)
            gain[~(allowed == f).any(axis=1)] = 0.0
            top = gain.argmax(axis=1)
            value = gain[np.arange(len(top)), top]
            better = value > best
            best[better], where[better], which[better] = value[better], top[better], f
        nodes, active = active, []
        for i, v in enumerate(nodes):
            if which[i] < 0:
                continue
            feature[v], cut[v], gains[v], left[v], right[v] = int(which[i]), int(where[i]), float(best[i]), len(feature), len(feature) + 1
            active += [len(feature), len(feature) + 1]
            for values, new in ((feature, -1), (cut, 0), (left, 0), (right, 0), (gains, 0.0)):
                values += [new, new]
        f = np.array(feature)[node]
        down = np.where(bins[np.arange(len(bins)), np.maximum(f, 0)] <= np.array(cut)[node], np.array(left)[node], np.array(right)[node])
        node = np.where(f >= 0, down, node)
    total = np.stack([np.bincount(node, stats[:, k], len(feature)) for k in range(stats.shape[1])], axis=1)
    w = np.bincount(node, weight, len(feature))
    for v in reversed(range(len(feature))):  # children come after their parents
        if feature[v] >= 0:
            total[v], w[v] = total[left[v]] + total[right[v]], w[left[v]] + w[right[v]]
    value = total / np.maximum(w, 1e-300)[:, None]
    said = value.argmax(axis=1) if stats.shape[1] > 1 else value[:, 0]
    for v in reversed(range(len(feature))):  # leaves that say the same are one leaf, as in Spark
        if feature[v] >= 0 and feature[left[v]] < 0 and feature[right[v]] < 0 and said[left[v]] == said[right[v]]:
            feature[v], gains[v] = -1, 0.0
    return {"feature": feature, "bin": cut, "left": left, "right": right, "gain": gains, "value": value.tolist()}


def _drawn(codes: np.ndarray, trees: int, seed: int):
    """Sums of Poisson(1) draws, and of drawn labels, by tree and cell of a task's rows."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed & 0xFFFFFFFF, part])
        sums = np.zeros((2, len(codes), trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.searchsorted(codes, batch.column(0).to_numpy())
            order = np.argsort(at, kind="stable")
            at, y = at[order], batch.column(1).to_numpy(zero_copy_only=False)[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            k = rng.poisson(1.0, (len(at), trees)).astype(float)
            sums[0, at[first]] += np.add.reduceat(k, first)
            k *= y[:, None]
            sums[1, at[first]] += np.add.reduceat(k, first)
        for t in range(trees):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([t]), pa.array([sums[:, :, t].tobytes()], pa.binary())],
                                             names=["part", "tree", "sums"])
    return run


def _unpacked(codes: np.ndarray, width: int) -> np.ndarray:
    return np.stack([codes // MAX_BINS ** j % MAX_BINS for j in range(width)], axis=1)


class CellForest(Estimator):
    """A random forest on cells; ``plain`` is Spark's, whose parameters hold."""

    def __init__(self, plain, columns, task: str):
        super().__init__()
        self.plain, self.columns, self.task = plain, list(columns), task

    def _fit(self, df: DataFrame):
        est, width, label = self.plain, len(self.columns), self.plain.getLabelCol()
        trees, seed = est.getNumTrees(), est.getSeed()
        code = sum((F.col(c).cast("long") * MAX_BINS ** j for j, c in enumerate(self.columns)), F.lit(0).cast("long"))
        data = df.select(code.alias("code"), qcol(label).cast("double").alias("y"))
        of = ["code", "y"] if self.task == "classification" else ["code"]
        counted = cut_lineage(data.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("bad")))
        n, bad = counted.agg(F.count(F.lit(1)), F.sum("bad")).head()
        if not n or bad or n * trees > CELL_SUMS:
            return est.fit(assembled(df, self.columns, est.getFeaturesCol()))
        found = counted.toPandas()  # at most CELL_SUMS / trees rows
        codes = np.unique(found["code"].to_numpy())
        bins = _unpacked(codes, width)
        options = (est.getMaxDepth(), subset_size(est.getFeatureSubsetStrategy(), width, self.task, trees),
                   est.getMinInstancesPerNode(), est.getMinInfoGain())
        spark = df.sparkSession
        if self.task == "classification":
            counts = np.zeros((len(codes), int(found["y"].max()) + 1))
            counts[np.searchsorted(codes, found["code"]), found["y"].astype(int)] = found["n"]

            def grown(batches):
                for batch in batches:
                    for t in batch.column(0).to_pylist():
                        rng = np.random.default_rng([seed & 0xFFFFFFFF, t])
                        drawn = rng.poisson(counts).astype(float) if trees > 1 else counts
                        tree = grow(bins, drawn, drawn.sum(axis=1), *options, rng)
                        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([json.dumps(tree)])], names=["tree", "nodes"])

            made = spark.range(0, trees, 1, trees).mapInArrow(grown, "tree long, nodes string")
        else:
            def summed(group: pa.Table) -> pa.Table:
                t, (w, s) = group.column("tree")[0].as_py(), _added(group)
                tree = grow(bins, s[:, None], w, *options, np.random.default_rng([seed & 0xFFFFFFFF, t, 1]))
                return pa.table({"tree": pa.array([t]), "nodes": pa.array([json.dumps(tree)])})

            made = _draws(data, codes, trees, seed, int(found["n"].sum())).groupBy("tree").applyInArrow(summed, "tree long, nodes string")
        return _model(est, self.task, width, made)


def _added(group: pa.Table) -> np.ndarray:
    """A tree's sums over the tasks, in the order of the tasks."""
    parts = sorted(zip(group.column("part").to_pylist(), range(group.num_rows)))
    return sum(np.frombuffer(group.column("sums")[i].as_py()).reshape(2, -1) for _, i in parts)


def _draws(data: DataFrame, codes: np.ndarray, trees: int, seed: int, n_rows: int, cuts=None) -> DataFrame:
    """Draws of rows (code, y), or with ``cuts`` of rows (every feature, y)."""
    tasks = max(data.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_TASK))
    drawn = _drawn(codes, trees, seed)

    def run(batches):
        return drawn(batches if cuts is None else _coded(batches, cuts))
    return data.coalesce(tasks).mapInArrow(run, "part long, tree long, sums binary")


def _coded(batches, cuts):
    """Rows (every feature, y) as (code, y); a missing value counts as a missing label."""
    for batch in batches:
        *x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        code, gone = np.zeros(len(y), np.int64), np.isnan(y)
        for j, (v, at) in enumerate(zip(x, cuts)):
            code += np.searchsorted(at, v, side="right") * MAX_BINS ** j
            gone = gone | np.isnan(v)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.where(gone, np.nan, y))], names=["code", "y"])


def _counted(cuts):
    """(code, rows, rows with a missing value) of runs of about ``ROWS_PER_TASK`` rows."""
    def run(batches):
        held, size = [], 0

        def sums():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            bad = np.bincount(at, np.concatenate([b for _, b in held]), len(codes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.bincount(at, minlength=len(codes))), pa.array(bad)],
                                              names=["code", "n", "bad"])
        for batch in _coded(batches, cuts):
            held.append((batch.column(0).to_numpy(), np.isnan(batch.column(1).to_numpy())))
            size += batch.num_rows
            if size >= ROWS_PER_TASK:
                yield sums()
                held, size = [], 0
        if size:
            yield sums()
    return run


def _model(est, task: str, width: int, made: DataFrame) -> CellForestModel:
    forest = [json.loads(r.nodes) for r in sorted(made.collect())]
    return CellForestModel()._set(featuresCol=est.getFeaturesCol(), predictionCol=est.getPredictionCol(),
                                  forest=json.dumps({"task": task, "width": width, "forest": forest}))


class SharedForests:
    """Regression forests of the same rows on any of their features (an elimination): cuts,
    draws by tree and cell, and the test rows' cells are made once, for all features. A forest on
    some of them adds up the cells that differ in the others only, with the same draws of rows.
    ``usable`` is False for tables that a ``CellForest`` would not take, and for missing
    values, where other features would keep other rows."""

    def __init__(self, est, train: DataFrame, columns, n_train: int, test: DataFrame | None = None, n_test: int = 0):
        self.est, self.columns, self.usable = est, list(columns), False
        label, trees, bins = est.getLabelCol(), est.getNumTrees(), bin_columns(len(self.columns))
        model = Bins(self.columns).fit(train)
        cuts = [np.array(c[1:-1]) for c in model.getSplitsArray()]
        rows = train.select(*[qcol(c).cast("double").alias(f"x{j}") for j, c in enumerate(self.columns)], qcol(label).cast("double").alias("y"))
        counted = cut_lineage(rows.mapInArrow(_counted(cuts), "code long, n long, bad long")
                              .groupBy("code").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
        cells, n, bad = counted.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bad")).head()
        if not cells or bad or n != n_train or cells * trees > CELL_SUMS:
            return
        if test is not None:
            self.test = cut_lineage(weighted(model.transform(test), bins, label, "regression"))
            known = F.sum(F.when(qcol(label).isNotNull() & ~F.isnan(label), F.col("__tb_w")))
            cells, n = self.test.agg(F.count(F.lit(1)), known).head()
            if n != n_test:
                return
            self.test = few_tasks(self.test, cells)
        self.codes = np.sort(counted.select("code").toPandas()["code"].to_numpy())  # at most CELL_SUMS / trees
        draws = _draws(rows, self.codes, trees, est.getSeed(), n_train, cuts)
        added = draws.groupBy("tree").applyInArrow(
            lambda g: pa.table({"tree": pa.array([g.column("tree")[0].as_py()]), "sums": pa.array([_added(g).tobytes()], pa.binary())}),
            "tree long, sums binary")
        self.sums = cut_lineage(added.repartition(trees))
        self.usable = True

    def fit(self, left) -> CellForestModel:
        at, est, width = [self.columns.index(c) for c in left], self.est, len(left)
        own = sum(self.codes // MAX_BINS ** j % MAX_BINS * MAX_BINS ** i for i, j in enumerate(at))
        codes, cell = np.unique(own, return_inverse=True)
        bins, seed = _unpacked(codes, width), est.getSeed()
        options = (est.getMaxDepth(), subset_size(est.getFeatureSubsetStrategy(), width, "regression", est.getNumTrees()),
                   est.getMinInstancesPerNode(), est.getMinInfoGain())

        def grown(batches):
            for batch in batches:
                for t, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w, s = (np.bincount(cell, v, len(codes)) for v in np.frombuffer(sums).reshape(2, -1))
                    tree = grow(bins, s[:, None], w, *options, np.random.default_rng([seed & 0xFFFFFFFF, t, 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([json.dumps(tree)])], names=["tree", "nodes"])

        return _model(est, "regression", width, self.sums.mapInArrow(grown, "tree long, nodes string"))

    def score(self, model: CellForestModel, left, metric: str) -> float:
        """``metric`` of a model on the test rows, from their cells."""
        inputs = [bin_columns(len(self.columns))[self.columns.index(c)] for c in left]
        pred = model.transform(assembled(self.test, inputs, self.est.getFeaturesCol()))
        return weighted_score(pred, "regression", self.est.getLabelCol(), metric)


class CellTree:
    """A tree of the forest, with its importances."""

    def __init__(self, nodes: dict, width: int):
        gain = np.zeros(width)
        for f, v in zip(nodes["feature"], nodes["gain"]):
            if f >= 0:
                gain[f] += v
        self.nodes = nodes
        self.featureImportances = Vectors.dense(gain / gain.sum() if gain.sum() else gain)


class CellForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the trees, or for classes ``rawPrediction``, ``probability`` and the likeliest."""

    forest = Param(Params._dummy(), "forest", "the trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def parts(self) -> dict:
        return json.loads(self.getOrDefault("forest"))

    @property
    def trees(self) -> list[CellTree]:
        p = self.parts()
        return [CellTree(t, p["width"]) for t in p["forest"]]

    @property
    def featureImportances(self):
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.parts()
        forest = [(tuple(np.array(t[c]) for c in ("feature", "bin", "left", "right")), np.array(t["value"])) for t in p["forest"]]
        width = p["width"]

        def mean(bins):
            total = 0.0
            for tree, value in forest:
                total = total + value[leaves(tree, bins)]
            return total / len(forest)

        space = MAX_BINS ** width
        table = mean(_unpacked(np.arange(space), width)) if space <= TABLE_CELLS else None
        if table is not None:
            forest = []  # the tasks look cells up
        number = p["task"] == "regression"

        @F.pandas_udf("double" if number else "array<double>")
        def predicted(code):
            import pandas as pd
            code = code.to_numpy()
            out = table[code] if table is not None else mean(_unpacked(code, width)) if len(code) else np.zeros((0, 1))
            return pd.Series(out[:, 0] if number else list(out))

        x = vector_to_array(self.getFeaturesCol())
        code = sum((F.get(x, F.lit(j)).cast("long") * MAX_BINS ** j for j in range(width)), F.lit(0).cast("long"))
        if number:
            return df.withColumn(self.getPredictionCol(), predicted(code))
        out = df.withColumn("__tb_share", predicted(code))
        share, n = F.col("__tb_share"), float(len(p["forest"]))
        out = out.withColumn("rawPrediction", array_to_vector(F.transform(share, lambda v: v * n))) \
            .withColumn("probability", array_to_vector(share))
        return out.withColumn(self.getPredictionCol(), (F.array_position(share, F.array_max(share)) - 1).cast("double")).drop("__tb_share")
