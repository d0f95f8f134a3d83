"""Second-order gradient boosting of trees (ML-5).

The objective is expanded to second order: every row gives a gradient ``g`` and
a Hessian ``h``, a leaf weighs ``-G / (H + lambda)``, and a split gains
``GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)`` (with ``alpha``, sums
are first moved towards 0 by it). Children need ``min_child_weight`` of Hessian;
splits of two leaves that gain less than ``gamma`` are taken back, from the
bottom. Rows are sampled per round, columns per tree.

On Spark: features are cut into at most ``max_bins`` bins at quantiles, once,
and rows are kept as blocks of bin numbers in a checkpoint. One job per tree
level sums ``(G, H)`` by (node, feature, bin) inside the tasks and then over the
tasks; all trees of a round (one per class) grow in the same jobs. While the
tasks' sums are small together (``DRIVER_BYTES``) the driver adds them up,
otherwise they are added per (node, feature) in a shuffle, and only best splits
come back. Margins are written every ``KEEP_ROUNDS`` rounds; in between tasks
add the few trees since. Samples come from generators seeded by round and block,
so a repeated task draws the same rows. Large tables without row samples are first
summed by cell (the bins of all features, and the class): rows of a cell have equal
margins, so a weighted row with the cell's mean label gives the same sums.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

DRIVER_BYTES = 32 << 20
KEEP_ROUNDS = 10
ROWS_PER_TASK = 100_000
CELL_ROWS = 200_000  # rows from which cells are summed
LEAST_GAIN = 1e-6


# -- trees ------------------------------------------------------------------------

class Tree:
    """Nodes in the order of their making; ``feature`` -1 marks a leaf."""

    def __init__(self, g: float = 0.0, h: float = 0.0):
        self.feature, self.bin, self.left, self.right, self.gain = [-1], [0], [0], [0], [0.0]
        self.g, self.h = [g], [h]
        self.weight: list[float] = []

    def split(self, node: int, feature: int, at: int, gain: float, gl: float, hl: float) -> list[int]:
        children = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = children
        for g, h in ((gl, hl), (self.g[node] - gl, self.h[node] - hl)):
            for values, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.g, g), (self.h, h)):
                values.append(v)
        return children

    def finish(self, step: float, lam: float, alpha: float, gamma: float) -> None:
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and self.gain[node] < gamma and all(
                    self.feature[c] < 0 for c in (self.left[node], self.right[node])):
                self.feature[node] = -1
        self.weight = [float(-step * shrunk(g, alpha) / (h + lam)) if h + lam > 0 else 0.0 for g, h in zip(self.g, self.h)]

    def arrays(self) -> tuple:
        return tuple(np.array(v) for v in (self.feature, self.bin, self.left, self.right))


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaves(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """Node that each row ends in."""
    feature, at, left, right = tree
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        down = np.where(bins[rows, np.maximum(f, 0)] <= at[node], left[node], right[node])
        node = np.where(inner, down, node)


def gradients(objective: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, (rows, trees)."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def best_split(g: np.ndarray, h: np.ndarray, lam: float, alpha: float, least: float) -> tuple:
    """(gain, bin, GL, HL) of the best cut of one histogram; gain 0 if there is none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gr, hr = total_g - gl, total_h - hl

    def value(a, b):
        return shrunk(a, alpha) ** 2 / np.where(b + lam > 0, b + lam, np.inf)

    gain = value(gl, hl) + value(gr, hr) - value(total_g, total_h)
    gain = np.where((hl >= least) & (hr >= least) & (hl > 0) & (hr > 0), gain, 0.0)
    if not len(gain):
        return 0.0, 0, 0.0, 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k, float(gl[k]), float(hl[k])


def sampled(rate: float, seed: int, turn: int, block: int, n: int) -> np.ndarray:
    return np.ones(n, bool) if rate >= 1 else np.random.default_rng([seed, turn, block & 0xFFFFFFFF, block >> 32]).random(n) < rate


# -- blocks -------------------------------------------------------------------------

def _binned(column, n: int, cuts: list[np.ndarray]) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1).astype(np.uint16)


def _cut(cuts: list[np.ndarray], margin0: np.ndarray, of=None):
    """Blocks of rows (bins, label, margin, weight); ``of`` reads a batch, by default (x, y)."""
    def rows(batch):
        y = batch.column(1).to_numpy().astype("<f8")
        return _binned(batch.column(0), batch.num_rows, cuts), y, np.ones(len(y))

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, weight = (of or rows)(batch)
            margin = np.tile(margin0, (len(y), 1))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([v.tobytes()], pa.binary()) for v in (bins, y, margin, weight))],
                                             names=["block", "bins", "y", "margin", "weight"])
            block += 1
    return run


_BLOCKS = "block long, bins binary, y binary, margin binary, weight binary"


def _codes(bins: np.ndarray, sizes: list[int]) -> np.ndarray:
    code = np.zeros(len(bins), np.int64)
    for j, size in enumerate(sizes):
        code = code * size + bins[:, j]
    return code


def _cells(cuts: list[np.ndarray], classes: int):
    """(code of bins and class, rows, sum of labels) of every batch."""
    sizes = [len(c) + 1 for c in cuts]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy().astype("<f8")
            code = _codes(_binned(batch.column(0), len(y), cuts), sizes)
            code, at = np.unique(code * classes + y.astype(np.int64) if classes > 1 else code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(at).astype(float)), pa.array(np.bincount(at, y))], names=["code", "n", "s"])
    return run


def _of_cells(cuts: list[np.ndarray], classes: int):
    def rows(batch):
        code, n, s = (batch.column(i).to_numpy() for i in range(3))
        y, code = (code % classes).astype("<f8") if classes > 1 else s / n, code // classes
        bins = np.empty((len(code), len(cuts)), np.uint16)
        for j in reversed(range(len(cuts))):
            bins[:, j], code = code % (len(cuts[j]) + 1), code // (len(cuts[j]) + 1)
        return bins, y, n.astype("<f8")
    return rows


def _read(batch, r: int, width: int, trees: int, pending: list):
    """Bins, labels and margins of a block, with the trees since they were written."""
    bins = np.frombuffer(batch.column("bins")[r].as_buffer(), np.uint16).reshape(-1, width)
    y = np.frombuffer(batch.column("y")[r].as_buffer(), "<f8")
    margin = np.frombuffer(batch.column("margin")[r].as_buffer(), "<f8").reshape(-1, trees).copy()
    for group in pending:
        for k, (tree, weight) in enumerate(group):
            margin[:, k] += weight[leaves(tree, bins)]
    return bins, y, margin, np.frombuffer(batch.column("weight")[r].as_buffer(), "<f8")


def _write_margins(width: int, trees: int, pending: list):
    def run(batches):
        for batch in batches:
            margins = [_read(batch, r, width, trees, pending)[2].tobytes() for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("block", "bins", "y")] + [pa.array(margins, pa.binary()), batch.column("weight")],
                                             names=["block", "bins", "y", "margin", "weight"])
    return run


def _histograms(width: int, n_trees: int, pending: list, grown: list, active: list, columns: list, n_bins: int, objective: str, rate: float, seed: int, turn: int):
    """Sums of g and h by (active node, feature, bin) of a task's blocks."""
    def run(batches):
        from pyspark import TaskContext
        total = [np.zeros((2, len(nodes), len(cols), n_bins)) for nodes, cols in zip(active, columns)]
        for batch in batches:
            for r in range(batch.num_rows):
                bins, y, margin, weight = _read(batch, r, width, n_trees, pending)
                g, h = (v * weight[:, None] for v in gradients(objective, y, margin))
                use = sampled(rate, seed, turn, batch.column("block")[r].as_py(), len(y))
                for k, (tree, nodes, cols) in enumerate(zip(grown, active, columns)):
                    if not len(nodes):
                        continue
                    place = np.full(len(tree[0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = np.where(use, place[leaves(tree, bins)], -1)
                    rows = np.flatnonzero(at >= 0)
                    for j, f in enumerate(cols):
                        key = at[rows] * n_bins + bins[rows, f]
                        for s, v in enumerate((g, h)):
                            total[k][s, :, j] += np.bincount(key, v[rows, k], len(nodes) * n_bins).reshape(len(nodes), n_bins)
        part = TaskContext.get().partitionId()
        for k, t in enumerate(total):
            for i in range(t.shape[1]):
                for j in range(t.shape[2]):
                    if t[1, i, j].any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([int(active[k][i])], pa.int32()),
                             pa.array([int(columns[k][j])], pa.int32()), pa.array([t[:, i, j].tobytes()], pa.binary())],
                            names=["part", "tree", "node", "feature", "sums"])
    return run


def _split_of(rows: list, n_bins: int, lam: float, alpha: float, least: float) -> tuple:
    """Best split of one (node, feature) from the tasks' sums, in task order."""
    total = sum(np.frombuffer(s, "<f8").reshape(2, n_bins) for _, s in sorted(rows))
    return (*best_split(total[0], total[1], lam, alpha, least), float(total[0].sum()), float(total[1].sum()))


_SPLITS = "tree int, node int, feature int, gain double, bin int, gl double, hl double, g double, h double"


def _split_group(n_bins: int, lam: float, alpha: float, least: float):
    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(group.column("part").to_pylist(), group.column("sums").to_pylist()))
        values = [group.column(c)[0].as_py() for c in ("tree", "node", "feature")] + list(_split_of(rows, n_bins, lam, alpha, least))
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.float64()] * 4
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _SPLITS.split(", ")])
    return run


def _splits(sums: DataFrame, n_tasks: int, cells: int, n_bins: int, lam: float, alpha: float, least: float) -> list[tuple]:
    """(tree, node, feature, gain, bin, GL, HL, G, H) of every node and feature."""
    if n_tasks * cells * n_bins * 16 > DRIVER_BYTES:
        found = sums.groupBy("tree", "node", "feature").applyInArrow(_split_group(n_bins, lam, alpha, least), _SPLITS)
        return sorted(tuple(r) for r in found.collect())
    held: dict[tuple, list] = {}
    for r in sums.collect():
        held.setdefault((r.tree, r.node, r.feature), []).append((r.part, bytes(r.sums)))
    return sorted((*key, *_split_of(rows, n_bins, lam, alpha, least)) for key, rows in held.items())


# -- the estimator --------------------------------------------------------------------

class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    objective = Param(Params._dummy(), "objective", "squared, logistic or softmax", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's weights that is added", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least Hessian of a child", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf weights", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty of leaf weights", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows per round", TypeConverters.toFloat)
    colsampleByTree = Param(Params._dummy(), "colsampleByTree", "share of features per tree", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(objective="squared", maxIter=100, maxDepth=6, stepSize=0.3, minChildWeight=1.0, gamma=0.0, regLambda=1.0,
                         regAlpha=0.0, subsamplingRate=1.0, colsampleByTree=1.0, maxBins=256, seed=42)


class SecondOrderBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees as a pipeline stage; labels of classes count from 0."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", objective="squared", maxIter=100, maxDepth=6, stepSize=0.3, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SecondOrderBoostingModel":
        v = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        data = df.select(vector_to_array(v["featuresCol"]).alias("x"), F.col(v["labelCol"]).cast("double").alias("y")).filter("y IS NOT NULL")
        first = data.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.avg("y").alias("mean"), F.max("y").alias("top")).head()
        if not first.n:
            raise ValueError("no rows to fit")
        width, objective = first.width, v["objective"]
        if objective == "softmax" and first.top < 2:
            objective = "logistic"
        trees = int(first.top) + 1 if objective == "softmax" else 1
        mean = float(first["mean"])
        base = {"squared": mean, "softmax": 0.0, "logistic": float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))}[objective]
        n_bins = v["maxBins"]
        probs = [i / n_bins for i in range(1, n_bins)]
        cuts = data.agg(*[F.percentile_approx(F.get("x", F.lit(j)), probs, 20 * n_bins).alias(f"c{j}") for j in range(width)]).head()
        cuts = [np.array(sorted(set(cuts[j] or []))) for j in range(width)]
        # every level is a job: small tables go to few tasks (coalesce never makes more)
        margin0, n_rows, rows, of = np.full(trees, base), first.n, data, None
        classes = 1 if objective == "squared" else int(first.top) + 1
        if n_rows >= CELL_ROWS and v["subsamplingRate"] >= 1 and math.prod(len(c) + 1 for c in cuts) * classes < 1 << 62:
            summed = cut_lineage(data.mapInArrow(_cells(cuts, classes), "code long, n double, s double").groupBy("code")
                                 .agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
            n_cells = summed.count()
            if n_cells <= n_rows // 2:
                rows, of, n_rows = summed, _of_cells(cuts, classes), n_cells
        blocks = cut_lineage(rows.coalesce(-(-n_rows // ROWS_PER_TASK)).mapInArrow(_cut(cuts, margin0, of), _BLOCKS))
        tasks = blocks.rdd.getNumPartitions()
        lam, alpha = v["regLambda"], v["regAlpha"]
        pick = random.Random(v["seed"])
        forest, pending = [], []
        for turn in range(v["maxIter"]):
            grown = [Tree() for _ in range(trees)]
            columns = [sorted(pick.sample(range(width), max(1, int(v["colsampleByTree"] * width)))) for _ in grown]
            active = [[0] for _ in grown]
            for level in range(v["maxDepth"]):
                job = _histograms(width, trees, pending, [t.arrays() for t in grown], active, columns, n_bins, objective, v["subsamplingRate"], v["seed"], turn)
                sums = blocks.mapInArrow(job, "part int, tree int, node int, feature int, sums binary")
                cells = sum(len(a) * len(c) for a, c in zip(active, columns))
                best: dict[tuple, tuple] = {}
                for k, node, f, gain, at, gl, hl, g, h in _splits(sums, tasks, cells, n_bins, lam, alpha, v["minChildWeight"]):
                    if level == 0:
                        grown[k].g[0], grown[k].h[0] = g, h
                    if gain > LEAST_GAIN and gain > best.get((k, node), (0.0,))[0]:  # ties: the first feature
                        best[k, node] = (gain, f, at, gl, hl)
                active = [[] for _ in grown]
                for (k, node), (gain, f, at, gl, hl) in sorted(best.items()):
                    active[k] += grown[k].split(node, f, at, gain, gl, hl)
                if not best:
                    break
            for t in grown:
                t.finish(v["stepSize"], lam, alpha, v["gamma"])
            forest.append(grown)
            pending.append([(t.arrays(), np.array(t.weight)) for t in grown])
            if len(pending) == KEEP_ROUNDS and turn + 1 < v["maxIter"]:
                blocks, pending = cut_lineage(blocks.mapInArrow(_write_margins(width, trees, pending), _BLOCKS)), []
        stored = json.dumps({"objective": objective, "base": base, "trees": trees, "cuts": [c.tolist() for c in cuts],
                             "forest": [[{"feature": t.feature, "bin": t.bin, "left": t.left, "right": t.right, "gain": t.gain, "weight": t.weight}
                                         for t in group] for group in forest]})
        model = SecondOrderBoostingModel()
        return self._copyValues(model._set(forest=stored))


class SecondOrderBoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` (classes) and ``prediction``."""

    forest = Param(Params._dummy(), "forest", "the trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def parts(self) -> dict:
        return json.loads(self.getOrDefault("forest"))

    @property
    def featureImportances(self):
        """Mean gain of each feature's splits, as shares."""
        p = self.parts()
        gain, count = np.zeros(len(p["cuts"])), np.zeros(len(p["cuts"]))
        for t in (t for group in p["forest"] for t in group):
            for f, v in zip(t["feature"], t["gain"]):
                if f >= 0:
                    gain[f] += v
                    count[f] += 1
        mean = gain / np.maximum(count, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.parts()
        cuts = [np.array(c) for c in p["cuts"]]
        groups = [[(tuple(np.array(t[c]) for c in ("feature", "bin", "left", "right")), np.array(t["weight"])) for t in g] for g in p["forest"]]

        @F.pandas_udf("array<double>")
        def margins(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.stack(x.to_list())
            bins = np.stack([np.searchsorted(c, m[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
            at = None
            if math.prod(len(c) + 1 for c in cuts) < 1 << 62:  # rows of a cell are predicted once
                _, first, at = np.unique(_codes(bins, [len(c) + 1 for c in cuts]), return_index=True, return_inverse=True)
                bins, m = bins[first], m[first]
            out = np.full((len(m), p["trees"]), p["base"])
            for g in groups:
                for k, (tree, weight) in enumerate(g):
                    out[:, k] += weight[leaves(tree, bins)]
            return pd.Series(list(out if at is None else out[at]))

        out = df.withColumn("rawPrediction", margins(vector_to_array(self.getFeaturesCol())))
        raw = F.col("rawPrediction")
        if p["objective"] == "squared":
            return out.withColumn(self.getPredictionCol(), F.get(raw, F.lit(0))).drop("rawPrediction")
        if p["objective"] == "logistic":
            one = 1 / (1 + F.exp(-F.get(raw, F.lit(0))))
            out = out.withColumn("probability", F.array(1 - one, one))
        else:
            e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
            total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
            out = out.withColumn("probability", F.transform(e, lambda v: v / total))
        out = out.withColumn(self.getPredictionCol(), (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("probability"))
