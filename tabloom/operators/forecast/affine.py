"""Exponential smoothing of long series by a scan over blocks.

One step of single, double or triple smoothing is an affine map of the state,
``s' = A s + b y``, and the one-step forecast is ``h s``. A block of periods is
therefore an affine map too: ``s_end = A^L s_start + c``, where ``c`` is the
recursion run from a zero state. Blocks are run in parallel for a whole chunk
of candidates, and only their maps (a few numbers per candidate) are composed
in order, per series and chunk.

With ``initial="estimated"`` the start state minimises the squared one-step
errors. The errors are linear in it, so each block adds its part of the normal
equations, which the same scan composes; the solution is exact least squares.

A series is cut at the ends of its fit and train parts and every ``block``
periods, so no task holds more than a block of periods, and the scan streams
over one row per block and chunk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, present, qcol
from tabloom.operators.windows import series_positions
from tabloom.session import cut_lineage

BLOCK = 32_768
CHUNK = 243
FIT, VALID, TEST, FUTURE = 0, 1, 2, 3
METHODS = ("single", "double", "triple")


class Chunk:
    """Up to ``CHUNK`` candidates of one method and season length."""

    def __init__(self, method: str, m: int, alpha, beta, gamma, first: int):
        self.method, self.m, self.first = method, m, first
        self.alpha, self.beta, self.gamma = (np.asarray(x, float) for x in (alpha, beta, gamma))
        self.d = {"single": 1, "double": 2, "triple": m + 2}[method]
        #: Observations that a fixed start state uses up, and those it needs.
        self.skip = {"single": 1, "double": 1, "triple": m}[method]
        self.need = {"single": 1, "double": 2, "triple": 2 * m}[method]

    def __len__(self):
        return len(self.alpha)


def chunks(methods, alphas, betas, gammas, seasons) -> list[Chunk]:
    """The candidate grid, in the order in which ties are decided."""
    out = []
    for method in methods:
        if method not in METHODS:
            raise OperatorError(f"unknown smoothing method {method!r}")
        first = 0
        for m in seasons if method == "triple" else [0]:
            axes = {"single": (alphas, [0.0], [0.0]), "double": (alphas, betas, [0.0]), "triple": (alphas, betas, gammas)}[method]
            a, b, g = (x.ravel() for x in np.meshgrid(*axes, indexing="ij"))
            for lo in range(0, len(a), CHUNK):
                out.append(Chunk(method, m, a[lo:lo + CHUNK], b[lo:lo + CHUNK], g[lo:lo + CHUNK], first + lo))
            first += len(a)
    return out


def advance(k: Chunk, s: np.ndarray, y) -> np.ndarray:
    """One step of every candidate; states are (candidates, d) with the season
    of the coming period first."""
    a = k.alpha
    if k.method == "single":
        return (a * y + (1 - a) * s[:, 0])[:, None]
    season = s[:, 2] if k.method == "triple" else 0.0
    level = a * (y - season) + (1 - a) * (s[:, 0] + s[:, 1])
    trend = k.beta * (level - s[:, 0]) + (1 - k.beta) * s[:, 1]
    out = np.empty_like(s)
    out[:, 0], out[:, 1] = level, trend
    if k.method == "triple":
        out[:, 2:-1] = s[:, 3:]
        out[:, -1] = k.gamma * (y - level) + (1 - k.gamma) * season
    return out


def forecast(k: Chunk, s: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(candidates, steps) forecasts ``steps`` periods after the state."""
    out = np.repeat(s[:, :1], len(steps), axis=1)
    if k.method != "single":
        out = out + s[:, 1:2] * steps
    if k.method == "triple":
        out = out + s[:, 2 + (steps - 1) % k.m]
    return out


def transition(k: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Matrix A (candidates, d, d) and forecast row h (d)."""
    a = np.stack([advance(k, np.tile(e, (len(k), 1)), 0.0) for e in np.eye(k.d)], axis=2)
    h = np.zeros(k.d)
    h[:3] = 1.0
    return a, h


def powers(k: Chunk, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A^length and the sum of (h A^j)' (h A^j) for j below ``length``, by doubling."""
    a, h = transition(k)
    size, gram = np.tile(np.eye(k.d), (len(k), 1, 1)), np.zeros((len(k), k.d, k.d))
    step, part = a, np.tile(np.outer(h, h), (len(k), 1, 1))
    while length:
        if length & 1:
            gram = gram + np.swapaxes(size, 1, 2) @ part @ size
            size = step @ size
        part = part + np.swapaxes(step, 1, 2) @ part @ step
        step = step @ step
        length >>= 1
    return size, gram


def start_state(k: Chunk, y: np.ndarray) -> np.ndarray:
    """The fixed start: first value; first value and difference; first-season means."""
    if k.method == "single":
        s = [y[0]]
    elif k.method == "double":
        s = [y[0], y[1] - y[0]]
    else:
        level = y[:k.m].mean()
        s = [level, (y[k.m:2 * k.m].mean() - level) / k.m, *(y[:k.m] - level)]
    return np.tile(np.array(s, float), (len(k), 1))


def block_map(k: Chunk, y: np.ndarray, estimate: bool) -> tuple[np.ndarray, np.ndarray]:
    """(c, g) of a block: the end state from zero, and the sum of (h A^j)' e_j of
    its one-step errors."""
    s, g = np.zeros((len(k), k.d)), np.zeros((len(k), k.d))
    if estimate:
        a, h = transition(k)
        row = np.tile(h, (len(k), 1))
    for v in y:
        if estimate:
            g += row * (v - s @ h)[:, None]
            row = np.einsum("ci,cij->cj", row, a)
        s = advance(k, s, v)
    return s, g


def estimated_start(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Least squares start states; the smallest one where several fit alike."""
    return np.einsum("cij,cj->ci", np.linalg.pinv(gram, rcond=1e-12, hermitian=True), moment)


def smoothed_states(k: Chunk, y: np.ndarray, initial: str) -> np.ndarray:
    """States after ``y`` in one go: the plain form of the scan."""
    if initial == "fixed":
        s, rest = start_state(k, y), y[k.skip:]
    else:
        c, g = block_map(k, y, True)
        size, gram = powers(k, len(y))
        return np.einsum("cij,cj->ci", size, estimated_start(gram, g)) + c
    for v in rest:
        s = advance(k, s, v)
    return s


# -- Spark steps ----------------------------------------------------------------

def _blocks(rows: DataFrame, block: int, need: int) -> DataFrame:
    """(key, part, start, n_fit, n_train, n, y, head): the values of a block in
    order; ``head`` holds the series' first ``need`` values."""
    origin = F.when(F.col("part") == TEST, F.col("n_train")).when(F.col("part") == VALID, F.col("n_fit")).otherwise(0)
    cut = F.floor((F.col("at") - origin) / block)
    head = (rows.filter(F.col("at") < need).groupBy(F.col("key").alias("hk"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("h")))
    some = (rows.withColumn("cut", cut).groupBy("key", "part", "cut")
            .agg(F.min("at").alias("start"), F.first("n_fit").alias("n_fit"), F.first("n_train").alias("n_train"), F.first("n").alias("n"),
                 F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
            .select("key", "part", "start", "n_fit", "n_train", "n", F.col("v.value").alias("y")))
    return some.join(head, F.col("key").eqNullSafe(F.col("hk"))).select(*some.columns, F.col("h.value").alias("head"))


def _maps(plan: list[Chunk], estimate: bool):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, y = (batch.column(c)[r].as_py() for c in ("part", "start", "y"))
                y = np.array(y, float)
                for i, k in enumerate(plan):
                    used = y if estimate else y[max(0, k.skip - start):]
                    c, g = block_map(k, used, estimate)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(r, 1), pa.array([i], pa.int32()), pa.array([part], pa.int32()),
                         pa.array([start], pa.int64()), pa.array([len(used)], pa.int64()),
                         pa.array([c.ravel()], pa.list_(pa.float64())), pa.array([g.ravel() if estimate else None], pa.list_(pa.float64())),
                         *(batch.column(name).slice(r, 1) for name in ("head", "n_fit", "n_train", "n"))],
                        names=["key", "chunk", "part", "start", "length", "c", "g", "head", "n_fit", "n_train", "n"])
    return run


class _Scan:
    """Running composition of a series' blocks for one chunk."""

    def __init__(self, k: Chunk, head, estimate: bool):
        self.k, self.estimate = k, estimate
        self.size = np.tile(np.eye(k.d), (len(k), 1, 1))
        self.gram, self.moment = np.zeros((len(k), k.d, k.d)), np.zeros((len(k), k.d))
        short = len(head) < k.need
        self.state = np.zeros((len(k), k.d)) if estimate or short else start_state(k, np.array(head))

    def add(self, length: int, c, g, power) -> None:
        step, gram = power(length)
        if self.estimate:
            back = np.swapaxes(self.size, 1, 2)
            moment = np.array(g).reshape(self.state.shape) - np.einsum("cij,cj->ci", gram, self.state)
            self.gram = self.gram + back @ gram @ self.size
            self.moment = self.moment + np.einsum("cij,cj->ci", back, moment)
            self.size = step @ self.size
        self.state = np.einsum("cij,cj->ci", step, self.state) + np.array(c).reshape(self.state.shape)

    def end(self) -> np.ndarray:
        if not self.estimate:
            return self.state
        return np.einsum("cij,cj->ci", self.size, estimated_start(self.gram, self.moment)) + self.state


def _states(plan: list[Chunk], estimate: bool):
    """End states of the parts from block maps sorted by key, chunk and start."""
    def run(batches):
        power = [lru_cache(8)(lambda n, k=k: powers(k, n)) for k in plan]
        scan, at, key, part, sizes = None, None, None, None, {}

        def rows(to):
            if scan is None or sizes[to] < scan.k.need:
                return
            yield pa.RecordBatch.from_arrays([key, pa.array([at[1]], pa.int32()), pa.array([to], pa.int32()),
                                               pa.array([scan.end().ravel()], pa.list_(pa.float64()))],
                                              names=["key", "chunk", "part", "state"])

        for batch in batches:
            for r in range(batch.num_rows):
                now = (batch.column("key")[r].as_py(), batch.column("chunk")[r].as_py())
                p = batch.column("part")[r].as_py()
                if now != at:
                    yield from rows(FUTURE)
                    key, at, part = batch.column("key").slice(r, 1), now, p
                    scan = _Scan(plan[now[1]], batch.column("head")[r].as_py(), estimate)
                    sizes = dict(zip((VALID, TEST, FUTURE), (batch.column(c)[r].as_py() for c in ("n_fit", "n_train", "n"))))
                elif p != part:
                    yield from rows(p)
                    part = p
                scan.add(batch.column("length")[r].as_py(), batch.column("c")[r].as_py(), batch.column("g")[r].as_py(), power[now[1]])
        yield from rows(FUTURE)
    return run


def _scores(plan: list[Chunk]):
    """Sums of the errors of a block for every candidate of a chunk."""
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                k = plan[batch.column("chunk")[r].as_py()]
                y = np.array(batch.column("y")[r].as_py(), float)
                s = np.array(batch.column("state")[r].as_py()).reshape(len(k), k.d)
                ahead = batch.column("ahead")[r].as_py()
                share, plain, square = np.zeros(len(k)), np.zeros(len(k)), np.zeros(len(k))
                for lo in range(0, len(y), 4096):
                    a = y[lo:lo + 4096]
                    err = forecast(k, s, np.arange(lo, lo + len(a)) + ahead + 1) - a
                    some = a != 0
                    share += np.abs(err[:, some] / a[some]).sum(axis=1)
                    plain += np.abs(err).sum(axis=1)
                    square += (err * err).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(r, 1), batch.column("chunk").slice(r, 1), batch.column("part").slice(r, 1),
                     pa.array([len(y)], pa.int64()), pa.array([int((y != 0).sum())], pa.int64())]
                    + [pa.array([v], pa.list_(pa.float64())) for v in (share, plain, square)],
                    names=["key", "chunk", "part", "n", "nonzero", "share", "plain", "square"])
    return run


def candidate_scores(df: DataFrame, target: str, time_column: str, keys: list[str], plan: list[Chunk], test_size: float,
                     select_on: str, validation_size: float, initial: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Every candidate of every series, and the series themselves.

    Candidates: ``key, method, alpha, beta, gamma, season_period, mape, mae, mse,
    rmse, r2, n_test, score, rank, state`` (end of the train part), ``last_state``
    (end of the series); ``rank`` 1 is the method's best by ``score``, the mean
    relative error of the part that ``select_on`` names. Series: ``key, n, n_fit, n_train``."""
    if initial not in ("fixed", "estimated"):
        raise OperatorError("initial must be 'fixed' or 'estimated'")
    estimate = initial == "estimated"
    key = F.struct(*[qcol(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    base = df.select(key.alias("key"), qcol(time_column).alias("time"), present(df, target).cast("double").alias("value")).filter("value IS NOT NULL")
    rows = series_positions(base, "time", "key", rows_per_block=max(block, 1), pos="p", size="n")
    n_train = F.floor(F.col("n") * F.lit(1.0 - test_size))
    n_fit = F.floor(F.col("n_train") * F.lit(1.0 - validation_size)) if select_on == "validation" else F.col("n_train")
    rows = cut_lineage(rows.withColumn("at", F.col("p") - 1).withColumn("n_train", n_train).withColumn("n_fit", n_fit)
                       .withColumn("part", F.when(F.col("at") >= F.col("n_train"), TEST).when(F.col("at") >= F.col("n_fit"), VALID).otherwise(FIT))
                       .select("key", "at", "value", "part", "n", "n_fit", "n_train"))
    series = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("n_fit").alias("n_fit"), F.first("n_train").alias("n_train"),
                                     (F.var_pop(F.when(F.col("part") == TEST, F.col("value")))
                                      * F.count_if(F.col("part") == TEST)).alias("spread"))
    blocks = cut_lineage(_blocks(rows, block, max(k.need for k in plan)))
    key_type = blocks.schema["key"].dataType.simpleString()
    maps = blocks.mapInArrow(_maps(plan, estimate), f"key {key_type}, chunk int, part int, start long, length long, "
                                                    "c array<double>, g array<double>, head array<double>, "
                                                    "n_fit long, n_train long, n long")
    states = cut_lineage(maps.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "start")
                         .mapInArrow(_states(plan, estimate), f"key {key_type}, chunk int, part int, state array<double>"))
    judged = (blocks.filter(F.col("part") != FIT).alias("b").join(states.alias("s"), F.expr("b.key <=> s.key AND b.part = s.part"))
              .select("b.key", "s.chunk", "b.part", "b.y", "s.state",
                      (F.col("b.start") - F.when(F.col("b.part") == TEST, F.col("b.n_train")).otherwise(F.col("b.n_fit"))).alias("ahead")))
    sums = judged.mapInArrow(_scores(plan), f"key {key_type}, chunk int, part int, n long, nonzero long, "
                                            "share array<double>, plain array<double>, square array<double>")
    each = (sums.select("key", "chunk", "part", "n", "nonzero", F.posexplode(F.arrays_zip("share", "plain", "square")).alias("i", "e"))
            .groupBy("key", "chunk", "i").agg(*[F.sum(F.when(F.col("part") == p, F.col(c))).alias(f"{a}{p}")
                                               for p in (VALID, TEST) for c, a in (("n", "n"), ("nonzero", "z"), ("e.share", "share"),
                                                                                   ("e.plain", "plain"), ("e.square", "square"))]))
    grid = blocks.sparkSession.createDataFrame(
        [(c, j, k.method, float(k.alpha[j]), float(k.beta[j]) if k.method != "single" else None,
          float(k.gamma[j]) if k.method == "triple" else None, k.m or None, k.first + j, k.d) for c, k in enumerate(plan) for j in range(len(k))],
        "chunk int, i int, method string, alpha double, beta double, gamma double, season_period int, place int, d int")
    chosen = VALID if select_on == "validation" else TEST
    share = {p: F.when(F.col(f"z{p}") > 0, F.col(f"share{p}") / F.col(f"z{p}")) for p in (VALID, TEST)}
    own = [states.filter(F.col("part") == p).select(F.col("key").alias(f"k{p}"), F.col("chunk").alias(f"c{p}"), F.col("state").alias(f"s{p}"))
           for p in (TEST, FUTURE)]
    mse = F.col(f"square{TEST}") / F.col(f"n{TEST}")
    order = Window.partitionBy("key", "method").orderBy(F.round("score", 12).asc_nulls_last(), "place")
    part_of = F.col("i") * F.col("d") + 1
    out = (each.join(grid, ["chunk", "i"]).join(series.withColumnRenamed("key", "sk"), F.col("key").eqNullSafe(F.col("sk")))
           .filter(F.col(f"n{TEST}").isNotNull())
           .withColumn("score", share[chosen]).withColumn("rank", F.row_number().over(order))
           .join(own[0], F.expr(f"key <=> k{TEST} AND chunk = c{TEST}")).join(own[1], F.expr(f"key <=> k{FUTURE} AND chunk = c{FUTURE}")))
    return out.select("key", "method", "alpha", "beta", "gamma", "season_period", share[TEST].alias("mape"),
                      (F.col(f"plain{TEST}") / F.col(f"n{TEST}")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                      F.when(F.col("spread") == 0, 0.0).otherwise(1 - F.col(f"square{TEST}") / F.col("spread")).alias("r2"),
                      F.col(f"n{TEST}").alias("n_test"), "score", "rank", F.slice(f"s{TEST}", part_of, F.col("d")).alias("state"),
                      F.slice(f"s{FUTURE}", part_of, F.col("d")).alias("last_state")), series


def forecast_column(method, state, season, step):
    """Forecast ``step`` periods after a state, as a column."""
    trend = F.when(method != "single", F.get(state, F.lit(1)) * step).otherwise(0.0)
    turn = F.when(method == "triple", F.get(state, (F.lit(2) + F.pmod(step - 1, F.coalesce(season, F.lit(1)))).cast("int"))).otherwise(0.0)
    return F.get(state, F.lit(0)) + trend + turn
