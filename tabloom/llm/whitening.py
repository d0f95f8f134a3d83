"""Embedding whitening by weighted multiplicity covariance.

Vectors are put on a fixed grid, ``x = floor(scale * c) + offset`` (long), so
sums are exact and equal vectors are equal rows.

1. Identical ``x`` vectors become one row with their count; the fit weighs a
   distinct vector by its count (``weights="count"``) or by one (``"one"``).
2. Exact weighted sums per dimension give the mean.
3. Each slice of distinct vectors is centred (whole part in integers, rest in
   double) and multiplied, ``Y^T diag(w) Y``; the rows of the slices' matrices
   are added up per matrix row.
4. The covariance of one dimension count is decomposed on the driver, and every
   distinct vector is projected and whitened once; a join by a 128-bit digest
   of ``x`` gives every input row its values.

Scale: no step holds more than a batch of vectors and one ``dim x dim`` matrix.
A slice holds at least ``64 * dim`` vectors, so the matrices sent are a
fraction of the vectors read. The driver gets sums and covariances: ``dim**2``
doubles per vector length (8 MB at 1,000 dimensions), whatever the number of
rows. A vector that a third of all rows share is one row after the first,
map-side combined aggregation; its rows are split by Spark's skew join when the
values come back.

Defined cases: rows whose vector is NULL, empty, or holds a NULL, NaN, infinite
component or one of ``2**52`` and more (its ``x`` is no long) are left out;
vectors of different lengths are whitened apart, each length with its own fit;
rows with a NULL id and repeated rows are rows like any other; ``deviation`` is
NULL where the exact number is no long; eigenvectors have their largest entry
positive; components without variance (eigenvalue at most ``dim * 2**-52`` of
the largest, or all equal vectors) have ``whitened`` 0.0, and count as an
``identity_error`` of 1; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, stored_path, table

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
_ROWS = 4096
_LIMIT = float(2 ** 52)


def grid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
                 offset: int = OFFSET) -> DataFrame:
    """(id, dim, x, h1, h2) of the rows that take part; ``h1, h2`` name ``x``."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(_LIMIT)))
    x = F.transform("c", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset))
    return (v.filter(F.col("c").isNotNull()).filter(~bad & (F.size("c") > 0))
            .select("id", F.size("c").alias("dim"), x.alias("x"))
            .select("*", F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2")))


def _blocks(batches):
    """(dim, batch rows, matrix of x, weights) for runs of equal length."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        lists = batch.column(1)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            for at in range(0, len(rows), _ROWS):
                some = rows[at:at + _ROWS]
                x = lists.take(pa.array(some)).flatten().to_numpy().reshape(len(some), dim)
                yield int(dim), some, x, batch


def _weights(batch, rows, by_count: bool) -> np.ndarray:
    return batch.column(2).to_numpy()[rows] if by_count else np.ones(len(rows), np.int64)


def _exact_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted column sums as Python integers."""
    top = int(np.abs(x).max(initial=0)) * int(w.sum())
    if top < 2 ** 62:
        return (x * w[:, None]).sum(axis=0).astype(object)
    return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)


def _sums(by_count: bool):
    def run(batches):
        found: dict[int, list] = {}
        for dim, rows, x, batch in _blocks(batches):
            w = _weights(batch, rows, by_count)
            s, n = found.get(dim, (0, 0))
            found[dim] = (s + _exact_sums(x, w), n + int(w.sum()))
        for dim, (s, n) in found.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int64()),
                "high": pa.array([[int(v) >> 32 for v in s]], pa.list_(pa.int64())),
                "low": pa.array([[int(v) & 0xFFFFFFFF for v in s]], pa.list_(pa.int64()))})
    return run


def exact_sums(distinct: DataFrame, by_count: bool) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, S)}: total weight and exact weighted sums of each length."""
    parts = distinct.select("dim", "x", "w").mapInArrow(_sums(by_count), "dim int, n long, high array<long>, low array<long>")
    rows = (parts.select("dim", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
            .groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
            .orderBy("dim", "at").collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.dim, (r.n, []))[1].append((r.high << 32) + r.low)
    return out


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``x - S / n``: whole part exactly, the rest in double."""
    whole = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n / n for v in s])
    return (x - whole).astype(np.float64) - rest


def _products(fits: dict, by_count: bool):
    def run(batches):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId()
        total: dict[int, np.ndarray] = {}
        for dim, rows, x, batch in _blocks(batches):
            y = centred(x, *fits[dim])
            part = y.T @ (y * _weights(batch, rows, by_count)[:, None])
            total[dim] = total[dim] + part if dim in total else part
        for dim, m in total.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * dim, pa.int32()), "i": pa.array(range(dim), pa.int32()),
                "slice": pa.array([at] * dim, pa.int32()),
                "v": pa.array(list(m), pa.list_(pa.float64()))})
    return run


def _add_rows(group: pa.Table) -> pa.Table:
    group = group.sort_by("slice")
    total = sum(np.asarray(v.values) for v in group.column("v"))
    return pa.table({"dim": group.column("dim")[:1], "i": group.column("i")[:1], "v": pa.array([total], pa.list_(pa.float64()))})


def covariances(distinct: DataFrame, fits: dict, by_count: bool) -> dict[int, np.ndarray]:
    """{dim: covariance matrix}, divisor n, centred before multiplying."""
    count, dim = distinct.count(), max(fits)
    slices = max(1, count // (64 * dim))  # coalesce never makes more
    rows = (distinct.select("dim", "x", "w").coalesce(slices).mapInArrow(_products(fits, by_count), "dim int, i int, slice int, v array<double>")
            .groupBy("dim", "i").applyInArrow(_add_rows, "dim int, i int, v array<double>").collect())
    out = {d: np.zeros((d, d)) for d in fits}
    for r in rows:
        out[r.dim][r.i] = r.v
    return {d: (m + m.T) / 2 / fits[d][0] for d, m in out.items()}


def decompose(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, their unit eigenvectors as columns, and the trace."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0), float(np.trace(v))


def _projection(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Columns that whiten; zero where there is no variance."""
    live = values > max(values[0], 0.0) * len(vectors) * 2.0 ** -52
    return np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)^2; None beyond a long."""
    top = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    if top < 2 ** 62 and top * top * x.shape[1] < 2 ** 63:
        y = x * n - np.array(s, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        d = sum((n * a - b) ** 2 for a, b in zip(row, s))
        out.append(d if d < 2 ** 63 else None)
    return out


def _whiten(fits: dict, projections: dict):
    def run(batches):
        for dim, rows, x, batch in _blocks(batches):
            n, s = fits[dim]
            z = centred(x, n, s) @ projections[dim]
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(pick), batch.column(4).take(pick), batch.column(0).take(pick), batch.column(2).take(pick),
                 pa.array(_deviations(x, n, s), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))],
                names=["k1", "k2", "dim", "w", "deviation", "z"])
    return run


def identity_errors(whitened: DataFrame, kept: dict[int, int], by_count: bool) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened fit list - I)."""
    k = max(kept.values())
    w = F.col("w").cast("double") if by_count else F.lit(1.0)
    z = [F.get("z", F.lit(i)) for i in range(k)]
    sums = [F.sum(w).alias("n")] + [F.sum(w * z[i]).alias(f"m{i}") for i in range(k)]
    sums += [F.sum(w * z[i] * z[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    return {r.dim: max(abs(r[f"c{i}_{j}"] / r.n - r[f"m{i}"] / r.n * (r[f"m{j}"] / r.n) - (i == j))
                       for i in range(kept[r.dim]) for j in range(i, kept[r.dim]))
            for r in whitened.groupBy("dim").agg(*sums).collect()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           weights: str = "count", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``:
    one row per vector that takes part and component."""
    if weights not in ("count", "one"):
        raise ValueError("weights: 'count' or 'one'")
    spark, by_count = vectors.sparkSession, weights == "count"
    points = grid_vectors(vectors, id_col, vec_col, scale, offset)
    distinct, distinct_path = stored_path(points.groupBy("dim", "x", "h1", "h2").agg(F.count("*").alias("w"))
                                          .select("dim", "x", "w", "h1", "h2"), "distinct")
    fits = exact_sums(distinct, by_count)
    if not fits:
        return spark.createDataFrame([], f"`{id_col}` long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    spectra = {d: decompose(v, components) for d, v in covariances(distinct, fits, by_count).items()}
    projections = {d: _projection(values, u) for d, (values, u, _) in spectra.items()}
    whitened, _ = stored_path(distinct.mapInArrow(_whiten(fits, projections), "k1 long, k2 long, dim int, w long, deviation long, z array<double>"),
                              "whitened")
    errors = identity_errors(whitened, {d: p.shape[1] for d, p in projections.items()}, by_count)
    discard(spark, distinct_path)
    about = spark.createDataFrame(
        [(d, c + 1, fits[d][0], float(max(values[c], 0.0) / trace) if trace > 0 else 0.0, float(errors[d]))
         for d, (values, _, trace) in spectra.items() for c in range(len(values))],
        "ad int, component int, n long, explained double, identity_error double")
    rows = (points.select("id", "h1", "h2")
            .join(whitened, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            .select("id", "dim", "deviation", F.posexplode("z").alias("at", "whitened")))
    return (rows.join(about, (F.col("dim") == F.col("ad")) & (F.col("at") + 1 == F.col("component")))
            .select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
