"""Mutual information by nearest neighbours (STA-9).

For a discrete target (Ross 2014): the distance ``d`` from a point to its
``k``-th neighbour of the same class, and the number ``m`` of points of any
class that are nearer than ``d``; the score is psi(N) + <psi(k)> - <psi(N_y)> -
<psi(m)>. For a continuous target (Kraskov, Stögbauer, Grassberger 2004,
estimator 1): ``d`` is the distance to the ``k``-th neighbour in the plane of
feature and target by the larger of both differences, and the points nearer
than ``d`` are counted on either axis: psi(N) + psi(k) - <psi(m_x)> - <psi(m_y)>.
A point counts itself; scores below 0 are 0.

On Spark: neighbours on a line come from a range sort numbered over all rows,
cut into blocks that also get the ``k`` rows before and after them. Neighbours in
the plane come from tiles of at most about ``CELL`` points (``Plane``), from values made ready once
and packed in runs: a k-d tree from a sample lays the tiles out, exact row counts and bounds of its leaves say how far
a point's neighbours can lie, and a tile also gets the points within that distance.
Counts of a discrete target are rank differences: interval ends are sorted into
the values and carry the running count; counts beside a continuous one are made in buckets
of the axis. Nothing is held per class, value or feature in one task; the driver gets the
sample, one row per leaf and bucket, and one row count per sort partition.

Equal values: with ``noise`` (the default) a seeded normal number of relative size
1e-10 is added to every value, so ties break at random but the same way in every
run; it is drawn from the row's ``key`` columns (all columns by default).
Without noise, ``d`` may be 0, and ``m`` then counts the equal values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, as_list, present, qcol, require_columns
from tabloom.operators.windows import numbered
from tabloom.session import cut_lineage, scratch_path

LINE_BLOCK = 65_536
CELL = 262_144    # points of a tile of the plane, values of a bucket of an axis
BOX = 12          # points of a box inside a tile
LOOSE = 0.3       # parts of a box's side: farther neighbours are first looked for in the next boxes
RUN = 100_000     # points a task packs at a time
SAMPLE = 50_000   # points that lay out the plane, or one of 512 when those are more


def digamma(c: Column) -> Column:
    """Digamma function of a column of positive numbers."""
    x = c.cast("double") + 10.0
    i = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    for j in range(10):
        series = series - 1.0 / (c.cast("double") + float(j))
    return series


def _normal(seed: int, *cols: Column) -> Column:
    """A standard normal number drawn from the hash of columns."""
    def uniform(salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *cols), 12).cast("double") + 0.5) / 2.0 ** 52
    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def _sides(df: DataFrame, features: list[str], target: str, classification: bool, noise: bool, seed: int, key):
    """[(present value, value ready for scoring)] of the features, and of the target last. For a
    continuous target all are in units of their standard deviation."""
    sides = [(f"x{i}", present(df, f).cast("double")) for i, f in enumerate(features)]
    if not classification:
        sides.append(("y", present(df, target).cast("double")))
    row = [F.coalesce(qcol(c).cast("string"), F.lit("\0")) for c in (as_list(key) or df.columns)]
    stats = df.select(*[c.alias(n) for n, c in sides]).agg(
        *[e for n, _ in sides for e in (F.stddev_pop(n).alias(f"s{n}"), F.avg(F.abs(n)).alias(f"m{n}"))]).head()

    def ready(i: int, name: str, value: Column) -> Column:
        unit, size = stats[f"s{name}"] or 1.0, stats[f"m{name}"] or 0.0
        if noise:
            value = value + F.lit(1e-10 * max(unit, size)) * _normal(seed, F.lit(i), *row)
        return value if classification else value / F.lit(unit)

    found = [(value, ready(i, name, value)) for i, (name, value) in enumerate(sides)]
    if classification:
        label = present(df, target).cast("string")
        found.append((label, label))
    return found


def points(df: DataFrame, features: list[str], target: str, classification: bool, noise: bool, seed: int, key) -> DataFrame:
    """(f, x, y): complete pairs of every feature, by feature number."""
    *xs, (_, y) = _sides(df, features, target, classification, noise, seed, key)
    wide = df.select(y.alias("y"), *[x.alias(f"x{i}") for i, (_, x) in enumerate(xs)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("x")) for i in range(len(features))]))
    return wide.select("y", each.alias("p")).select("p.f", "p.x", "y").filter("x IS NOT NULL AND y IS NOT NULL")


# -- counts on an axis ------------------------------------------------------------

def interval_counts(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """(pid, m): values (axis, v) inside each interval (axis, pid, lo, hi, closed):
    between the ends, or with ``closed`` at them."""
    left, right = F.lit(0), F.lit(2)  # before and behind equal values
    ends = F.array(F.struct(F.col("hi").alias("v"), F.when(F.col("closed"), right).otherwise(left).alias("kind"), F.lit(1).alias("sign")),
                   F.struct(F.col("lo").alias("v"), F.when(F.col("closed"), left).otherwise(right).alias("kind"), F.lit(-1).alias("sign")))
    asked = intervals.select("axis", "pid", F.explode(ends).alias("e")).select("axis", "e.v", "e.kind", "pid", "e.sign")
    known = values.select("axis", "v", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pid"), F.lit(0).alias("sign"))
    order = ["axis", "v", "kind"]
    rows = cut_lineage(known.unionByName(asked).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    is_value = F.when(F.col("kind") == 1, 1).otherwise(0)
    total, offsets = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum(is_value)).collect()):
        offsets.append((part, total))
        total += n
    at = values.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, before long")
    running = F.sum(is_value).over(Window.partitionBy("part").orderBy(*order))
    ranked = rows.withColumn("rank", running).filter("kind <> 1").join(F.broadcast(at), "part")
    return ranked.groupBy("axis", "pid").agg(F.sum((F.col("before") + F.col("rank")) * F.col("sign")).alias("m"))


# -- discrete target ---------------------------------------------------------------

def _line_neighbours(k: int):
    """Distance to the k-th neighbour of the same (f, y), and the open interval
    nearer than that, for the rows of a block (sorted by number)."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("num")
        x, n = group.column("x").to_numpy(), group.column("n").to_numpy()
        run_of = group.column("f").to_numpy().astype(np.int64) * 2 ** 32 + group.column("y").combine_chunks().dictionary_encode().indices.to_numpy()
        size = len(x)
        near = np.minimum(k, n - 1)
        far = np.full((k + 1, size), np.inf)
        left, right = far.copy(), far.copy()  # values a places below and above
        left[0] = right[0] = x
        for a in range(1, k + 1):
            same = run_of[a:] == run_of[:-a]
            left[a, a:] = np.where(same, x[:-a], np.inf)
            right[a, :size - a] = np.where(same, x[a:], np.inf)
        d, lo, hi = np.full(size, np.inf), x.copy(), x.copy()
        at = np.arange(size)
        for a in range(k + 1):
            b = near - a
            ok = b >= 0
            lv, rv = left[a], right[np.maximum(b, 0), at]
            below = np.where(np.isfinite(lv), x - lv, np.inf)
            above = np.where(np.isfinite(rv), rv - x, np.inf)
            far_side = np.maximum(below, above)
            better = ok & (far_side < d)
            # the end that holds the neighbour is the neighbour itself, without rounding
            d = np.where(better, far_side, d)
            lo = np.where(better, np.where(below == far_side, lv, x - far_side), lo)
            hi = np.where(better, np.where(above == far_side, rv, x + far_side), hi)
        own = group.column("own").to_numpy(zero_copy_only=False) & np.isfinite(d)
        closed = d == 0
        return pa.table({"f": group.column("f").to_numpy()[own], "pid": group.column("num").to_numpy()[own], "near": near[own],
                         "n": n[own], "lo": lo[own], "hi": hi[own], "closed": closed[own]})
    return run


def discrete_scores(p: DataFrame, k: int, block: int = LINE_BLOCK) -> DataFrame:
    """(f, score) for a discrete ``y``; classes of one row take no part."""
    classes = p.groupBy(F.col("f").alias("cf"), F.col("y").alias("cy")).agg(F.count("*").alias("n")).filter("n > 1")
    some = p.join(classes, F.expr("f = cf AND y = cy")).select("f", "y", "x", "n")
    rows = numbered(some, ["f", "y", "x"], "num")
    here = F.floor(F.col("num") / block)
    inside = F.col("num") % block
    ways = F.array(F.struct(here.alias("block"), F.lit(True).alias("own")),
                   F.when((inside < k) & (here > 0), F.struct((here - 1).alias("block"), F.lit(False).alias("own"))),
                   F.when(inside >= block - k, F.struct((here + 1).alias("block"), F.lit(False).alias("own"))))
    dealt = rows.select("f", "y", "x", "n", "num", F.explode(F.array_compact(ways)).alias("w")).select("f", "y", "x", "n", "num", "w.block", "w.own")
    near = dealt.groupBy("block").applyInArrow(_line_neighbours(k), "f int, pid long, near long, n long, lo double, hi double, closed boolean")
    near = cut_lineage(near)
    counts = interval_counts(rows.select(F.col("f").alias("axis"), F.col("x").alias("v")), near.withColumnRenamed("f", "axis"))
    m = near.join(counts.select("pid", "m"), "pid")
    means = m.groupBy("f").agg(F.count("*").alias("total"), F.avg(digamma(F.col("near")) - digamma(F.col("n")) - digamma(F.col("m"))).alias("mean"))
    return means.select("f", F.greatest(F.lit(0.0), digamma(F.col("total")) + F.col("mean")).alias("score"))


# -- continuous target ---------------------------------------------------------------

def _packed(batches):
    """(y, x of every feature, rows of its complete pairs, which they are or nothing for all): runs of
    about ``RUN`` rows as packed columns, the target first."""
    held, size = [], 0

    def out():
        y, *xs = (pa.chunked_array(c) for c in zip(*(b.columns for b in held)))
        row = {"y": y}
        for i, x in enumerate(xs):
            whole = pc.and_(y.is_valid(), x.is_valid())
            n = int(pc.sum(whole).as_py() or 0)
            row |= {f"x{i}": x, f"n{i}": n, f"keep{i}": b"" if n == size else whole.to_numpy().tobytes()}
        values = [v if isinstance(v, int | bytes) else v.to_numpy().astype(float).tobytes() for v in row.values()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=list(row))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _runs(batches):
    """Columns x and y of runs of about ``RUN`` rows, given as rows (x, y) or ``_packed`` (x, y, keep)."""
    held, size = [], 0
    for batch in batches:
        if batch.num_columns == 3:
            for x, y, keep in zip(*([v.as_buffer() for v in c] for c in batch.columns)):
                run = [np.frombuffer(x), np.frombuffer(y)]
                yield [v[np.frombuffer(keep, bool)] for v in run] if keep.size else run
            continue
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= RUN:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _sampled(share: float):
    def run(batches):
        draw = np.random.default_rng([1, TaskContext.get().partitionId()])
        for x, y in _runs(batches):
            some = draw.random(len(x)) < share
            yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(y[some])], names=["x", "y"])
    return run


def _grouped(at: np.ndarray):
    """(distinct numbers, places sorted by number, first place of each)."""
    order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 65_536 else at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return sorted_at[first], order, first


def _split(at: np.ndarray):
    """(number, places) of every number in ``at``."""
    ids, order, first = _grouped(at)
    return zip(ids.tolist(), np.split(order, first[1:])) if len(ids) else ()


def _gap(v: np.ndarray, lo: int, hi: int) -> int:
    """Place in sorted ``v`` before its widest gap from place ``lo`` to ``hi``."""
    return lo + int(np.argmax(np.diff(v[lo:hi + 1]))) if hi > lo else lo


def _cut(v: np.ndarray) -> tuple[float, bool]:
    """Where to halve numbers: in the gap next to the median, so that close values stay together, else at
    the median; and whether this cuts through close values."""
    v = np.sort(v)
    half, wide = (len(v) - 1) // 2, v[-1] - v[0]
    lo = len(v) // 8
    gaps = lo + np.flatnonzero(np.diff(v[lo:len(v) - lo]) * 256 >= wide)
    if len(gaps) and wide > 0:
        at = gaps[np.argmin(np.abs(gaps - half))]
        return v[at] + (v[at + 1] - v[at]) / 2, False
    return v[half], v[len(v) * 5 // 8] - v[len(v) * 3 // 8] < wide / 4096


class Plane:
    """Layout of the points of a feature: a k-d tree whose cuts come from a sample of the points,
    with the exact rows and bounds of its leaves. Tiles are the largest nodes of at most ``cell`` points, a
    task each. Leaf ``c`` has its ``k`` neighbours within ``reach[c]``, the longer side of the smallest
    node around it with more than ``k`` rows, so a tile gets the points of its leaves' boxes
    widened by that, and no neighbour lies outside of them. ``edges`` cut either axis into buckets.
    Cuts and edges go through gaps: values that differ by noise only stay together."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: int, cell: int):
        self.cell = cell
        self.depth = max(0, math.ceil(math.log2(max(len(x), 1) / 12)))
        self.axis, self.cut = np.zeros(2 << self.depth, bool), np.full(2 << self.depth, np.inf)
        parts = {1: np.arange(len(x))}
        for _ in range(self.depth):
            below = {}
            for node, at in parts.items():
                if len(at) < 2:
                    continue
                sides = [x[at], y[at]]
                axis = int(np.ptp(sides[0]) < np.ptp(sides[1]))
                cut, close = _cut(sides[axis])
                if close and (other := _cut(sides[1 - axis])) and not other[1]:
                    axis, cut = 1 - axis, other[0]
                self.axis[node], self.cut[node] = axis, cut
                below[2 * node], below[2 * node + 1] = at[sides[axis] <= cut], at[sides[axis] > cut]
            parts = below
        buckets, self.edges = -(-n // cell), []
        for v in (np.sort(x), np.sort(y)):
            around, at = len(v) // buckets // 4, [len(v) * b // buckets for b in range(1, buckets)]
            at = [_gap(v, max(0, a - around), min(len(v) - 1, a + around)) for a in at]
            self.edges.append(np.unique([v[a] + (v[min(a + 1, len(v) - 1)] - v[a]) / 2 for a in at]))

    def leaf(self, x, y):
        out = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 16_384):  # arrays that stay in the cache
            a, b = x[lo:lo + 16_384], y[lo:lo + 16_384]
            node = np.ones(len(a), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.where(self.axis[node], b, a) > self.cut[node])
            out[lo:lo + 16_384] = node
        return out

    def bounds(self, batches):
        """(kind, number, rows, least and largest x and y): kind 2 for leaves, 0 and 1 for buckets."""
        sizes = [len(e) + 1 for e in self.edges] + [2 << self.depth]
        rows = [np.zeros(size, np.int64) for size in sizes]
        ends = [np.tile([[np.inf], [-np.inf], [np.inf], [-np.inf]], size) for size in sizes]
        for x, y in _runs(batches):
            leaf = self.leaf(x, y) - (1 << self.depth)
            ids = [*(np.searchsorted(e, v) for e, v in zip(self.edges, (x, y))), leaf]
            for kind, at in enumerate(ids):
                some, order, first = _grouped(at)
                some = some + (1 << self.depth) * (kind == 2)
                rows[kind][some] += np.diff(np.r_[first, len(order)])
                for e, (f, v) in enumerate(((np.minimum, x), (np.maximum, x), (np.minimum, y), (np.maximum, y))):
                    ends[kind][e, some] = f(ends[kind][e, some], f.reduceat(v[order], first))
        for kind, (n, end) in enumerate(zip(rows, ends)):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n[at]), *(pa.array(v[at]) for v in end)],
                names=["kind", "id", "n", "x0", "x1", "y0", "y1"])

    def known(self, rows, k: int) -> None:
        """Take in the merged bounds."""
        size, bottom = 2 << self.depth, 1 << self.depth
        n, box = np.zeros(size, np.int64), np.tile([np.inf, -np.inf, np.inf, -np.inf], (size, 1))
        self.rows = [np.zeros(len(e) + 1, np.int64) for e in self.edges]
        self.least, self.most = ([np.full(len(e) + 1, v) for e in self.edges] for v in (np.inf, -np.inf))
        for kind, at, count, *ends in rows:
            if kind == 2:
                n[at], box[at] = count, ends
            else:
                self.rows[kind][at], self.least[kind][at], self.most[kind][at] = count, ends[2 * kind], ends[2 * kind + 1]
        self.before = [np.r_[0, np.cumsum(r)] for r in self.rows]

        def upwards(v):
            for level in range(self.depth - 1, -1, -1):
                a, b = v[2 << level:4 << level:2], v[(2 << level) + 1:4 << level:2]
                v[1 << level:2 << level] = np.where(np.arange(4) % 2, np.maximum(a, b), np.minimum(a, b)) if v.ndim > 1 else a + b

        upwards(n)
        upwards(box)
        side = np.maximum(box[:, 1] - box[:, 0], box[:, 3] - box[:, 2])
        reach = np.where(n > k, side, np.inf)
        self.tile = np.arange(size)
        for level in range(1, self.depth + 1):
            at = np.arange(1 << level, 2 << level)
            reach[at] = np.where(n[at] > k, reach[at], reach[at // 2])
            whole = n[self.tile[at // 2]] <= self.cell
            self.tile[at] = np.where(whole, self.tile[at // 2], at)
        leaves = np.arange(bottom, size)
        leaves = leaves[n[leaves] > 0]
        grown = np.tile([np.inf, -np.inf, np.inf, -np.inf], (size, 1))
        # widened a little more, against rounding of the differences
        wide = reach[leaves] * (1 + 1e-9) + np.abs(box[leaves]).max(axis=1) * 1e-14
        grown[leaves] = box[leaves] + wide[:, None] * np.array([-1, 1, -1, 1])
        self.grown = grown[bottom:].copy()
        upwards(grown)
        # leaves of other tiles whose widened boxes meet a leaf
        found = []
        for lo in range(0, len(leaves), 4_096):
            at = leaves[lo:lo + 4_096]
            node = np.ones(len(at), np.int64)
            for level in range(self.depth + 1):
                if level:
                    at, node = np.repeat(at, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(at))
                b, g = box[at], grown[node]
                met = (b[:, 1] >= g[:, 0]) & (b[:, 0] <= g[:, 1]) & (b[:, 3] >= g[:, 2]) & (b[:, 2] <= g[:, 3])
                met &= self.tile[node] != self.tile[at]
                at, node = at[met], node[met]
            found.append(np.stack([at, node]))
        at, near = np.concatenate(found, axis=1) - bottom if found else np.zeros((2, 0), np.int64)
        order = np.argsort(at, kind="stable")
        self.near, self.first = near[order], np.searchsorted(at[order], np.arange(bottom + 1))
        self.tile = self.tile[bottom:].copy()

    def dealt(self, batches):
        """(tile, its own points, points around it that its own may have as neighbours)."""
        for x, y in _runs(batches):
            leaf = self.leaf(x, y) - (1 << self.depth)
            out = {t: [np.stack([x[o], y[o]]).tobytes(), b""] for t, o in _split(self.tile[leaf])}
            at = np.flatnonzero(self.first[leaf + 1] > self.first[leaf])
            for lo in range(0, len(at), 16_384):
                some = at[lo:lo + 16_384]
                first, many = self.first[leaf[some]], np.diff(self.first)[leaf[some]]
                some, start = np.repeat(some, many), np.cumsum(many) - many
                other = self.near[np.repeat(first - start, many) + np.arange(len(some))]
                g = self.grown[other]
                inside = (x[some] >= g[:, 0]) & (x[some] <= g[:, 1]) & (y[some] >= g[:, 2]) & (y[some] <= g[:, 3])
                pair = np.unique(self.tile[other[inside]] * len(x) + some[inside])
                around = pair % len(x)
                for t, o in _split(pair // len(x)):
                    rest = out.setdefault(t, [b"", b""])
                    if rest[1]:
                        yield self._dealt(t, b"", rest[1])
                    rest[1] = np.stack([x[around[o]], y[around[o]]]).tobytes()
            for t, blobs in out.items():
                yield self._dealt(t, *blobs)

    @staticmethod
    def _dealt(tile: int, own: bytes, around: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([own], pa.binary()), pa.array([around], pa.binary())], names=["tile", "own", "around"])

    def ranked(self, axis: int, e: np.ndarray):
        """Bucket of each end, values before the bucket, and values before the end (-1: ask the bucket)."""
        at = np.searchsorted(self.edges[axis], e)
        before = self.before[axis]
        return at, before[at], np.where(e < self.least[axis][at], before[at], np.where(e > self.most[axis][at], before[at + 1], -1))


def _columns(blobs: pa.ChunkedArray, width: int) -> np.ndarray:
    parts = [np.frombuffer(b).reshape(width, -1) for b in blobs.to_pylist() if b]
    return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0))


def _boxes(x: np.ndarray, y: np.ndarray, depth: int, each: int) -> np.ndarray:
    """Points of ``2 ** depth`` boxes, a column each; ``len(x)`` fills the last ones. A box is cut in
    eight or four at once by sorting: along its longer side by 256ths, inside of one along the other, so
    close values are not split on their own side."""
    size, width = len(x), each << depth
    xs, ys = np.append(x, x[:1]), np.append(y, y[:1])
    perm = np.minimum(np.arange(width), size)[None]
    bits = max(1, (width - 1).bit_length())  # of the sorted numbers, for the place
    fine = 1 << (54 - bits)
    left = depth
    while left:
        level = 3 if left > 3 else min(left, 2)
        px, py = xs[perm], ys[perm]
        x0, y0 = px.min(axis=1)[:, None], py.min(axis=1)[:, None]
        wx, wy = px.max(axis=1)[:, None] - x0, py.max(axis=1)[:, None] - y0
        tall = wx < wy
        px -= x0
        py -= y0
        px *= np.where(wx > 0, np.where(tall, fine - 1, 256) / np.where(wx > 0, wx, 1.0), 0.0)
        py *= np.where(wy > 0, np.where(tall, 256, fine - 1) / np.where(wy > 0, wy, 1.0), 0.0)
        key = px.astype(np.int64) * np.where(tall, 1, fine) + py.astype(np.int64) * np.where(tall, fine, 1)
        key[perm == size] = (1 << (63 - bits)) - 1
        key <<= bits
        key += np.arange(perm.shape[1])
        key.sort(axis=1)
        key &= (1 << bits) - 1
        perm = np.take_along_axis(perm, key, axis=1).reshape(-1, perm.shape[1] >> level)
        left -= level
    return np.ascontiguousarray(perm.T)


def _insert(best: np.ndarray, t: np.ndarray, spare: np.ndarray) -> None:
    """Take ``t`` into the smallest values ``best``, ordered along the first axis."""
    for b in best[:-1]:
        np.maximum(b, t, out=spare)
        np.minimum(b, t, out=b)
        t, spare = spare, t
    np.minimum(best[-1], t, out=best[-1])


def _far(ax, ay, bx, by):
    """Distances, and an array of that shape to write over."""
    d, spare = ax - bx, ay - by
    np.abs(d, out=d)
    np.abs(spare, out=spare)
    return np.maximum(d, spare, out=d), spare


def k_nearest(x: np.ndarray, y: np.ndarray, own: int, k: int, box: int = BOX):
    """Distance to the k-th neighbour and that neighbour for the first ``own`` points: a point first asks
    its own box, if that leaves its neighbours far away the next boxes, then all boxes that points nearer than the
    k-th found so far can lie in."""
    size = len(x)
    depth = max(0, math.ceil(math.log2(max(size, 1) / max(box, 2 * k))))
    each, count = -(-size // (1 << depth)), 1 << depth
    perm = _boxes(x, y, depth, each)
    px, py = np.append(x, np.inf)[perm], np.append(y, np.inf)[perm]
    real, mine = perm < size, perm < own
    best = np.full((k, each, count), np.inf)
    chunks = [slice(lo, lo + max(1, 8_192 // each)) for lo in range(0, count, max(1, 8_192 // each))]  # arrays that stay in the cache
    with np.errstate(invalid="ignore"):
        for s in chunks:
            bx, by = px[:, s], py[:, s]
            b = np.full((k, *bx.shape), np.inf)
            for j in range(each):
                far, spare = _far(bx, by, bx[j], by[j])
                far[j] = np.inf
                _insert(b, far, spare)
            best[:, :, s] = b
        best[:, ~real] = np.inf
        d = best[-1]
        # bounds of the boxes, and of the nodes of the tree above
        tree = [(px.min(axis=0), np.where(real, px, -np.inf).max(axis=0), py.min(axis=0), np.where(real, py, -np.inf).max(axis=0))]
        for _ in range(depth):
            tree.append(tuple(f(v[::2], v[1::2]) for f, v in zip((np.minimum, np.maximum) * 2, tree[-1])))
        x0, x1, y0, y1 = tree[0]
        flat, fx, fy = best.reshape(k, -1), px.reshape(-1), py.reshape(-1)
        win, asked = np.empty(each * count, np.int64), []

        def ask(a, b):
            """The points of boxes ``a`` ask the boxes ``b``, one after the other while they can hold nearer ones."""
            gx, gy = px[:, a], py[:, a]
            gap = np.maximum(np.maximum(x0[b] - gx, gx - x1[b]), np.maximum(y0[b] - gy, gy - y1[b]))
            np.maximum(gap, 0.0, out=gap)
            slot, pair = np.nonzero((gap < d[:, a]) & mine[:, a])
            p, b, gap = slot * count + a[pair], b[pair], gap[slot, pair]
            while len(p):
                at = np.arange(len(p))
                win[p] = at
                now = win[p] == at
                q, c = p[now], b[now]
                known = flat[:, q]
                far, spare = _far(px[:, c], py[:, c], fx[q], fy[q])
                asked.append((q, c, far.min(axis=0)))
                for j in range(each):
                    _insert(known, far[j], spare[j])
                flat[:, q] = known
                p, b, gap = p[~now], b[~now], gap[~now]
                rest = gap < flat[-1, p]
                p, b, gap = p[rest], b[rest], gap[rest]

        step = max(1, 16_384 // each)
        loose = np.where(mine, d, 0.0).max(axis=0) > LOOSE * np.maximum(x1 - x0, y1 - y0)
        for lo in range(0, count, step):
            a = lo + np.flatnonzero(loose[lo:lo + step])
            ask(a[a > 0], a[a > 0] - 1)
            ask(a[a < count - 1], a[a < count - 1] + 1)
        reach = np.where(mine, d, 0.0).max(axis=0)
        for lo in range(0, count, step):
            a = lo + np.flatnonzero(reach[lo:lo + step] > 0)
            b = np.zeros(len(a), np.int64)
            for level in range(depth, -1, -1):
                if level < depth:
                    a, b = np.repeat(a, 2), np.repeat(2 * b, 2) + np.tile([0, 1], len(a))
                u0, u1, v0, v1 = tree[level]
                met = np.maximum(np.maximum(u0[b] - x1[a], x0[a] - u1[b]), np.maximum(v0[b] - y1[a], y0[a] - v1[b])) < reach[a]
                a, b = a[met], b[met]
            other = (a != b) & ~(loose[a] & (np.abs(a - b) == 1))
            a, b = a[other], b[other]
            for first in range(0, len(a), 65_536):
                ask(a[first:first + 65_536], b[first:first + 65_536])
        # the neighbour at that distance
        near = np.full((each, count), size)
        for s in chunks:
            bx, by = px[:, s], py[:, s]
            for j in range(each):
                far, _ = _far(bx, by, bx[j], by[j])
                far[j] = np.inf
                np.copyto(near[:, s], perm[j, s], where=far == d[:, s])
        near = near.reshape(-1)
        for q, c, least in asked:
            may = least <= flat[-1, q]
            q, c = q[may], c[may]
            far, _ = _far(px[:, c], py[:, c], fx[q], fy[q])
            j, at = np.nonzero(far == flat[-1, q])
            near[q[at]] = perm[j, c[at]]
    out, at, mine = np.full(own, np.inf), np.empty(own, np.int64), mine.reshape(-1)
    to = perm.reshape(-1)[mine]
    out[to], at[to] = flat[-1][mine], near[mine]
    return out, np.append(x, np.nan)[at], np.append(y, np.nan)[at]


def _psi(m: np.ndarray) -> np.ndarray:
    x = m + 10.0
    i = 1.0 / (x * x)
    out = np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    for j in range(10):
        out -= 1.0 / (m + float(j))
    return out


_ASKED = "axis int, bucket long, tile long, vals binary, asks binary, lows binary, highs binary, across binary, psi double"
_ASKED_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.float64()]
_RANKED = "axis int, tile long, ranks binary, psi double"


def _tile(plane: Plane, k: int):
    """Neighbours of a tile's points and the intervals nearer than they are. Ends in gaps between
    buckets are counted at once, an interval in one bucket asks that bucket (``asks``: lo, hi), so does
    one with a known end (``lows``, ``highs``: other end, what is known of the count). Others ask two
    buckets (``across``: end, number of the point, inverted for the lower end)."""
    def run(group: pa.Table) -> pa.Table:
        tile = group.column("tile")[0].as_py()
        mine, around = _columns(group.column("own"), 2), _columns(group.column("around"), 2)
        own = mine.shape[1]
        point = np.concatenate([mine, around], axis=1)
        d, *ends = k_nearest(point[0], point[1], own, k)
        rows, psi = [], 0.0
        for axis, (v, at) in enumerate(zip(mine, ends)):
            lo, hi = np.where(v - at == d, at, v - d), np.where(at - v == d, at, v + d)
            lo_at, lo_base, lo_known = plane.ranked(axis, lo)
            hi_at, hi_base, hi_known = plane.ranked(axis, hi)
            ask_lo, ask_hi = lo_known < 0, hi_known < 0
            psi += _psi((hi_known - lo_known)[~ask_lo & ~ask_hi].astype(float)).sum()
            both = ask_lo & ask_hi
            same, across = np.flatnonzero(both & (lo_at == hi_at)), np.flatnonzero(both & (lo_at != hi_at))
            low, high = np.flatnonzero(ask_lo & ~ask_hi), np.flatnonzero(ask_hi & ~ask_lo)
            out = {}
            for j, (where, cols) in enumerate((
                    (np.searchsorted(plane.edges[axis], v), v[None]), (lo_at[same], np.stack([lo[same], hi[same]])),
                    (lo_at[low], np.stack([lo[low], (hi_known - lo_base)[low]])), (hi_at[high], np.stack([hi[high], (hi_base - lo_known)[high]])),
                    (np.r_[lo_at[across], hi_at[across]], np.stack([np.r_[lo[across], hi[across]], np.r_[~across, across].view(np.float64)])))):
                for bucket, o in _split(where):
                    out.setdefault(bucket, [b""] * 5)[j] = np.ascontiguousarray(cols[:, o]).tobytes()
            rows += [(axis, bucket, tile, *blobs, 0.0) for bucket, blobs in out.items()]
        rows.append((-1, -1, -1, *[b""] * 5, psi))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _ASKED_TYPES)], names=[c.split()[0] for c in _ASKED.split(", ")])
    return run


def _places(vals: np.ndarray, e: np.ndarray, side: str) -> np.ndarray:
    """``searchsorted`` by sorted ends, which finds them in the cache."""
    order = np.argsort(e)
    out = np.empty(len(e), np.int64)
    out[order] = np.searchsorted(vals, e[order], side)
    return out


def _bucket(before: list[np.ndarray]):
    """Counts of a bucket: the sum of psi of whole intervals (tile -1), and the ranks of ends of others."""
    def run(group: pa.Table) -> pa.Table:
        axis, bucket = group.column("axis")[0].as_py(), group.column("bucket")[0].as_py()
        vals = np.sort(_columns(group.column("vals"), 1)[0])
        psi = float(np.sum(group.column("psi").to_numpy()))
        lo, hi = _columns(group.column("asks"), 2)
        m = _places(vals, hi, "left") - _places(vals, lo, "right")
        closed = np.flatnonzero(lo == hi)
        m[closed] = np.searchsorted(vals, hi[closed], "right") - np.searchsorted(vals, lo[closed], "left")
        psi += _psi(m.astype(float)).sum()
        lo, most = _columns(group.column("lows"), 2)
        psi += _psi(most - _places(vals, lo, "right")).sum()
        hi, least = _columns(group.column("highs"), 2)
        psi += _psi(least + _places(vals, hi, "left")).sum()
        rows = [(-1, -1, b"", psi)]
        for tile, blob in zip(group.column("tile").to_pylist(), group.column("across").to_pylist()):
            if blob:
                e, number = np.frombuffer(blob).reshape(2, -1)
                number = number.view(np.int64)
                rank = np.where(number < 0, -_places(vals, e, "right"), _places(vals, e, "left"))
                rank += np.where(number < 0, -1, 1) * before[axis][bucket]
                rows.append((axis, tile, np.stack([np.where(number < 0, ~number, number), rank]).tobytes(), 0.0))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.float64()))], names=["axis", "tile", "ranks", "psi"])
    return run


def _across(group: pa.Table) -> pa.Table:
    """The sum of psi of a tile's intervals between buckets, from the ranks of both ends."""
    number, rank = _columns(group.column("ranks"), 2).view(np.int64)
    psi = float(np.sum(group.column("psi").to_numpy()))
    if len(number):
        m = np.zeros(number.max() + 1, np.int64)
        np.add.at(m, number, rank)
        psi += _psi(m[np.unique(number)].astype(float)).sum()
    return pa.table({"psi": pa.array([psi])})


def plane_score(q: DataFrame, k: int, cell: int = CELL, n: int | None = None) -> float | None:
    """Score of ``n`` points (x, y), rows or ``_packed`` ones; None with at most ``k`` points. They are read
    three times and shuffled once as packed columns, with the points around every tile."""
    n = q.count() if n is None else n
    if n <= k:
        return None
    some = q.mapInArrow(_sampled(max(SAMPLE / n, 1 / 512)), "x double, y double").toPandas()
    plane = Plane(some["x"].to_numpy(), some["y"].to_numpy(), n, cell)
    ends = q.mapInArrow(plane.bounds, "kind int, id long, n long, x0 double, x1 double, y0 double, y1 double")
    plane.known([tuple(r) for r in ends.groupBy("kind", "id").agg(
        F.sum("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).collect()], k)
    tasks = min(2_000, -(-n // cell) + 7)  # about a tile or bucket each: small in bytes, but long
    dealt = q.mapInArrow(plane.dealt, "tile long, own binary, around binary").repartition(tasks, "tile")
    tiles = dealt.groupBy("tile").applyInArrow(_tile(plane, k), _ASKED).repartition(tasks, "axis", "bucket")
    parts = tiles.groupBy("axis", "bucket").applyInArrow(_bucket(plane.before), _RANKED)
    psi = parts.groupBy("axis", "tile").applyInArrow(_across, "psi double").agg(F.sum("psi")).head()[0]
    at = _psi(np.array([float(n), float(k)]))
    return max(0.0, float(at.sum() - psi / n))


def continuous_scores(p: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(f, score) for a continuous ``y``; features with at most ``k`` pairs have none."""
    features = sorted(r.f for r in p.select("f").distinct().collect())
    return _score_table(p.sparkSession, {f: plane_score(p.filter(F.col("f") == f).select("x", "y"), k, cell) for f in features})


def _score_table(spark, scores: dict) -> DataFrame:
    return spark.createDataFrame([r for r in scores.items() if r[1] is not None], "f int, score double")


def _without_old_shuffles(q: DataFrame, k: int, n: int) -> float | None:
    """``plane_score``; the shuffle files of each of its jobs go when the job ends."""
    conf, name = q.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return plane_score(q, k, n=n)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _discard(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# -- the operator -------------------------------------------------------------------

def mutual_info_knn(df: DataFrame, features, target: str, classification: bool = True, neighbours: int = 3,
                    noise: bool = True, seed: int = 42, key=None) -> DataFrame:
    """STA-9: ``feature, score`` (nats) by the nearest-neighbour estimators.

    Rows with a missing feature or target leave that feature's score only;
    features without enough rows have a NULL score."""
    feats = list(features)
    require_columns(df, [*feats, target, *as_list(key)])
    if neighbours < 1:
        raise OperatorError("neighbours must be at least 1")
    if classification:
        scores = discrete_scores(cut_lineage(points(df, feats, target, True, noise, seed, key)), neighbours)
    else:
        # values are made ready once, as the noise costs more than the search; then one feature after the other
        *xs, (_, y) = _sides(df, feats, target, False, noise, seed, key)
        path = scratch_path(df.sparkSession, "knn")
        try:
            kept = "y binary" + "".join(f", x{i} binary, n{i} long, keep{i} binary" for i in range(len(feats)))
            df.select(y.alias("y"), *[x.alias(f"x{i}") for i, (_, x) in enumerate(xs)]).mapInArrow(_packed, kept).write.option("compression", "none").parquet(path)
            ready = df.sparkSession.read.schema(kept).parquet(path)
            sizes = ready.agg(*[F.sum(f"n{i}") for i in range(len(feats))]).head()
            planes = [ready.select(F.col(f"x{i}").alias("x"), "y", f"keep{i}") for i in range(len(feats))]
            scores = _score_table(df.sparkSession, {i: _without_old_shuffles(q, neighbours, sizes[i] or 0) for i, q in enumerate(planes)})
        finally:
            _discard(df.sparkSession, path)
    names = df.sparkSession.createDataFrame(list(enumerate(feats)), "n int, feature string")
    return names.join(scores, F.expr("n = f"), "left").select("feature", "score")
