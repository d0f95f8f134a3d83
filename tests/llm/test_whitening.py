import math
import random

import numpy as np
import pytest

from tabloom.llm import whitening as W


def brute(rows, components=8, by_count=True):
    """{(id, x): [(component, n, deviation, whitened, explained)]}, by length."""
    good = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v and not any(c is None or math.isnan(c) or abs(c) >= 2 ** 52 for c in v)]
    out = []
    for dim in {len(x) for _, x in good}:
        mine = [(i, x) for i, x in good if len(x) == dim]
        fit = [x for _, x in mine] if by_count else [list(t) for t in {tuple(x) for _, x in mine}]
        n, s = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
        y = np.array([[(n * x[d] - s[d]) / n for d in range(dim)] for x in fit], np.float64)
        e, u = np.linalg.eigh(y.T @ y / n)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        for i, x in mine:
            exact = [n * a - b for a, b in zip(x, s)]
            z = np.array([v / n for v in exact]) @ u / np.sqrt(np.maximum(e, 1e-300))
            dev = sum(v * v for v in exact)
            trace = (y * y).sum() / n
            out += [(i, dim, c + 1, n, dev if dev < 2 ** 63 else None, z[c], e[c] / trace) for c in range(len(e))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as id", "2 as dim", "3 as w", "4 as component", "5 as z")


def compare(got, want, exact=1e-7):
    key = lambda r: (str(r[0]), r[2], r[1])
    want = sorted(want, key=key)
    got = sorted([(r.vec_id, r.n, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got],
                 key=lambda r: (str(r[0]), r[2], 0))
    assert len(got) == len(want)
    assert [(g[0], g[2], g[3], g[4]) for g in got] == [(w[0], w[2], w[3], w[4]) for w in want]
    for c in {w[2] for w in want}:
        a = np.array([g[5] for g in got if g[2] == c])
        b = np.array([w[5] for w in want if w[2] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < exact
        assert np.allclose([g[6] for g in got if g[2] == c], [w[6] for w in want if w[2] == c], rtol=1e-9)


def sample(n=300, dim=12, seed=1):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1 + d) for d in range(dim)]) for k in range(n)]
    rows += [(100_000 + k, rows[5][1]) for k in range(150)]  # a third of all rows
    return rows + [(200_000, None), (200_001, [None] + [1.0] * (dim - 1)), (200_002, [float("nan")] * dim), (200_003, []),
                   (200_004, [float("-inf")] + [0.0] * (dim - 1)), (200_005, [1e16] * dim)]


@pytest.mark.parametrize("weights", ["count", "one"])
def test_equals_plain_whitening(spark, weights):
    rows = sample() + [(None, [0.25] * 12), (7, [0.5] * 12)]
    got = W.whiten(frame(spark, rows), weights=weights).collect()
    want = brute(rows, by_count=weights == "count")
    compare([r for r in got if r.vec_id != 7], [w for w in want if w[0] != 7])
    assert len([r for r in got if r.vec_id == 7]) == 16
    assert all(r.identity_error < 1e-9 for r in got)


def test_slices_and_matrix_rows(spark):
    """Many partitions: the matrices of the slices add up."""
    rows = sample(6000, 10, 3)
    df = frame(spark, rows).repartition(16)
    got = W.whiten(df, components=3).collect()
    compare(got, brute(rows, 3))


def test_lengths_are_whitened_apart(spark):
    rows = [(k, v) for k, v in sample(80, 3, 2) if k < 1000] + [(500 + k, v) for k, v in sample(60, 5, 4) if k < 1000]
    got, want = W.whiten(frame(spark, rows)).collect(), brute(rows)
    for lo, hi in ((0, 500), (500, 1000)):
        compare([g for g in got if lo <= g.vec_id < hi], [w for w in want if lo <= w[0] < hi])


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2 ** 40 + 3 * k), -float(2 ** 45) * (k % 7), 0.001 * k]) for k in range(50)]
    got = W.whiten(frame(spark, rows)).collect()
    want = {(w[0], w[2]): w[4] for w in brute(rows)}
    assert {(r.vec_id, r.component): r.deviation for r in got} == want
    assert None in want.values()


def test_no_variance(spark):
    got = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 2, 0, 0.0, 0.0, 1.0), (2, 2, 0, 0.0, 0.0, 1.0)}
    flat = W.whiten(frame(spark, [(k, [float(k), 3.0]) for k in range(9)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0}
    assert all(abs(r.explained - 1) < 1e-12 for r in flat if r.component == 1)


def test_empty_table(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_query(spark, tmp_path):
    rows = sample(200, 9, 6)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    compare(W.op12_whitening(spark, str(tmp_path)).collect(), brute(rows))
