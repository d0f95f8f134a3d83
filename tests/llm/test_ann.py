import math
import random

from tabloom.llm.ann import nearest


def brute(vectors, queries, k):
    best = {}
    for i, v in vectors:
        if i is not None and v and not any(x is None or math.isnan(x) or math.isinf(x) for x in v) and any(v):
            best[i] = max(best.get(i, v), v)
    out = []
    for q in sorted({i for i in queries if i in best}):
        found = sorted((-s, i) for i, v in best.items() if i != q and len(v) == len(best[q])
                       for s in [_dot(best[q], v)])
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def _dot(a, b):
    t = 0.0
    for x, y in zip(a, b):
        t += x * y
    return t


def run(spark, vectors, k, **blocks):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as dim", "3 as cb")
    got = nearest(df, df.filter("vec_id % 3 = 0"), k=k, **blocks).collect()
    want = brute(vectors, [i for i, _ in vectors if i is not None and i % 3 == 0], k)
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_random_vectors_in_small_blocks(spark):
    r = random.Random(1)
    run(spark, [(k, [r.gauss(0, 1) for _ in range(24)]) for k in range(400)], 7, query_block=30, candidate_block=64)


def test_ties_copies_and_odd_vectors(spark):
    r = random.Random(2)
    v = [(k, [float(r.randint(-2, 2)) for _ in range(6)]) for k in range(90)]
    v += [(100 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for k in range(60)]
    v += [(300, None), (303, [0.0] * 6), (306, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (309, [float("nan")] + [1.0] * 5),
          (312, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (315, [1.0, 2.0]), (316, [2.0, 1.0]), (318, []),
          (0, [3.0] * 6), (0, [3.0] * 6), (1, [-3.0] * 6), (321, [1e150] * 6), (324, [1e-300] * 6)]
    run(spark, v, 20, query_block=16, candidate_block=32)


def test_fewer_candidates_than_k(spark):
    run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (3, [0.5, 0.5])], 20)


def test_empty_table(spark):
    run(spark, [], 5)
