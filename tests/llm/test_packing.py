import itertools
import random

import __spark_entry__ as E
from tabloom.llm.packing import optimal_boundaries, pack

SF_TINY = "/root/testdata/sf0.001"


def padding(counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in counts.items())


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        counts = {x: r.randint(1, 30) for x in r.sample(range(1, 40), r.randint(1, 9))}
        k = r.randint(1, 5)
        got = optimal_boundaries(counts, k)
        assert len(got) <= k and got[-1] == max(counts)
        lens = sorted(counts)
        best = min(padding(counts, (*some, lens[-1])) for n in range(min(k, len(lens)))
                   for some in itertools.combinations(lens[:-1], n))
        assert padding(counts, got) == best
    assert optimal_boundaries({}, 4) == []


def check(rows, sizes, max_len, budget):
    total, cells = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert 0 < r.n_tokens <= r.bucket_len <= max_len
        cells.setdefault(r.bucket_len, []).append((r.batch, r.slot))
    assert total == {k: v for k, v in sizes.items() if v}
    for length, used in cells.items():
        per = max(1, budget // length)
        assert sorted(used) == [(k // per, k % per) for k in range(len(used))]


def test_query_packs_everything(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").collect()
    rows = E.queries()["op8_packing"](spark, SF_TINY).collect()
    check(rows, {d.doc_id: len((d.text or "").split()) for d in docs}, 2048, 32768)


def test_odd_rows_and_one_hot_length(spark):
    rows = [(k, "w " * 10) for k in range(5000)] + [(6000, None), (6001, ""), (6002, "w " * 9000), (6003, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as u", "3 as sub")
    out = pack(df, max_len=64, token_budget=256, n_buckets=4).collect()
    check(out, {i: len((t or "").split()) for i, t in rows}, 64, 256)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (None, "c d e")], "doc_id long, text string")
    out = pack(df).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 3]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
