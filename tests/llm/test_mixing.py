import re

import __spark_entry__ as E
from tabloom.llm.mixing import mix, mixed_documents

SF_TINY, SF_SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_of(sizes, max_epochs=3, weights=(1, 2, 3)):
    """Brute force: clamp and reshare until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= max_epochs * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(max_epochs * sizes[s])
            free.discard(s)
    return target


def check(rows, docs):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + size(d.text)
    want, taken = targets_of(sizes), {}
    assert len(rows) == len(docs)
    source = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s


def test_query_meets_every_target(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    first = E.queries()["op2_mixing"](spark, SF_SMALL).collect()
    check(first, docs)
    assert sorted(first) == sorted(E.queries()["op2_mixing"](spark, SF_SMALL).collect())


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "w " * 5000, "ä"), (5, "one two", "x"),
            (6, "a b c", None), (7, "z", "z"), (None, "k l", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("u", __import__("pyspark").sql.functions.lit(1))
    out = mix(docs).collect()
    check([r for r in out], [type("D", (), dict(doc_id=a, text=b, source=c)) for a, b, c in rows])


def test_mixed_documents_repeat_rows_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").withColumnRenamed("n_chars", "size")
    plan = {r.doc_id: r.taken for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {k: v for k, v in plan.items() if v}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0 and mixed_documents(docs).count() == 0
