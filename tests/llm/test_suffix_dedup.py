import hashlib
import random

import pytest

import __spark_entry__ as E
from tabloom.llm.lcp_merge import common_prefix, front_code, front_decode, merge
from tabloom.llm.suffix_dedup import remove_repeats

SF_TINY = "/root/testdata/sf0.001"


def brute(rows, width=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for s in range(len(raw) - width + 1):
                w = raw[s:s + width]
                if w not in first or i < first[w]:
                    first[w] = i
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for s in range(len(raw) - width + 1):
                if first[raw[s:s + width]] < i:
                    gone[s:s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in df.collect()], key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").collect()
    rows = sorted([tuple(r) for r in E.queries()["op9_suffix_dedup"](spark, SF_TINY).collect()], key=str)
    assert rows == brute([(d.doc_id, d.text) for d in docs])


@pytest.mark.parametrize("options", [{}, {"run_bytes": 3000}, {"run_bytes": 5000, "hot_group": 3}])
def test_planted_cases(spark, options):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(30), text(200)
    rows = [(10 + k, text(20) + passage[:r.randint(40, 130)] + text(r.randint(0, 12))) for k in range(12)]
    rows += [(30, long), (31, long), (32, long[:300] + "X" + long[301:]), (29, long[5:]), (33, passage[40:95])]
    rows += [(40, "a" * 300), (41, "a" * 49), (42, "a" * 50), (43, "b" * 60 + "a" * 60), (44, "ab" * 80), (45, "ba" * 80)]
    rows += [(50, None), (51, ""), (None, long), (52, long + long), (53, "é" * 100), (54, "xé" + "é" * 60)]
    rows += [(60, passage + long), (60, long + passage), (60, passage + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as run", "2 as doc", "3 as start")
    assert got(remove_repeats(df, **options)) == brute(rows)


def test_very_long_text_is_taken_in_pieces(spark, monkeypatch):
    from tabloom.llm import suffix_dedup as S
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    rows = [(1, long[7_000:9_000]), (2, long), (3, "zz" + long[15_900:16_500] + "yy")]
    monkeypatch.setattr(S, "PIECE", 4096)
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_front_coded_merge():
    r = random.Random(3)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 40))) for _ in range(7)]
    coded = [front_decode(front_code(x)) for x in runs]
    assert [c[0] for c in coded] == runs
    out, last = [], b""
    for run, i, prefix in merge(coded):
        s = runs[run][i]
        assert prefix == common_prefix(last, s) or not out
        out.append(s)
        last = s
    assert out == sorted(s for x in runs for s in x)
