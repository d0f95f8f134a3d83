import hashlib
import re

import pytest

from tabloom.llm import line_dedup
from tabloom.llm.cuckoo import CuckooFilter
from tabloom.llm.line_dedup import LineIndex, deduplicated, line_key

LONG = "this line is long enough to be counted as a shared one"


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()], key=str)


ROWS = [(k, f"own line {k}\n {LONG.upper() if k % 2 else LONG} \t\nend") for k in range(7)] + [
    (20, f"{LONG}\n{LONG}\n"), (21, None), (22, ""), (23, "\n\n"), (None, LONG), (24, "x" * 200_000 + "\n" + LONG),
    (25, LONG), (25, LONG), (26, "É" * 39), (27, "É" * 40), (28, "É" * 40), (29, "É" * 40), (30, "É" * 40), (31, "É" * 40),
    (32, "é" * 40), (33, "nul \x00 " + LONG[:33]), (34, "a\r\n" + LONG + "\r\nb"), (35, LONG + "\x0b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as key", "3 as kept", "4 as n_lines")


def test_clean_equals_brute_force(spark):
    df = frame(spark, ROWS)
    assert got(LineIndex(spark).insert(df).clean(df)) == brute(ROWS)


def test_insert_and_delete_are_reversible(spark):
    index = LineIndex(spark, n_shards=4)
    a, b = ROWS[:4], ROWS[4:9]
    index.insert(frame(spark, a))
    before = sorted(map(str, index._table("counts").collect()))
    alone = got(index.clean(frame(spark, a)))
    assert alone == brute(a)
    index.insert(frame(spark, b)).insert(frame(spark, b))
    assert got(index.clean(frame(spark, a + b))) == brute(a + b)
    index.delete(frame(spark, b[3:]))
    assert got(index.clean(frame(spark, a + b[:3]))) == brute(a + b[:3])
    index.delete(frame(spark, b))
    assert sorted(map(str, index._table("counts").collect())) == before
    assert got(index.clean(frame(spark, a))) == alone
    again = LineIndex(spark, root=index.root, n_shards=4)
    assert again.version == index.version


def test_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 1)
    index = LineIndex(spark).insert(frame(spark, ROWS[:1]))
    few = index.n_shards
    index.insert(frame(spark, ROWS[1:]))
    assert index.n_shards == index._table("counts").count() > 2 * few
    assert got(index.clean(frame(spark, ROWS))) == brute(ROWS)
    index.delete(frame(spark, ROWS[4:9]))  # fewer keys keep their shards
    left = ROWS[:4] + ROWS[9:]
    assert got(LineIndex(spark, root=index.root).clean(frame(spark, left))) == brute(left)


def test_index_without_documents_drops_nothing(spark):
    df = frame(spark, ROWS)
    assert all(r.n_dropped == 0 for r in LineIndex(spark).clean(df).collect())


def test_deduplicated_keeps_columns_and_drops_emptied_documents(spark):
    df = frame(spark, ROWS + [(2, LONG)])
    out = deduplicated(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert 20 not in ids and {0, 21, 22, 23} <= set(ids)


def test_empty_table(spark):
    df = frame(spark, [])
    assert LineIndex(spark).insert(df).clean(df).count() == 0
    assert deduplicated(df).count() == 0


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    keys = [hashlib.blake2b(str(k).encode(), digest_size=16).digest() for k in range(6000)]
    f = CuckooFilter.of(keys[:3000])
    assert all(k in f for k in keys[:3000])
    assert sum(k in f for k in keys[3000:]) < 20
    for k in keys[:1500]:
        assert f.discard(k)
    assert all(k in f for k in keys[1500:3000])
    assert sum(k in f for k in keys[:1500]) < 20
    assert all(k in CuckooFilter.from_bytes(f.to_bytes()) for k in keys[1500:3000])


@pytest.mark.parametrize("line,key", [(b"short", None), ("É".encode() * 39, None)])
def test_short_lines_have_no_key(line, key):
    assert line_key(line, 40) is key
