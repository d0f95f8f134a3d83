import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tabloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, min_docs=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [lower(t) for t in TERM.findall(text or "")]
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = [s for l, s in counts if l == lang]
        whole = sum((counts[lang, s] for s in groups), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q = share(whole)
        p = {s: share(counts[lang, s]) for s in groups}
        for s in groups:
            pairs = [(sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept), x) for x in groups if x != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr(
        "*", "1 as doc_id", "2 as term", "3 as n", "4 as value", "5 as at")


def sample(sources=7, seed=1):
    r = random.Random(seed)
    words = ["w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10 % 10] for k in range(90)] + ["É", "été", "Straße", "日本", "abé"]
    rows = []
    for k in range(160):
        source = "s%d" % (0 if k % 3 == 0 else r.randrange(sources))
        text = r.choice([" ", "-", "\x00", "\n", "9"]).join(r.choice(words[int(source[1:]) % 5:]).title() for _ in range(r.randint(0, 60)))
        rows.append((r.choice(["en", "de", None]), source, text))
    rows += [("en", None, "Only a few"), ("en", "quiet", None), ("fr", "one", "a b"), ("fr", "two", ""), ("xx", "alone", "x x x"),
             ("en", "Q\U0001F600", "x " * 3000), ("en", "s1", rows[0][2]), ("en", "s1", rows[0][2])]
    return rows


@pytest.mark.parametrize("sources,tile,classes", [(7, 64, 4096), (30, 4, 16)])
def test_equals_brute_force(spark, monkeypatch, sources, tile, classes):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "CLASSES", classes)
    monkeypatch.setattr(D, "HELD_TERMS", 50)
    rows = sample(sources)
    got = D.audit(frame(spark, rows)).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows)


def test_sql_and_top(spark, tmp_path):
    rows = sample(5, 3)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({D.SQL})").fetchall())
    assert want == brute(rows)
    assert sorted(tuple(r[n] for n in names) for r in D.op13_divergence(spark, str(tmp_path)).collect()) == want
    short = D.audit(frame(spark, rows), top=3).filter("part = 'term'").collect()
    assert max(r["rank"] for r in short) == 3


def test_runs_multiply():
    r = np.random.default_rng(2)
    a, b = np.sort(r.integers(0, 4, 500)), r.integers(0, 2, 500)
    ends = np.arange(1, 501)
    p, q = D.shares(a, int(a.sum()), 500), D.shares(b, int(b.sum()), 500)
    x, y = D.run_divergence(D.runs(p, ends), D.runs(q, ends))
    assert x == int(((p - q) ** 2 // q).sum()) and y == int(((p - q) ** 2 // p).sum())
    assert len(D.runs(p, ends)[0]) <= 4
    assert D.shares(np.array([10 ** 12]), 10 ** 12, 5)[0] == 1 + 10 ** 9 * (10 ** 12 + 1) // (10 ** 12 + 5)


def test_empty_table(spark):
    assert D.audit(frame(spark, [])).collect() == []
    got = D.audit(frame(spark, [("en", "a", None), ("en", None, "one two")])).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [("", "pair", "a", 0, 1), ("a", "pair", "", 0, 1)]
