import math
import random
from collections import Counter

import __spark_entry__ as E
from tabloom.llm.quality_lm import filtered, scores

SF_SMALL = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"


def discounts(counts):
    n = [sum(1 for c in counts.values() if c == k) for k in range(5)]
    y = n[1] / max(n[1] + 2 * n[2], 1)
    d = [min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), .1), k) for k in (1, 2, 3)]
    return lambda c: d[min(c, 3) - 1]


def model(texts):
    """Straight interpolated modified Kneser-Ney over byte trigrams."""
    c3 = Counter()
    for t in texts:
        b = b"\n\n" + t.encode() + b"\n"
        c3.update((b[k], b[k + 1], b[k + 2]) for k in range(len(b) - 2))
    c2 = Counter(g[1:] for g in c3)
    c1 = Counter(g[1:] for g in c2)
    levels = []
    for c in (c1, c2, c3):
        d, total, back = discounts(c), Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            back[g[:-1]] += d(n)
        levels.append((c, d, total, back))

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / 256
        c, d, total, back = levels[len(g) - 1]
        if not total[g[:-1]]:
            return low
        return (max(c[g] - d(c[g]), 0) if c[g] else 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * low
    return p


def whole_order_model(texts, order):
    c = {order: Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode() + b"\n"
        c[order].update(b[k:k + order] for k in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    levels = []
    for k in range(1, order + 1):
        d, total, back = discounts(c[k]), Counter(), Counter()
        for g, n in c[k].items():
            total[g[:-1]] += n
            back[g[:-1]] += d(n)
        levels.append((c[k], d, total, back))

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / 256
        c, d, total, back = levels[len(g) - 1]
        if not total[g[:-1]]:
            return low
        return ((c[g] - d(c[g])) if c[g] else 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * low
    return p


def perplexity(p, t):
    b = b"\n\n" + (t or "").encode() + b"\n"
    logs = [math.log(p((b[k], b[k + 1], b[k + 2]))) for k in range(len(b) - 2)]
    return math.exp(-sum(logs) / len(logs))


def corpus():
    r = random.Random(8)
    words = {"en": ["the", "of", "tion", "ing", "and", "there"], "fr": ["été", "le", "eau", "oui", "ment"]}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n)) + "."
    rows = [(k, ["en", "fr"][k % 2], text(["en", "fr"][k % 2], r.randint(3, 60))) for k in range(120)]
    junk = [(200 + k, ["en", "fr"][k % 2], "".join(r.choice("#$%&XYZ09|") for _ in range(300))) for k in range(10)]
    odd = [(300, "en", None), (301, "fr", ""), (302, None, "the of"), (303, "xx", "zzz"), (None, "en", text("en", 20)),
           (5, "fr", "again " + text("fr", 9)), (304, "en", text("en", 40_000)), (305, "en", "the")]
    return rows, junk, odd


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as row", "2 as n", "3 as shard")


def test_perplexity_equals_a_plain_model(spark):
    rows, junk, odd = corpus()
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i < 60] + [(200, 0, 0), (61, 1, 1), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = rows + junk + odd
    out = scores(frame(spark, docs), labels).collect()
    assert len(out) == len(docs)
    trusted = {lang: model([t or "" for i, g, t in docs if g == lang and i is not None and i < 60]) for lang in ("en", "fr")}
    want = sorted((str(i), g or "und", len((t or "").encode()), round(perplexity(trusted[g], t), 3) if g in trusted else None)
                  for i, g, t in docs)
    got = sorted((str(r.doc_id), r.lang, r.n_bytes, round(r.perplexity, 3) if r.perplexity is not None else None) for r in out)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) <= 2e-3 * b[3])
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[i] for i, _, _ in junk)
    assert all(kept[i] for i, _, _ in rows if i != 5) and all(kept[i] for i in (300, 301, 302, 303, 304, 305))


def test_filtered_keeps_columns(spark):
    rows, junk, odd = corpus()
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i < 60], "doc_id long, quality int, toxic int")
    df = frame(spark, rows + junk + odd)
    out = filtered(df, labels)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert not set(ids) & {i for i, _, _ in junk} and len(ids) == len(rows) + len(odd)


def test_held_out_accuracy(spark):
    """The model is fitted on one half of the trusted labels, judged on the rest."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    out = {r.doc_id: r.kept for r in scores(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.filter("doc_id % 2 = 1").collect()]
    good, bad = [out[r.doc_id] for r in held if r.quality == 1], [out[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) >= .99 * len(good)
    assert sum(bad) <= .4 * len(bad)


def test_held_out_threshold_rejects_every_kind(spark):
    """Held-out labels: at most 10 % of the bad documents stay, repeated words too."""
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    out = {r.doc_id: r.kept for r in scores(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = labels.filter("doc_id % 2 = 1").join(docs, "doc_id").collect()
    good, bad = [out[r.doc_id] for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    again = lambda w: sum(a == b for a, b in zip(w, w[1:])) / len(w)
    repeated = [out[r.doc_id] for r in bad if again(r.text.split()) > .5]
    navigation = [out[r.doc_id] for r in bad if " | " in r.text]
    assert sum(good) >= .995 * len(good) and sum(out[r.doc_id] for r in bad) <= .1 * len(bad)
    assert sum(repeated) <= .05 * len(repeated) and sum(navigation) <= .2 * len(navigation)


def test_repetition_does_not_depend_on_length():
    import numpy as np
    import pyarrow as pa
    from tabloom.llm.quality_lm import _fresh, trigrams
    texts = ["abcdefgh" * 32, "", "abcdefgh" * 3200, "x" * 1000]
    g, doc = trigrams(pa.array(texts))
    fresh = _fresh(g, doc, len(texts))
    assert fresh.tolist() == [sum(len(set(g[doc == k][a:a + 256])) for a in range(0, (doc == k).sum(), 256)) for k in range(4)]
    ratio = np.bincount(doc) / fresh
    assert abs(ratio[0] / ratio[2] - 1) < .3 and ratio[3] > 5 * ratio[0]


def test_whole_order_equals_a_plain_model(spark):
    import numpy as np
    import pyarrow as pa
    from tabloom.llm import quality_lm as Q
    rows, junk, _ = corpus()
    texts = [t for _, g, t in rows if g == "fr"]
    plain = whole_order_model(texts, Q.ORDER)
    counts = Counter(Q.grams(pa.array(texts))[0].tolist())
    table = spark.createDataFrame([("fr", g, c) for g, c in counts.items()], "lang string, g long, c long")
    for shards in (3, 40):
        shard = {r.shard: Q._unpack_model(r.model) for r in Q.models(table, shards).collect()}
        assert sorted(shard) == list(range(shards))
        g = np.unique(Q.grams(pa.array([texts[0], junk[1][2], "le été eaux", "", "le le"]))[0])
        for x in g.tolist():
            want = math.log(plain(x.to_bytes(Q.ORDER, "big")))
            got = Q.log_likelihood(shard[Q.shard_of(x >> 8 & 0xFFFF, shards)], np.array([x], np.uint64))[0]
            assert abs(got - want) < 1e-4


def test_all_trusted_text_is_counted(spark):
    """A language with one trusted document has its model, however many there are."""
    many = spark.range(40_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('text ', id) AS text")
    few = spark.range(40_000, 40_012).selectExpr("id AS doc_id", "concat('x', id) AS lang", "'alone' AS text")
    docs = many.unionByName(few)
    out = scores(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert out.filter("perplexity IS NULL OR threshold IS NULL").count() == 0 and out.count() == 40_012


def test_languages_without_trusted_text_are_judged(spark):
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    es = docs.filter("lang = 'es'").select("doc_id")
    rows = scores(docs, labels.join(es, "doc_id", "left_anti")).filter("lang = 'es'").collect()
    assert rows and all(r.perplexity is None and r.score is not None and r.threshold is not None for r in rows)
    kept = {r.doc_id: r.kept for r in rows}
    held = labels.join(es, "doc_id").collect()
    good, bad = [kept[r.doc_id] for r in held if r.quality == 1], [kept[r.doc_id] for r in held if r.quality == 0]
    assert sum(good) >= .97 * len(good) and sum(bad) <= .6 * len(bad)


def test_query_returns_every_document(spark):
    df = E.queries()["op7_quality_lm"](spark, SF_SMALL)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert scores(frame(spark, []), labels).count() == 0
    out = scores(frame(spark, [(1, "en", "a b")]), labels.filter("false")).collect()
    assert [r.kept for r in out] == [True]
