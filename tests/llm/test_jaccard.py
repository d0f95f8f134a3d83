import random
import re

import pytest

from tabloom.llm import jaccard as J
from tabloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted([(i, len(sets[k]), None if i is None else least[root(k)]) for k, (i, _) in enumerate(rows)], key=str)


def sample(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 20 + ["w%d" % k for k in range(200)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(40)
    for g in range(12):
        base = text(r.randint(20, 150))
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "new%d" % r.randrange(10 ** 6)
            if r.random() < .3:
                w = w[:len(w) - r.randint(0, 8)]
            rows.append(" ".join(w))
    chain = text(120)
    for k in range(25):  # a chain whose ends do not link
        rows.append(" ".join(chain[k * 3:k * 3 + 100 - k]))
    rows += [" ".join(text(r.randint(0, 60)) + passage + text(r.randint(0, 60))) for _ in range(25)]
    rows += [None, "", " \n", "a b", "A  b", "a", "b a", rows[0], rows[0].upper(), "x " * 300, "x " * 400]
    ids = r.sample(range(10_000), len(rows))
    return list(zip(ids, rows)) + [(None, rows[0]), (ids[3], rows[3]), (ids[4], "other text for one id")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as n", "3 as doc", "4 as token")


@pytest.mark.parametrize("seed,width,percent,long_list", [(1, 3, 90, None), (2, 5, 80, None), (3, 2, 50, 8)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, width, percent, long_list):
    if long_list:  # the streaming of long lists, without thousands of rows
        monkeypatch.setattr(J, "LONG_LIST", long_list)
        monkeypatch.setattr(J, "WINDOW", 4)
    rows = sample(seed)
    got = J.classes(frame(spark, rows), width=width, percent=percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, width, percent)


def class_of(rows, width, percent):
    """Every row with the number of its class among the rows with id and words."""
    numbered = [(k, t) for k, (i, t) in enumerate(rows) if i is not None and WORD.search(t or "")]
    label = {k: c for k, _, c in brute(numbered, width, percent)}
    return [label.get(k) for k in range(len(rows))]


def test_one_per_class(spark):
    rows = sample(4)
    df = frame(spark, rows)
    out = J.one_per_class(df, width=5, percent=80)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    label = class_of(rows, 5, 80)
    classes = {}
    for row, c in zip(rows, label):
        classes.setdefault(c, []).append(row)
    free = classes.pop(None)
    for c, members in classes.items():  # every class keeps exactly one row, of its smallest id
        kept = [g for g in got if g in members]
        assert len(kept) == 1 and kept[0][0] == min(i for i, _ in members), c
    assert len(got) == len(classes) + len(set(free))


def test_one_per_class_with_ids_on_several_texts(spark):
    r = random.Random(9)
    word = lambda n: " ".join("v%d" % r.randrange(5000) for _ in range(n))
    a, b, c = word(80), word(80), word(80)
    rows = [(1, a), (3, a + " end"), (3, b), (7, b + " end"), (8, c), (8, c + " end"), (8, c), (None, a), (9, None), (9, ""), (9, None)]
    got = sorted([(x.doc_id, x.text) for x in J.one_per_class(frame(spark, rows)).collect()], key=str)
    of = lambda *texts: [g for g in got if g[1] in texts and g[0] is not None]
    assert of(a, a + " end") == [(1, a)]
    assert of(b, b + " end") == [(3, b)]
    assert len(of(c, c + " end")) == 1 and of(c, c + " end")[0][0] == 8
    assert [g for g in got if not g[1] or g[0] is None] == sorted([(None, a), (9, None), (9, "")], key=str)


def test_empty_table(spark):
    assert J.classes(frame(spark, [])).count() == 0
    assert J.one_per_class(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    links += [(300 + (k * 7) % 41, 300 + (k * 11) % 41) for k in range(60)]
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    got = dict(tuple(r) for r in components(df).collect())
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[100 + k] == 100 for k in range(1, 50))
    assert got[201] == 200 and 0 not in got and 7 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
