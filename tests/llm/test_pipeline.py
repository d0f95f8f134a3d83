import corpus_pipeline as P
from tabloom.llm import jaccard, line_dedup, mixing, quality_lm
from tabloom.llm.common import stored, table

SF_TINY = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = table(spark, SF_TINY, "documents")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, docs, SF_TINY), "t")
        assert after.columns == columns
        seen[name] = (docs, after)
        docs = after
    before, after = seen["quality"]
    kept = {r.doc_id for r in quality_lm.scores(before, table(spark, SF_TINY, "labels")).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["line_dedup"]
    want = {r.row.doc_id: r.kept for r in line_dedup.LineIndex(spark).insert(before).clean(before).collect()}
    assert all(want[r.doc_id] == r.text for r in after.collect())
    before, after = seen["near_duplicates"]
    want = {r.doc_id for r in jaccard.classes(before).collect() if r.doc_id == r.component_id}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = seen["mix"]
    want = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want
    packed = P.STAGES[-1][1](spark, docs, SF_TINY)
    assert packed.agg({"n_tokens": "sum"}).head()[0] == sum(got.values())


def test_run_is_reproducible(spark):
    a, b = (sorted(map(tuple, P.run(spark, SF_TINY).collect())) for _ in range(2))
    assert a and a == b


def test_clean_documents_pass(spark):
    """Rejections fall on documents labelled bad."""
    labels = {r.doc_id: r.quality for r in table(spark, SF_TINY, "labels").collect()}
    docs = table(spark, SF_TINY, "documents")
    kept = {r.doc_id for r in P.quality(spark, docs, SF_TINY).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= .97 * len(good)


def odd_folder(spark, path, rows, limit):
    """documents.parquet and labels.parquet with awkward rows among ``limit`` usual ones."""
    docs = table(spark, SF_TINY, "documents").limit(limit)
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("taken", "size", "doc", "label", "sid", "root", "key", "tkey", "batch", "kept")
    whole = docs.unionByName(odd).selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(names)])
    whole.write.parquet(f"{path}/documents.parquet")
    table(spark, SF_TINY, "labels").write.parquet(f"{path}/labels.parquet")
    return whole


def test_awkward_rows_pass_through(spark, tmp_path):
    text = " ".join("word%d" % (k % 97) for k in range(300)) + "."
    rows = [(9001, None, "en", "a", None), (9002, "", "en", "a", 0), (9003, " \n\n ", None, None, 3), (None, text, "en", "b", 1),
            (9004, text, "en", "b", 1), (9004, text, "en", "b", 1), (9004, text + " and a tail", None, None, 1), (9005, "one", "xx", "new", 3)]
    docs = odd_folder(spark, tmp_path, rows, 120)
    columns, stage_rows = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        stage_rows = stored(stage(spark, stage_rows, str(tmp_path)), "t")
        assert stage_rows.columns == columns, name
        if name == "near_duplicates":
            got = [(r.doc_id, r.text) for r in stage_rows.collect()]
            assert len(got) == len(set(got)) and len([g for g in got if g[0] == 9004]) <= 1
    packed = P.run(spark, str(tmp_path)).collect()
    assert packed and all(r.n_tokens > 0 for r in packed)
    assert not {9001, 9002, 9003} & {r.doc_id for r in packed}


def test_empty_documents(spark, tmp_path):
    docs = odd_folder(spark, tmp_path, [], 0)
    after = docs
    for _, stage in P.STAGES[:-1]:
        after = stored(stage(spark, after, str(tmp_path)), "t")
        assert after.columns == docs.columns and after.count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
