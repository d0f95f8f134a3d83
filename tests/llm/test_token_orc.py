import zlib

import numpy as np

import __spark_entry__ as E
from tabloom.llm import token_orc as T
from tabloom.llm.common import scratch_path

SF_TINY = "/root/testdata/sf0.001"


def expected(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(T.default_tokenizer())
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_text_encoding(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").collect()
    got = [tuple(r) for r in E.queries()["op4_token_orc"](spark, SF_TINY).orderBy("start").collect()]
    assert got == expected([(d.doc_id, d.text) for d in docs])


def test_odd_texts(spark):
    texts = [None, "", "   ", "a<|endoftext|>b C.D,e.", "<|EndOfText|> É́é ΣΑΣ. İx", "x y z ½ Ⅷ",
             "l'été, don't I'LL 'S", "w" * 3000, "한국어 텍스트。テスト", "a.̸b ́c", "same", "same", "🙂👍🏽 ok"]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id"), (10 ** 12, "big id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as ids")
    path = scratch_path(spark, "t")
    T.write_token_ids(docs, path)
    got = [tuple(r) for r in T.checksums(T.read_token_ids(spark, path)).orderBy("start").collect()]
    assert got == expected(rows)
    assert [r.doc_id for r in T.lookup(spark, path, [10 ** 12]).collect()] == [10 ** 12]


def test_bloom_filters_reach_the_files(spark):
    path = scratch_path(spark, "t")
    T.write_token_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path)
    from pyspark.sql import functions as F
    raw = spark.read.format("binaryFile").load(path).filter(F.col("path").endswith(".orc")).head().content
    assert raw[:3] == b"ORC"
    plan = T.lookup(spark, path, [1])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_empty_table(spark):
    path = scratch_path(spark, "t")
    T.write_token_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert T.checksums(T.read_token_ids(spark, path)).count() == 0


def test_slices_cover_all_rows():
    import pyarrow as pa
    texts = pa.array(["a" * 50, None, "", "b" * 500, "c"])
    assert list(T.text_slices(texts, 60)) == [(0, 3), (3, 4), (4, 5)]


def test_a_full_memory_forgets_rare_words_only(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(T, "MEMORY_WORDS", 60)
    e = T.WordEncoder(T.default_tokenizer())
    for k in range(12):
        text = " ".join(["hot", "words", "stay."] + [f"rare{chr(97 + k)}{chr(97 + j)}" for j in range(20)])
        ids, ends = e.encode(pa.array([text, "", "hot"]))
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[:ends[1]].tolist() == want and ends[1] == ends[2] and len(e.known) <= 60
    assert "hot" in e.known


def test_random_texts_equal_whole_text_encoding():
    import random

    import pyarrow as pa
    r = random.Random(1)
    marks = "abzAZ09.,!?;:$%&*#+=@~^_/\\(){}[]\"-'<|> é́ßΣς½²한̀⃣‍٣"
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    e = T.WordEncoder(T.default_tokenizer())
    ids, ends = e.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_letters_that_are_composed_in_lower_case_only():
    """The tokenizer composes (NFC) before it lower-cases."""
    import unicodedata

    import pyarrow as pa
    pairs = [c + chr(m) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in range(0x300, 0x370)]
    only_lower = [p for p in pairs if len(unicodedata.normalize("NFC", p)) == 2 and len(unicodedata.normalize("NFC", p.lower())) == 1]
    assert {"J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"} <= set(only_lower)
    texts = [t for p in pairs for t in (p, f"a{p}b, X.{p}1 {p}!", f"É{p} Ça.")]
    e = T.WordEncoder(T.default_tokenizer())
    assert e.by_word and e.letters
    ids, ends = e.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    e = T.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word
    texts = ["Hello  World", "", "a\nb"]
    ids, ends = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [
        x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert T.WordEncoder(T.default_tokenizer()).letters
