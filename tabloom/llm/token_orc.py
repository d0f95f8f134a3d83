"""Token ids of a corpus in ORC files.

Documents are range-partitioned and sorted by id, tokenised, and written as
ORC: one file per range, ids as integer arrays (ORC's run-length encoding),
row indexes every ``row_index_stride`` rows and Bloom filters on ``doc_id``.
Files are read back by stripes in parallel; look-ups by document id skip
stripes and row groups by the min/max of the row index and the Bloom filters.

Each row holds ``doc_id, part, local_start, n_tokens, ids``: ``local_start`` is
the position of its first id within its file, so the global position is that
plus the sum of the files before it (one number per file).

Tokenising looks up every distinct word once: white space separates words
before any merge, so the ids of a text are those of its words. Texts are
processed in slices of a few MB, whatever the batch or document count.

Defined cases: NULL and empty texts hold the end id alone; NULL ids sort first;
repeated rows and ids are encoded one by one, ordered by id and text; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import register, scratch_path, table, worker_state

END_ID = 2
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Text bytes tokenised at once, and words remembered by a Python worker.
SLICE_BYTES = 4 << 20
#: An ASCII letter before marks that never belong to its token (no apostrophe).
LETTER_MARK = r"""([a-z])([-.,!?;:$%&*#+=@~^_/\\(){}\[\]"]+)"""
#: Words that are cut and lower-cased before the tokenizer: ASCII and Latin-1 letters.
#: They hold no combining mark, so its normal form C does not join letters in them.
PLAIN_WORD = "^[\\x00-\\x7FÀ-ÿ]*$"
MEMORY_WORDS = 750_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _expand(picks: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists ``values[offsets[p]:offsets[p + 1]]`` of the picks."""
    starts = offsets[picks]
    lens = offsets[picks + 1] - starts
    ends = np.concatenate([[0], np.cumsum(lens)])
    where = np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])
    return values[where], ends


class WordEncoder:
    """Ids of texts by way of their distinct words.

    A word is cut further between an ASCII letter and a mark that follows it and
    around every digit, and ASCII letters are lower-cased: the tokenizer separates
    and lower-cases there itself. Words that may hold a special token, or characters
    beyond Latin-1 letters, are left as they are: the tokenizer composes before it
    lower-cases, and some letters with a mark are composed in lower case only.

    Pieces of lower-case Latin letters go to the tokenizer's model itself, others
    through the whole tokenizer. A tokenizer that does not work by lower-case words
    (a probe tells) encodes whole texts.
    """

    PROBE = ["Hello, World.  don't: (x3) 42!\nLine two\tTAB", "L'ÉTÉ, naïve straße; ñandú über-x [a] {b} #c @d é", "the", "<|x|> y",
             "J\u030c H\u0331. T\u0308 W\u030a Y\u030a, aJ\u030c1 J\u030cJ"]
    LETTERS = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict[int, str] = {}
        self.by_word = True
        self._clear()
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(self.PROBE, add_special_tokens=False)]
        self.by_word = self._ids(self.PROBE) == whole
        self._clear()
        if not self.by_word or self.tokenizer.pre_tokenizer is None:
            return
        letters = [c for c in map(chr, range(0x61, 0x100)) if self.LETTERS.fullmatch(c)]
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        if self._ids(self.PROBE) != whole:
            self.letters = {}
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode(pa.array(texts))
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]

    def _clear(self):
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.used = np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        simple, other = [], []
        for w in words:
            (simple if self.letters and self.LETTERS.fullmatch(w) else other).append(w)
        ids, lens, model = [], [], self.tokenizer.model
        for w in simple:
            got = model.tokenize(w.translate(self.letters))
            ids += [t.id for t in got]
            lens.append(len(got))
        for lo in range(0, len(other), 10_000):
            for enc in self.tokenizer.encode_batch_fast(other[lo:lo + 10_000], add_special_tokens=False):
                got = enc.ids
                ids += got
                lens.append(len(got))
        n, words = len(self.known), simple + other
        self.known.update(zip(words, range(n, n + len(words))))
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.array(lens, np.int64))])
        self.used = np.concatenate([self.used, np.zeros(len(words), bool)])

    def _forget(self) -> None:
        """Keep the words that came again since they were learned; all go when those
        would fill half of the memory."""
        keep = np.flatnonzero(self.used)
        if len(keep) > MEMORY_WORDS // 2:
            self._clear()
            return
        words = list(self.known)  # in the order of their places
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, self.offsets = _expand(keep, self.offsets, self.ids)
        self.used = np.zeros(len(keep), bool)

    def _slots(self, words: list[str]) -> np.ndarray:
        """Places of the words; new ones are encoded. A full memory forgets first."""
        slots = np.array([self.known.get(w, -1) for w in words], np.int64)
        if len(self.known) + int((slots < 0).sum()) > MEMORY_WORDS:
            self._forget()
            slots = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(slots < 0)
        self.used[slots[slots >= 0]] = True
        if len(new):
            self._learn([words[k] for k in new])
            slots[new] = [self.known[words[k]] for k in new]
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text (without end ids)."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([0] + [len(x) for x in found])
            return np.array([i for x in found for i in x], np.int32), ends
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        per_text = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        plain = pc.replace_substring_regex(pc.ascii_lower(distinct), LETTER_MARK, r"\1 \2")
        plain = pc.replace_substring_regex(plain, r"([0-9])", r" \1 ")
        whole = pc.or_(pc.match_substring(distinct, "<|"), pc.invert(pc.match_substring_regex(distinct, PLAIN_WORD)))
        pieces = pc.ascii_split_whitespace(pc.if_else(whole, distinct, plain))
        piece_offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        piece_codes = pieces.flatten().dictionary_encode()
        slots = self._slots(piece_codes.dictionary.to_pylist())
        piece_picks = slots[piece_codes.indices.to_numpy()]
        word_ids, ends = _expand(piece_picks, self.offsets, self.ids)
        word_offsets = ends[piece_offsets]
        picks = coded.indices.to_numpy().astype(np.int64)
        ids, ends = _expand(picks, word_offsets, word_ids)
        return ids, ends[per_text]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept over its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = worker_state().setdefault("encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES):
    """Ranges (lo, hi) of rows with about ``slice_bytes`` of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + slice_bytes, side="right")))
        yield lo, hi
        lo = hi


def _encode_rows(path: str, end_id: int):
    def rows(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder, position = None, 0
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                encoder = encoder or worker_encoder(path)
                ids, offsets = encoder.encode(pc.fill_null(batch.column(1).slice(lo, hi - lo), ""))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                lens = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)),
                     pa.array(position + offsets[:-1]), pa.array(lens),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                position += int(offsets[-1])
    return rows


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                    id_col: str = "doc_id", text: str = "text", stripe_bytes: int = 64 << 20,
                    row_index_stride: int = 1000) -> None:
    """Tokenise ``docs`` and write them to ORC files at ``path`` in id order."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_encode_rows(tokenizer or default_tokenizer(), end_id), FILE_SCHEMA)
    (rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files with their global ``start``."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    per_file = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one number per file
    total, offsets = 0, []
    for part, n in sorted(per_file):
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets, "part int, base long")
    return (rows.join(F.broadcast(starts), "part")
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; stripes and row groups without them are skipped."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin(list(doc_ids)))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        offsets = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` of each document: crc32 of its ids as little-endian uint32."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


@register("op4_token_orc")
def op4_token_orc(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return checksums(read_token_ids(spark, path))
