"""Document quality from an interpolated modified Kneser-Ney model.

A model of byte ``ORDER``-grams per language is counted on all trusted text and
smoothed by modified Kneser-Ney: three discounts per order from the counts of
counts, continuation counts in the lower orders, full interpolation down to a
uniform distribution. Counts are aggregates; shards of the count table, cut by
the two bytes before the last, hold all orders above two with their contexts, so
each is smoothed on its own once the counts of counts and the two lowest orders
(at most 65,536 numbers per language) are added up over the shards. The number of
shards follows the counted n-grams.

Scoring is a sharded count join. Blocks of documents list their distinct n-grams
with the documents that hold them; each meets the shard of its language's model,
each shard returns the partial log likelihood of its n-grams, and a document's
parts are added up. What is shuffled grows in proportion to the text.

``perplexity`` is that of the trigram model of the same counts; the score is made
of the whole order. A document's score is its perplexity with ``prior_bytes``
bytes at the mean of its language's trusted text mixed in, so that a few odd bytes
do not sink a short text. A byte model finds repeated text easy, so the score is
multiplied by how far the document's repetition (bytes per distinct trigram of a
window of ``WINDOW`` bytes, which does not depend on its length) exceeds the
``quantile`` of trusted documents.

A document is kept up to ``slack`` times the language's ``quantile`` of held-out
trusted scores: trusted documents fall into two halves by a hash of their id, and
each is scored by a model of the other half. A language whose trusted documents
are all in one half takes their scores under their own model.

Languages without trusted text are scored by a pooled model of all trusted text.
Its threshold is held out by language: the trusted languages, in order of their
names, fall into two halves by turns, and the documents of each half are scored by
the pooled model of the other.

Trusted documents carry a trusted label (quality 1 and not toxic) and are found by
a plain join; every document meets the models of both halves, and its label is
looked up afterwards. Scores, means and quantiles cover all documents and all trusted
labels. Blocks of one group are dealt over as many tasks as there are shuffle
partitions, so a language with most rows is split.

Defined cases: NULL and empty texts are scored as an end mark alone; NULL
languages form the group ``und``; languages without trusted text have NULL
perplexity, and their documents are kept when fewer than two languages have
trusted text (no threshold can be held out; without any the score is NULL too);
rows with a NULL id are scored and kept if they pass; repeated rows are scored one
by one; very long texts are cut into blocks of their own; an empty table gives an
empty result. Other columns are ignored by ``scores`` and kept by ``filtered``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, release_shuffles, stored, stored_path, table
from tabloom.llm.textbytes import raw_bytes
from tabloom.llm.token_orc import text_slices

ORDER = 5
#: Least shards of a model, and n-grams of a shard from which there are more.
N_SHARDS = 8
SHARD_GRAMS = 1 << 20
#: Most blocks of 65,536 bits of the bitmap of trusted ids (16 MB).
MAP_BLOCKS = 2048
QUANTILE = 0.995
SLACK = 1.2
PRIOR_BYTES = 100
WINDOW = 256
BLOCK_BYTES = 1 << 20
PAD = 10


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text number) of each byte of the texts and of their end mark.

    Every text is preceded by pad bytes and followed by one, so an empty text has
    one n-gram."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + ORDER * n, PAD, np.uint64)
    padded[np.arange(len(data)) + ORDER * owner + ORDER - 1] = data
    rows = np.repeat(np.arange(n), np.diff(offsets) + 1)
    at = np.arange(len(rows)) + (ORDER - 1) * rows
    g = padded[at]
    for k in range(1, ORDER):
        g = (g << np.uint64(8)) | padded[at + k]
    return g, rows


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    g, rows = grams(texts)
    return (g & np.uint64(0xFFFFFF)).astype(np.uint32), rows


def shard_of(context, shards: int):
    """Shard of the two bytes before the last, of numpy or of columns."""
    return context * 40503 % 65521 % shards


def _trusted_counts(batches):
    """(lang, g, c): n-gram counts of a task's texts."""
    held: dict[str, list] = {}

    def merged(parts):
        u, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return u, np.bincount(i, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in set(langs):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for lo, hi in text_slices(texts, BLOCK_BYTES):
                u, c = np.unique(grams(texts.slice(lo, hi - lo))[0], return_counts=True)
                held.setdefault(lang, []).append((u, c))
            if len(held[lang]) > 16:
                held[lang] = [merged(held[lang])]
    for lang, parts in held.items():
        u, c = merged(parts)
        for lo in range(0, len(u), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[part])), pa.array(u[part].astype(np.int64)), pa.array(c[part])],
                                             names=["lang", "g", "c"])


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _count_tables(g: np.ndarray, c: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of a shard: the whole order, continuation counts of the lower
    ones down to its part of order 2, and under 0 the plain trigram counts."""
    order = np.argsort(g)
    tables = {ORDER: (g[order], c[order])}
    for k in range(ORDER - 1, 1, -1):
        tables[k] = np.unique(tables[k + 1][0] & _mask(k), return_counts=True)
    u, i = np.unique(g & _mask(3), return_inverse=True)
    tables[0] = u, np.bincount(i, c, len(u)).astype(np.int64)
    return tables


def _counts_of_counts(t: pa.Table) -> pa.Table:
    """(lang, kind, key, n) of one shard: n-grams of an order (kind, 0 for plain
    trigrams) that came 1 to 4 times, and the shard's part of order 2."""
    tables = _count_tables(t.column("g").to_numpy(), t.column("c").to_numpy())
    keys, counts = tables.pop(2)
    kinds = np.r_[np.full(len(keys), 2), np.repeat(list(tables), 4)]
    n = np.r_[counts, [(c == k).sum() for _, c in tables.values() for k in (1, 2, 3, 4)]]
    return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(n)), "kind": pa.array(kinds.astype(np.int32)),
                     "key": pa.array(np.r_[keys, np.tile([1, 2, 3, 4], len(tables))].astype(np.int64)),
                     "n": pa.array(n.astype(np.int64))})


def _discounts(n) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from counts of counts."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k) for k in (1, 2, 3)])


def _smoothed(keys, counts, d, low):
    """Probabilities of n-grams over those of their last bytes, and the contexts
    with their back-off weights."""
    context, at = np.unique(keys >> 8, return_inverse=True)
    off = d[np.minimum(counts, 3) - 1]
    total = np.bincount(at, counts, len(context))
    back = np.bincount(at, off, len(context)) / np.maximum(total, 1)
    return (counts - off) / total[at] + back[at] * low, context, back


def _lowest(t: pa.Table) -> pa.Table:
    """One binary per language: probabilities of all bigrams, then the discounts of
    the higher orders and of plain trigrams."""
    kind, key, n = (t.column(c).to_numpy() for c in ("kind", "key", "n"))

    def order(keys, counts, low):
        d = _discounts([(counts == k).sum() for k in (1, 2, 3, 4)])
        return _smoothed(keys, counts, d, low)

    at = np.flatnonzero(kind == 2)
    at = at[np.argsort(key[at])]
    k2, c2 = key[at], n[at]
    k1, c1 = np.unique(k2 & 0xFF, return_counts=True)
    p1, _, back = order(k1, c1, 1 / 256)
    low = np.full(256, back[0] / 256)
    low[k1] = p1
    p2, context, back = order(k2, c2, low[k2 & 0xFF])
    two = np.tile(low, (256, 1))
    two[context] *= back[:, None]
    two.reshape(-1)[k2] = p2
    parts = [two.reshape(-1)]
    for k in (*range(3, ORDER + 1), 0):
        found = dict(zip(key[kind == k].tolist(), n[kind == k].tolist()))
        parts.append(_discounts([found[j] for j in (1, 2, 3, 4)]))
    return pa.table({"lang": pa.array([t.column("lang")[0].as_py()]),
                     "low": pa.array([zlib.compress(np.concatenate(parts).astype("<f8").tobytes(), 1)], pa.binary())})


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


def _pack_model(counts: pa.Table, lowest: pa.Table) -> pa.Table:
    """One binary per (lang, shard): the sorted n-grams as differences, their counts
    and what ``_lowest`` tells. Counts are far smaller than smoothed numbers."""
    g, c = counts.column("g").to_numpy().astype(np.int64), counts.column("c").to_numpy().astype(np.int64)
    order = np.argsort(g)
    parts = [_planes(np.diff(g[order], prepend=0), ORDER), _planes(c[order], 8), lowest.column("low")[0].as_py()]
    blob = b"".join([np.array([len(x) for x in parts], "<i8").tobytes(), *parts])
    return pa.table({"lang": lowest.column("lang").slice(0, 1), "shard": lowest.column("shard").slice(0, 1),
                     "model": pa.array([blob], pa.binary())})


def _unpack_model(blob: bytes) -> list[np.ndarray]:
    """For each order above two its keys, log probabilities, contexts and log
    back-off weights; the plain trigrams likewise; log probabilities of all bigrams."""
    ends = 24 + np.cumsum(np.frombuffer(blob, "<i8", 3))
    keys, counts, lowest = (blob[lo:hi] for lo, hi in zip((24, *ends), ends))
    values = np.frombuffer(zlib.decompress(lowest), "<f8")
    two, d = values[:65536], values[65536:].reshape(-1, 3)
    tables = _count_tables(np.cumsum(_unplanes(keys, ORDER)), _unplanes(counts, 8))
    arrays, low_keys, low = [], np.arange(65536), two
    for at, k in enumerate((*range(3, ORDER + 1), 0)):
        if k == 0:
            low_keys, low = np.arange(65536), two
        keys, c = tables[k]
        last = keys & _mask((k or 3) - 1)
        p, context, back = _smoothed(keys, c, d[at], low[np.searchsorted(low_keys, last)])
        arrays += [keys.astype(np.uint64), _logs(p), context.astype(np.uint64), _logs(back)]
        low_keys, low = keys, p
    return [*arrays, _logs(two)]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_likelihood(model: list[np.ndarray], g: np.ndarray, plain_trigrams: bool = False) -> np.ndarray:
    """Log probability of each n-gram's last byte under one shard's model."""
    out = model[-1][(g & np.uint64(0xFFFF)).astype(np.int64)].astype(np.float64)
    for order in ((0,) if plain_trigrams else range(3, ORDER + 1)):
        keys, logs, contexts, backs = model[4 * (ORDER - 2):-1] if order == 0 else model[4 * (order - 3):4 * (order - 2)]
        own = g & np.uint64(_mask(order or 3))
        at, hit = _found(contexts, own >> np.uint64(8))
        out[hit] += backs[at[hit]]
        at, hit = _found(keys, own)
        out[hit] = logs[at[hit]]
    return out


def models(counts: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, model) of n-gram counts (lang, g, c)."""
    shard = shard_of(F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF)), shards).cast("int")
    spread, path = stored_path(counts.withColumn("shard", shard), "kn-counts")
    parts = (spread.groupBy("lang", "shard").applyInArrow(_counts_of_counts, "lang string, kind int, key long, n long")
             .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    lowest = stored(parts.groupBy("lang").applyInArrow(_lowest, "lang string, low binary"), "kn-lowest")
    everywhere = lowest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    packed = stored(spread.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard"))
                    .applyInArrow(_pack_model, "lang string, shard int, model binary"), "kn-model")
    discard(counts.sparkSession, path)
    return packed


def _planes(x: np.ndarray, n: int) -> bytes:
    """The lowest ``n`` byte planes of unsigned integers, compressed."""
    b = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.int64(n * len(x)).tobytes() + pa.compress(np.ascontiguousarray(b[:, :n].T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    b = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8).reshape(n, size // n)
    out = np.zeros((b.shape[1], 8), np.uint8)
    out[:, :n] = b.T
    return out.view("<u8").reshape(-1).astype(np.int64)


BLOCK_SCHEMA = ("grp string, shard int, salt int, kind int, model binary, row long, size int, docs array<long>, "
                "langs array<string>, fresh array<int>, grams binary, held binary, owners binary, counts binary")
_BLOCK_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
_BLOCK_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 4]


def _fresh(g: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct trigrams of each document, counted anew in every window."""
    start = np.searchsorted(doc, np.arange(n))
    windows = (np.diff(np.r_[start, len(doc)]) + WINDOW - 1) // WINDOW
    first = np.cumsum(windows) - windows
    at = first[doc] + (np.arange(len(doc)) - start[doc]) // WINDOW
    key = np.sort((at.astype(np.uint64) << np.uint64(24)) | g)  # np.unique without counts is far slower
    new = np.r_[True, key[1:] != key[:-1]]
    return np.add.reduceat(new.astype(np.int64), np.searchsorted(key, first.astype(np.uint64) << np.uint64(24)))


def _document_blocks(salts: int, shards: int):
    """Blocks of documents of one group and shard: distinct n-grams (sorted, as
    differences), in how many documents each is, these documents (as differences
    too) and its count in each. A block's first shard tells ids, languages and repetition."""
    def rows(batches):
        from pyspark import TaskContext
        row, block = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId()
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), dtype=object)
            for grp in sorted(set(groups)):
                ids, _, langs, texts = batch.filter(pa.array(groups == grp)).columns
                for lo, hi in text_slices(texts, BLOCK_BYTES):
                    g, doc = grams(texts.slice(lo, hi - lo))
                    fresh = _fresh((g & np.uint64(0xFFFFFF)).astype(np.uint32), doc, hi - lo)
                    shard = shard_of(((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64), shards)
                    block += 1
                    order = np.argsort(shard, kind="stable")
                    cut = np.searchsorted(shard[order], np.arange(shards + 1))
                    about = (ids.slice(lo, hi - lo).to_pylist(), langs.slice(lo, hi - lo).to_pylist(), fresh)
                    out = []
                    for s in range(shards):
                        pick = order[cut[s]:cut[s + 1]]
                        if not len(pick):
                            continue
                        distinct, at = np.unique(g[pick], return_inverse=True)
                        key, count = np.unique((at.astype(np.uint64) << np.uint64(32)) | doc[pick].astype(np.uint64), return_counts=True)
                        held = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(distinct))
                        delta = np.r_[distinct[:1], np.diff(distinct)]
                        owners = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                        steps = np.diff(owners, prepend=0)
                        first = np.cumsum(held) - held
                        steps[first] = owners[first]
                        out.append((grp, s, block % salts, None, None, row, hi - lo, *about, _planes(delta, ORDER), _planes(held, 4),
                                    _planes(steps, 4), _planes(count, 4)))
                        about = (None, None, None)
                    row += hi - lo
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), _BLOCK_TYPES)], names=_BLOCK_NAMES)
    return rows


PART_SCHEMA = "row long, grp string, doc long, lang string, fresh long, n double, plain double, nll double, zero double, one double, far double"
_PART_NAMES = [c.split()[0] for c in PART_SCHEMA.split(", ")]


def _score_blocks(batches):
    """Models come before the blocks of their (grp, shard, salt): the group's own
    (kind 0), those of the two halves of its trusted documents (1, 2), and the pooled
    one of the other half of the languages (3)."""
    models, of = {}, None
    for batch in batches:
        for part in (batch.slice(lo, 1) for lo in range(batch.num_rows)):
            grp, shard, salt, kind, blob, row, size = (part.column(k)[0].as_py() for k in range(7))
            if (grp, shard, salt) != of:
                models, of = {}, (grp, shard, salt)
            if blob is not None:
                models[kind] = _unpack_model(blob)
                continue
            delta, held, steps, counts = (_unplanes(part.column(k)[0].as_py(), n) for k, n in ((10, ORDER), (11, 4), (12, 4), (13, 4)))
            g = np.cumsum(delta).astype(np.uint64)
            first, total = np.cumsum(held) - held, np.cumsum(steps)
            owners = total - np.repeat(total[first] - steps[first], held)
            sums = lambda each: np.bincount(owners, -counts * np.repeat(each, held), size)
            nothing = np.full(size, np.nan)
            plain = sums(log_likelihood(models[0], g, True)) if 0 in models and grp != POOLED else nothing
            nll = [sums(log_likelihood(models[k], g)) if k in models else nothing for k in range(4)]
            n = np.bincount(owners, counts, size)
            about = [part.column(k)[0].values for k in (7, 8, 9)]  # None when not told
            here = np.arange(size) if about[0] is not None else np.flatnonzero(n)
            told = [pa.nulls(len(here), k) if a is None else a.cast(k) for a, k in zip(about, (pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(row + here), pa.array([grp] * len(here)), *told,
                                              *(pa.array(x[here]) for x in (n, plain, *nll))], names=_PART_NAMES)


#: Group of the documents of languages without trusted text.
POOLED = "p"


def _halves(trusted: DataFrame) -> DataFrame:
    return trusted.withColumn("fold", F.pmod(F.xxhash64("t", F.lit("fold")), F.lit(2)).cast("string"))


def _text_of(d: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows of ``d`` with a trusted id: a plain join, before which a bitmap of the
    ids' hashes drops most other rows, so that their texts are not shuffled. The
    bitmap has a bounded size; a fuller one only lets more rows through."""
    n = trusted.count()
    blocks = min(MAP_BLOCKS, max(1, 1 << max(0, (16 * n - 1).bit_length() - 16)))
    h = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("map")), F.lit(blocks << 16))
    bits = (trusted.select(h("t").alias("h")).groupBy(F.shiftright("h", 16).alias("b"), F.expr("CAST(h & 65535 AS int) >> 6").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS int))")).alias("bits"))
            .groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
            .select("b", F.expr("transform(sequence(0, 1023), i -> coalesce(m[i], 0L))").alias("words")))
    likely = (d.withColumn("h", h("doc")).join(F.broadcast(stored(bits, "lm-map")), F.shiftright("h", 16) == F.col("b"))
              .filter("getbit(words[CAST(h & 65535 AS int) >> 6], CAST(h & 63 AS int)) = 1").select("doc", "lang", "text"))
    return likely.join(_halves(trusted), F.col("doc") == F.col("t"))


def _grouped(d: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc, grp, lang, text): languages without trusted text are one group."""
    every = d.join(languages.select(F.col("lang").alias("kl")), F.col("lang") == F.col("kl"), "left")
    return every.select("doc", F.when(F.col("kl").isNull(), F.lit(POOLED)).otherwise(F.concat(F.lit("l"), "lang")).alias("grp"), "lang", "text")


def _count_groups(halves: DataFrame, languages: DataFrame) -> DataFrame:
    """Counts of all models: of both halves of a language's trusted documents (0, 1),
    of both together (f), of all languages (p) and of each half of them (a, b)."""
    language = F.expr("substring(lang, 2)")
    whole = halves.groupBy(F.concat(F.lit("f"), language).alias("lang"), "g").agg(F.sum("c").alias("c"))
    sides = languages.select(F.col("lang").alias("kl"), "side")
    by_side = (halves.withColumn("own", language).join(sides, F.col("own") == F.col("kl"))
               .groupBy(F.col("side").alias("lang"), "g").agg(F.sum("c").alias("c")))
    pooled = halves.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "g", "c")
    return halves.unionByName(whole).unionByName(by_side).unionByName(pooled)


def _models_by_group(model: DataFrame, languages: DataFrame) -> DataFrame:
    """(grp, shard, kind, model): the models that meet the blocks of each group."""
    of = F.substring("lang", 1, 1)
    own = (model.filter(of.isin("f", "0", "1"))
           .select(F.concat(F.lit("l"), F.expr("substring(lang, 2)")).alias("grp"), "shard",
                   F.when(of == "f", 0).when(of == "0", 1).otherwise(2).alias("kind"), "model"))
    other = languages.select(F.concat(F.lit("l"), "lang").alias("grp"), F.when(F.col("side") == "a", "b").otherwise("a").alias("other"))
    far = (model.filter("lang IN ('a', 'b')").join(other, F.col("lang") == F.col("other"))
           .select("grp", "shard", F.lit(3).alias("kind"), "model"))
    pooled = model.filter(F.col("lang") == POOLED).select(F.lit(POOLED).alias("grp"), "shard", F.lit(0).alias("kind"), "model")
    return own.unionByName(far).unionByName(pooled)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
           quantile: float = QUANTILE, slack: float = SLACK, prior_bytes: int = PRIOR_BYTES) -> DataFrame:
    """``id_col, lang, n_bytes, perplexity, score, threshold, kept`` per document.

    ``labels`` holds ``id_col, quality, toxic``.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                    F.col(text).cast("string").alias("text"))
    trusted = (labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull())
               .select(F.col(id_col).cast("long").alias("t")).distinct())
    trusted = stored(trusted, "lm-trusted")
    halves, halves_path = stored_path(_text_of(d, trusted).select(F.concat("fold", "lang").alias("lang"), "text")
                    .mapInArrow(_trusted_counts, "lang string, g long, c long")
                    .groupBy("lang", "g").agg(F.sum("c").alias("c")), "kn-halves")
    sizes = halves.groupBy(F.expr("substring(lang, 2)").alias("lang")).agg(F.count("*").alias("size"))
    turn = F.row_number().over(Window.orderBy("lang"))  # one row per language
    languages = stored(sizes.withColumn("side", F.when(turn % 2 == 0, "a").otherwise("b")), "lm-languages")
    largest = languages.agg(F.sum("size")).first()[0] or 0  # the pooled model's n-grams at most
    shards = max(N_SHARDS, -(-largest // SHARD_GRAMS))
    release_shuffles(spark)
    model = _models_by_group(models(_count_groups(halves, languages), shards), languages)
    discard(spark, halves_path)
    release_shuffles(spark)

    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    empty = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in BLOCK_SCHEMA.split(", ")[5:]]
    dealt = model.select("grp", "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "kind", "model", *empty)
    blocks = _grouped(d, languages).mapInArrow(_document_blocks(salts, shards), BLOCK_SCHEMA)
    met = (dealt.unionByName(blocks).withColumn("is_block", F.col("model").isNull())
           .repartition("grp", "shard", "salt").sortWithinPartitions("grp", "shard", "salt", "is_block")
           .drop("is_block"))
    parts = met.mapInArrow(_score_blocks, PART_SCHEMA)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    sums = ("fresh", "n", "plain", "nll", "zero", "one", "far")
    total = (parts.groupBy("row").agg(F.first("grp").alias("key"), F.max("doc").alias("doc"), F.max("lang").alias("lang"),
                                      *[F.sum(c).alias(c) for c in sums])
             .select("row", "key", "doc", "lang", "n", "fresh", *map(known, sums[2:])))
    total = stored(total, "lm-scores")

    # what the thresholds come from: a language's trusted documents, and all of them for the pooled model
    good = (total.join(_halves(trusted), F.col("doc") == F.col("t"))
            .withColumn("held", F.when(F.col("fold") == "0", F.col("one")).otherwise(F.col("zero"))))
    far = good.filter("far IS NOT NULL").withColumn("key", F.lit(POOLED))
    good = good.withColumn("is_held", F.col("held").isNotNull()).withColumn("own", F.coalesce("held", "nll"))
    good = good.unionByName(far.withColumn("is_held", F.lit(True)).withColumn("own", F.col("far")))
    held = F.col("is_held")
    cut = lambda score: F.percentile_approx(score, quantile, 10000)
    share = lambda c, n: F.sum(c) / F.sum(n)
    means = stored(good.groupBy(F.col("key").alias("mk")).agg(
        F.coalesce(share(F.when(held, F.col("own")), F.when(held, F.col("n"))), share("own", "n")).alias("mean"),
        share("n", "fresh").alias("again")), "lm-means")

    def scored(df, nll="nll"):
        """Perplexity and repetition, both with ``prior_bytes`` bytes of the language's mean."""
        lm = F.exp((F.col(nll) + prior_bytes * F.col("mean")) / (F.col("n") + prior_bytes))
        repetition = (F.col("n") + prior_bytes) / (F.col("fresh") + prior_bytes / F.col("again"))
        return (df.join(means, F.col("key") == F.col("mk"), "left").drop("mk")
                .withColumn("lm", lm).withColumn("repetition", repetition))

    def judged(df):
        return (df.join(usual, F.col("key") == F.col("uk"), "left").drop("uk")
                .withColumn("score", F.col("lm") * F.greatest(F.lit(1.0), F.col("repetition") / F.col("usual"))))

    seen = scored(good, "own")
    usual = stored(seen.groupBy(F.col("key").alias("uk")).agg(cut("repetition").alias("usual")), "lm-usual")
    limits = stored(judged(seen).groupBy(F.col("key").alias("lk"))
                    .agg((F.coalesce(cut(F.when(held, F.col("score"))), cut(F.col("score"))) * slack).alias("threshold")),
                    "lm-limits")
    out = judged(scored(total)).join(limits, F.col("key") == F.col("lk"), "left")
    return out.select(F.col("doc").alias(id_col), "lang", (F.col("n") - 1).cast("long").alias("n_bytes"),
                      F.exp(F.col("plain") / F.col("n")).alias("perplexity"), "score", "threshold",
                      F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that the model rejects (an id that stands
    on several rows goes when all of them are rejected)."""
    s = scores(docs, labels, id_col=id_col, **options)
    gone = (s.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__gone"))
            .agg(F.max("kept").alias("k")).filter(~F.col("k")).select("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


@register("op7_quality_lm")
def op7_quality_lm(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
