"""Divergence audit of the sources of each language, over run-length columns.

Every language keeps the terms that stand in at least ``min_docs`` of its
documents. A group (language and source, or a whole language) gives a kept term
the share ``p = 1 + floor(unit * (count + 1) / (N + V))`` and a group is held
against another one by ``f = floor((p - q)^2 / q)`` per term, in whole numbers.

1. Counts per (language, source, term) are summed in the tasks that read the
   texts and added up after one shuffle by term; that shuffle also serves the
   document counts.
2. The vocabulary is reordered: terms with the same counts in all sources are
   one class with a multiplicity, and classes are range-sorted by their counts,
   so that equal counts of a source lie together. Blocks of classes turn each
   source's column into runs (end position, count).
3. For a block and a pair of groups the run boundaries are intersected, and
   ``f`` of each common run is multiplied by its length. Sums over blocks are
   the pairs' values; both directions come from one intersection.
4. Terms are ranked by ``f`` against the language as a whole.

Scale: a block holds ``CLASSES`` classes and pairs are worked off in tiles of
``TILE`` by ``TILE`` sources, so a task's row is bounded whatever the vocabulary
and the number of sources; rows with equal counts cost one step, not one per
term. The report itself has one row per ordered pair of sources of a language,
as asked for. Ranks are cut to the best before their shuffle. Nothing is
collected to the driver.

Defined cases: NULL text, language and source read as ''; a document is a row,
ids play no part; texts without a term still make their group occur; a language
without kept terms gives its pairs the value 0; sums are exact for shares up to
a unit of 10^9; counts have no bound; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, stored_path, table

MIN_DOCS = 3
UNIT = 1_000_000_000
TOP = 200
CLASSES = 4096
TILE = 64
HELD_TERMS = 300_000
#: Bytes of terms: A-Z (lower-cased), a-z and all of non-ASCII characters; others separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# -- counts ----------------------------------------------------------------------

def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _strings(values: list[bytes]) -> pa.Array:
    """UTF-8 as it stands, without a check: Spark strings may hold other bytes."""
    a = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(a), a.buffers())


def _count_terms(batches):
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (counts, docs) in held.items():
            n = len(counts)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [_strings([lang] * n), _strings([source] * n), _strings(list(counts)), pa.array(counts.values(), pa.int64()),
                     pa.array([docs[t] for t in counts], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns)):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            before = len(counts)
            counts.update(found)
            docs.update(set(found))
            size += len(counts) - before
            if size > HELD_TERMS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_columns(docs: DataFrame, text: str, lang: str, source: str, min_docs: int) -> DataFrame:
    """(lang, term, total, counts): kept terms with their counts by source, sorted by source."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = d.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    by_source = (parts.repartition("lang", "term").groupBy("lang", "term", "source")
                 .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (by_source.groupBy("lang", "term")
            .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                 F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
            .filter(F.col("docs") >= min_docs).select("lang", "term", "total", "counts"))


def group_table(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, at, n, v, whole): every occurring group with its place in
    the language, its N, the language's V and N."""
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    n = (kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
         .agg(F.sum("c.n").alias("n")))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    zero = F.lit(0).cast("long")
    return (d.join(n, ["lang", "source"], "left").join(whole, "lang", "left")
            .select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
                    *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "whole")]))


# -- run-length columns ------------------------------------------------------------

def runs(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of equal neighbours; ``ends`` are the positions
    after each entry."""
    last = np.flatnonzero(np.r_[values[1:] != values[:-1], True])
    return ends[last], values[last]


def _encode(batches):
    """Blocks of sorted classes as one row of runs per source."""
    from pyspark import TaskContext
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.r_[True, langs[1:] != langs[:-1]]).tolist() + [len(langs)] if len(langs) else []
        for a, b in zip(cut[:-1], cut[1:]):
            for lo in range(a, b, CLASSES):
                part = batch.slice(lo, min(CLASSES, b - lo))
                ends = np.cumsum(part.column(2).to_numpy())
                lists = part.column(1)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                names = flat.field("source").dictionary_encode()
                codes, n = names.indices.to_numpy(), flat.field("n").to_numpy()
                order = np.argsort(codes, kind="stable")
                edges = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
                out = []
                for x, y in zip(edges[:-1], edges[1:]):
                    column = np.zeros(len(lists), np.int64)
                    column[row[order[x:y]]] = n[order[x:y]]
                    out.append(runs(column, ends))
                k = len(out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([0] * k, pa.int64())), pa.array([block] * k, pa.int64()), pa.array([int(ends[-1])] * k, pa.int64()),
                     names.dictionary, pa.array([e for e, _ in out], pa.list_(pa.int64())), pa.array([v for _, v in out], pa.list_(pa.int64()))],
                    names=["lang", "block", "size", "source", "ends", "values"])
                block += 1


def run_columns(kept: DataFrame) -> DataFrame:
    """(lang, block, size, source, ends, values): columns of the reordered vocabulary.
    Ranges are cut by the first entries of the counts, which keeps the samples that
    Spark draws for their bounds small."""
    classes = kept.groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    head = [F.get("counts", F.lit(i)) for i in range(3)]
    return (classes.repartitionByRange("lang", *head).sortWithinPartitions("lang", "counts")
            .mapInArrow(_encode, "lang string, block long, size long, source string, ends array<long>, values array<long>"))


# -- pairs -----------------------------------------------------------------------

def shares(counts: np.ndarray, n: int, v: int, unit: int = UNIT) -> np.ndarray:
    """1 + floor(unit * (count + 1) / (n + v))."""
    if len(counts) and int(counts.max()) >= 2 ** 62 // unit:
        return np.array([1 + unit * (c + 1) // (n + v) for c in counts.tolist()], np.int64)
    return 1 + unit * (counts + 1) // (n + v)


def run_divergence(a: tuple, b: tuple) -> tuple[int, int]:
    """Sums of f(a against b) and f(b against a) over the common runs of two
    columns (ends, shares)."""
    ends = np.union1d(a[0], b[0])
    length = np.diff(ends, prepend=0)
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    square = (p - q) * (p - q)
    return int((square // q * length).sum()), int((square // p * length).sum())


def _columns(groups: list, found: list | None, size: int, v: int) -> list[tuple]:
    """(place, ends, shares) of a tile's sources; one without entries is one run of zeros."""
    have = {c["at"]: c for c in found or ()}
    out = []
    for g in groups:
        c = have.get(g["at"])
        ends, values = (np.array(c["ends"], np.int64), np.array(c["values"], np.int64)) if c else (
            np.array([size], np.int64), np.zeros(1, np.int64))
        out.append((g["at"], ends, shares(values, g["n"], v)))
    return out


def _tile_sums(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            left = _columns(r["left"], r["found"], r["size"], r["v"])
            right = left if r["i"] == r["j"] else _columns(r["right"], r["other"], r["size"], r["v"])
            rows = []
            for a in left:
                for b in right:
                    if r["i"] < r["j"] or a[0] < b[0]:
                        x, y = run_divergence(a[1:], b[1:])
                        rows += [(a[0], b[0], x), (b[0], a[0], y)]
            c = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(rows), pa.string()), pa.array(c[0], pa.int32()),
                                              pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], names=["lang", "a", "b", "f"])


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) by places of the sources: divergence of a from b."""
    tile = (F.col("at") / TILE).cast("int").alias("tile")
    members = groups.groupBy("lang", tile).agg(F.first("v").alias("v"), F.collect_list(F.struct("at", "n")).alias("members"))
    found = (columns.join(groups.select("lang", "source", "at"), ["lang", "source"])
             .groupBy("lang", "block", tile).agg(F.collect_list(F.struct("at", "ends", "values")).alias("found")))
    blocks = columns.select("lang", "block", "size").distinct()
    left = members.select("lang", F.col("tile").alias("i"), "v", F.col("members").alias("left"))
    right = members.select("lang", F.col("tile").alias("j"), F.col("members").alias("right"))
    work = (left.join(right, "lang").filter("i <= j").join(blocks, "lang")
            .join(found.withColumnRenamed("tile", "i"), ["lang", "block", "i"], "left")
            .join(found.withColumnRenamed("tile", "j").withColumnRenamed("found", "other"), ["lang", "block", "j"], "left"))
    return (work.mapInArrow(_tile_sums, "lang string, a int, b int, f long")
            .groupBy("lang", "a", "b").agg(F.sum("f").alias("value")))


# -- the report --------------------------------------------------------------------

def _share(count: Column, n: Column, v: Column) -> Column:
    """``shares`` as a column, exact for any count."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", top, (n + v).cast("decimal(20,0)")).cast("long") + 1


def term_report(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Terms of each group that are more frequent there than in the language."""
    rows = (kept.select("lang", "term", "total", F.explode("counts").alias("c"))
            .select("lang", "term", "total", "c.source", F.col("c.n").alias("count"))
            .join(groups, ["lang", "source"]).filter(F.col("count") > 0)
            .select("lang", "source", F.col("term").alias("item"), _share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
                    _share(F.col("total"), F.col("whole"), F.col("v")).alias("q"))
            .filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    return ranked(rows).filter(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def pair_report(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of a group's language with the sum over all kept terms."""
    columns, _ = stored_path(run_columns(kept), "runs")
    sums = pair_sums(columns, groups)
    g = groups.select("lang", "source", F.col("at").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = g.join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    return ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                               F.coalesce("value", F.lit(0).cast("long")).alias("value")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources and the terms
    that set each source apart from its language."""
    kept, _ = stored_path(term_columns(docs, text, lang, source, min_docs), "terms")
    groups, _ = stored_path(group_table(docs, kept, lang, source), "groups")
    return pair_report(kept, groups).unionByName(term_report(kept, groups, top))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
o AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY o.lang, o.source, o.term),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS whole FROM k GROUP BY lang),
g AS (
  SELECT x.lang, x.source, coalesce(sum(c.n), 0)::BIGINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source
  GROUP BY x.lang, x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
         1 + (1000000000 * (k.total + 1)) // (v.whole + v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@register("op13_divergence", SQL)
def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))
