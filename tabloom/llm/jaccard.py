"""Exact n-gram Jaccard join and its classes.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches ``percent`` / 100; classes are the connected components of the links.

1. Every set gets a 64-bit name (from a digest of its sorted shingle hashes);
   documents with equal sets share it and are joined once.
2. Shingles are ordered rarest first. Rarity comes from a table of counts of
   fixed size (``2 ** SKETCH_BITS`` cells) summed over all documents; the order
   is the same for every set, so any counts give exact results.
3. A set's prefix (``n - ceil(percent * n / 100) + 1`` shingles) is dealt into
   index lists, sorted by set size and then by position in the set. Within a
   list a partner is skipped by its size block, and within the block from the
   position on at which the rest of the set is too short to reach the overlap.
4. Entries that may have a partner go through their lists again together with
   a parity bitmap of their set: the bits in which two bitmaps differ are at
   most the shingles in which the sets do, an exact bound that keeps nearly all
   pairs below the threshold from being compared.
5. Round one verifies each set against one partner per list, the set with the
   fewest rarer shingles in its size block (in a group of near copies their
   common original). Sets that link get one class label.
6. Round two derives the answers of a set from those of its class: only pairs
   in different classes are left to compare, and lists whose sets all share a
   label are skipped whole. Together the rounds compare every pair that could
   link and is not known to be in one class, so classes are exact, and a group
   of thousands of near copies costs a few comparisons per copy.

Scale: copies are collapsed inside each task before lists are shuffled; list
streams hold a window of rows; labels, lists and sets meet in joins. Nothing
but the count table reaches the driver.

Defined cases: NULL or empty texts and texts of white space have no shingle and
link with nothing; texts with fewer words than ``width`` have one shingle; rows
with a NULL id link with nothing and have a NULL class; repeated rows of an id
are returned one by one; an empty table gives an empty result. Other columns
are ignored by ``classes`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, release_shuffles, stored, stored_path, table
from tabloom.llm.components import components
from tabloom.llm.textbytes import shingle_sets

SKETCH_BITS = 20
SKETCH_BLOCKS = 64
WINDOW = 32
BITMAP_BITS = 1024
LONG_LIST = 4096


def set_name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n, percent: int):
    """Shingles that a partner must share with a set of ``n``: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def pair_overlap(n, m, percent: int):
    """Shared shingles at which sets of ``n`` and ``m`` link."""
    return -(-percent * (n + m) // (100 + percent))


def possible(n1, p1, n2, p2, percent: int):
    """Whether sets of ``n1 <= n2`` whose first shared shingle stands at positions
    ``p1`` and ``p2`` can link: the sizes' block and the positions' cut."""
    need = pair_overlap(n1, n2, percent)
    return (100 * n1 >= percent * n2) & (np.minimum(n1 - p1, n2 - p2) >= need)


def parity_bitmap(s: np.ndarray) -> bytes:
    """For each of ``BITMAP_BITS`` cells, whether an odd number of shingles falls in it."""
    counts = np.bincount((s & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def bitmap_allows(n1, n2, bits1, bits2, percent: int):
    """Whether bitmaps leave room for a link: sets differ in at least as many
    shingles as their bitmaps do in bits."""
    apart = np.bitwise_count(bits1 ^ bits2).sum(axis=1, dtype=np.int64)
    return n1 + n2 - apart >= 2 * pair_overlap(n1, n2, percent)


# -- sets -------------------------------------------------------------------

SCAN_SCHEMA = "doc long, tkey long, n long, sid long, bits binary, block int, cells binary"
_SCAN_NAMES = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]


def _names_and_counts(width: int):
    def rows(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids, ns, names, bits = batch.column(0).to_pylist(), [], [], []
            for s in shingle_sets(batch.column(1), width):
                ns.append(len(s))
                names.append(set_name(s) if len(s) else None)
                bits.append(parity_bitmap(s) if len(s) else None)
                np.add.at(cells, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column(2), pa.array(ns, pa.int64()), pa.array(names, pa.int64()),
                 pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_SCAN_NAMES)
        step = len(cells) // SKETCH_BLOCKS
        blocks = [zlib.compress(cells[k * step:(k + 1) * step].tobytes(), 1) for k in range(SKETCH_BLOCKS)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(SKETCH_BLOCKS, pa.int64())] * 4, pa.nulls(SKETCH_BLOCKS, pa.binary()),
             pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=_SCAN_NAMES)
    return rows


def _sum_cells(batches):
    """Per task one row per block: the cells of its rows added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(cells), np.int64)
            total[block] = total[block] + x if block in total else x.copy()
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())],
            names=["block", "cells"])


def rarity(cells: DataFrame) -> np.ndarray:
    """Class of each cell (0 rarest): 4 log2 of its count. 2 ** SKETCH_BITS bytes."""
    summed = cells.repartition(SKETCH_BLOCKS, "block").mapInArrow(_sum_cells, "block int, cells binary").collect()
    step = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in summed:
        x = np.frombuffer(zlib.decompress(r.cells), np.int64)
        out[r.block * step:(r.block + 1) * step] = np.minimum(255, 4 * np.log2(x + 1.0)).astype(np.uint8)
    return out


def _prefixes(width: int, percent: int, classes):
    """(token, sid, meta) of the prefixes, each set once per task; meta holds the
    set's size above its position."""
    def rows(batches):
        order_of, seen = classes.value, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                ids = part.column(0)
                for k, s in enumerate(shingle_sets(part.column(1), width)):
                    n = len(s)
                    if not n or not ids[k].is_valid:
                        continue
                    sid = set_name(s)
                    if sid in seen:
                        continue
                    seen.add(sid)
                    m = n - least_overlap(n, percent) + 1
                    rank = order_of[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = s[np.argsort(rank, kind="stable")[:m]]
                    out.append((first, np.full(m, sid, np.int64), (np.int64(n) << np.int64(32)) + np.arange(m)))
                if out:
                    tok, sid, meta = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(sid), pa.array(meta)],
                                                     names=["token", "sid", "meta"])
    return rows


# -- lists ------------------------------------------------------------------

def _runs(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of its run and length of its run for each row of a sorted column."""
    starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    lens = np.diff(np.r_[starts, len(tok)])
    return np.repeat(starts, lens), np.repeat(lens, lens)


def _size_blocks(start: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """First row of the size block of each row: a list's rows from one size up to
    the largest that may link with it."""
    block = start.copy()
    while True:
        over = np.flatnonzero(100 * n[block] < percent * n)
        if not len(over):
            return block
        first = np.r_[True, block[over][1:] != block[over][:-1]]
        block[over] = np.repeat(over[first], np.diff(np.r_[np.flatnonzero(first), len(over)]))


def _lists(n_columns: int, context_of, emit):
    """Walk a stream sorted by (token, meta, sid): ``emit(columns, context, long)``
    gets whole lists; a list of more than ``LONG_LIST`` entries comes in pieces
    that begin with ``context`` entries of the piece before (``context_of``)."""
    def rows(batches):
        held, context, long_list = None, 0, False
        for batch in batches:
            new = [_column(batch.column(k)) for k in range(n_columns)]
            if not len(new[0]):
                continue
            cols = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
            # one entry per set and list: copies from other tasks are neighbours
            keep = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[1][1:] != cols[1][:-1])]
            context = int(keep[:context].sum())
            cols = [c[keep] for c in cols]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                if last > context:
                    yield emit([c[:last] for c in cols], context, (cols[0][:last] == cols[0][0]) & long_list)
                held, context, long_list = [c[last:] for c in cols], 0, False
            else:
                held = cols
            if len(held[0]) - context > LONG_LIST:
                yield emit(held, context, np.ones(len(held[0]), bool))
                pick = context_of(held)
                held, context, long_list = [c[pick] for c in held], len(pick), True
        if held is not None and len(held[0]) > context:
            yield emit(held, context, np.full(len(held[0]), long_list))
    return rows


def _column(a: pa.Array) -> np.ndarray:
    """Numbers, or bitmaps as rows of 64-bit words."""
    if pa.types.is_binary(a.type):
        width = BITMAP_BITS // 64
        return np.frombuffer(b"".join(a.to_pylist()), np.uint64).reshape(-1, width)
    return a.to_numpy()


def _window_search(at, start, may, found):
    """Try the entries up to ``WINDOW`` places before and after each of ``at``;
    ``found(i, j)`` gets the hits. Entries with a hit are not tried further."""
    left = at
    for k in range(1, WINDOW + 1):
        for step in (-k, k):
            i = left[(left + step >= 0) & (left + step < len(start))]
            i = i[start[i + step] == start[i]]
            if not len(i):
                continue
            i = i[may(i, i + step)]
            if len(i):
                found(i, i + step)
                left = np.setdiff1d(left, i, assume_unique=True)


def _live_entries(percent: int):
    """Stream of lists -> the entries that may have a partner by size and position;
    lists longer than the window are passed on whole."""
    def emit(cols, context, long_list):
        start, length = _runs(cols[0])
        some = np.flatnonzero((length > 1) | long_list)
        tok, sid, meta = (c[some] for c in cols)
        live = (length[some] > WINDOW) | long_list[some]
        if len(tok):
            start, _ = _runs(tok)
            n, pos = meta >> 32, meta & 0xFFFFFFFF

            def may(i, j):
                lo, hi = np.minimum(i, j), np.maximum(i, j)
                return possible(n[lo], pos[lo], n[hi], pos[hi], percent)

            def found(i, j):
                live[i] = True
                live[j] = True

            _window_search(np.flatnonzero(~live), start, may, found)
        live &= some >= context
        return pa.RecordBatch.from_arrays([pa.array(tok[live]), pa.array(sid[live]), pa.array(meta[live])],
                                          names=["token", "sid", "meta"])

    return _lists(3, lambda held: np.arange(len(held[0]) - WINDOW, len(held[0])), emit)


def _list_partners(percent: int):
    """Stream of lists with bitmaps -> the entries (token, sid, meta, bits, partner)
    that may have a partner in the list.

    The partner to verify first is the set with the fewest rarer shingles in the
    entry's size block; where that is ruled out, the nearest possible entry.
    Entries of lists longer than the window are all passed on.
    """
    def emit(cols, context, long_list):
        start, length = _runs(cols[0])
        some = np.flatnonzero((length > 1) | long_list)
        tok, sid, meta, bits = (c[some] for c in cols)
        live = (length[some] > WINDOW) | long_list[some]
        partner = np.full(len(tok), -1)
        if len(tok):
            start, _ = _runs(tok)
            n, pos, at = meta >> 32, meta & 0xFFFFFFFF, np.arange(len(tok))

            def may(i, j):
                lo, hi = np.minimum(i, j), np.maximum(i, j)
                ok = possible(n[lo], pos[lo], n[hi], pos[hi], percent) & (i != j)
                k = np.flatnonzero(ok)
                ok[k] = bitmap_allows(n[i[k]], n[j[k]], bits[i[k]], bits[j[k]], percent)
                return ok

            def found(i, j):
                partner[i] = j
                live[i] = True
                live[j] = True

            block = _size_blocks(start, n, percent)
            order = np.lexsort((sid, pos, block))
            first = np.r_[True, block[order][1:] != block[order][:-1]]
            leader = np.empty(len(tok), np.int64)
            leader[order] = np.repeat(order[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
            led = at[may(at, leader)]
            found(led, leader[led])
            _window_search(np.flatnonzero(partner < 0), start, may, found)
        keep = live & ((some >= context) | (some == 0))
        mate = partner[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(tok[keep]), pa.array(sid[keep]), pa.array(meta[keep]), pa.array([b.tobytes() for b in bits[keep]], pa.binary()),
             pa.array(sid[np.maximum(mate, 0)] if len(sid) else sid, mask=mate < 0)], names=["token", "sid", "meta", "bits", "partner"])

    def context_of(held):
        """The leader of the last size block, and the last entries."""
        block = np.flatnonzero(100 * (held[2] >> 32) >= percent * (held[2][-1] >> 32))
        lead = block[np.lexsort((held[1][block], held[2][block] & 0xFFFFFFFF))[0]]
        return np.r_[lead, np.arange(max(lead + 1, len(held[0]) - WINDOW), len(held[0]))]

    return _lists(4, context_of, emit)


def _cross_pairs(percent: int):
    """Stream of lists (token, sid, meta, bits, label) -> all possible pairs of
    different labels."""
    def emit(cols, context, long_list):
        tok, sid, meta, bits, label = cols
        n, pos = meta >> 32, meta & 0xFFFFFFFF
        start, _ = _runs(tok)
        k, i = 1, np.arange(len(tok))
        left, right = [sid[:0]], [sid[:0]]
        while len(i):
            i = i[i - k >= start[i]]
            i = i[100 * n[i - k] >= percent * n[i]]  # sizes grow along a list: its block ends here
            c = i[label[i] != label[i - k]]
            c = c[possible(n[c - k], pos[c - k], n[c], pos[c], percent)]
            c = c[bitmap_allows(n[c], n[c - k], bits[c], bits[c - k], percent)]
            left.append(sid[c - k])
            right.append(sid[c])
            k += 1
        a, b = np.concatenate(left), np.concatenate(right)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def context_of(held):
        """All entries that later, larger sets may still link with."""
        return np.flatnonzero(100 * (held[2] >> 32) >= percent * (held[2][-1] >> 32))

    return _lists(5, context_of, emit)


# -- verification -------------------------------------------------------------

def _sets(width: int):
    """(sid, tokens) of the rows (text, sid) whose set still has that name."""
    def rows(batches):
        for batch in batches:
            sids = batch.column(1).to_pylist()
            got = [(sid, s.tobytes()) for sid, s in zip(sids, shingle_sets(batch.column(0), width))
                   if len(s) and set_name(s) == sid]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                              pa.array([g[1] for g in got], pa.binary())], names=["sid", "tokens"])
    return rows


def _linked(percent: int):
    def rows(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                hit = np.searchsorted(t, s)
                both = int((t[np.minimum(hit, len(t) - 1)] == s).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()),
                                              pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])
    return rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names that link."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")).hint("merge")
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")).hint("merge")
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_linked(percent), "a long, b long"))


# -- the join -----------------------------------------------------------------

def named_classes(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """(doc, tkey, n, sid, root, component) of every row of ``docs``: ``tkey`` is
    the xxhash64 of the text, ``root`` the set name that all of a class share."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    scan = stored(d.select("doc", "text", F.xxhash64("text").alias("tkey")).mapInArrow(_names_and_counts(width), SCAN_SCHEMA), "sets")
    named = scan.filter("block IS NULL").select("doc", "tkey", "n", "sid")
    order = spark.sparkContext.broadcast(rarity(scan.filter("block IS NOT NULL").select("block", "cells")))

    def by_list(entries, walk, schema):
        return entries.repartition("token").sortWithinPartitions("token", "meta", "sid").mapInArrow(walk(percent), schema)

    lists = d.mapInArrow(_prefixes(width, percent, order), "token long, sid long, meta long")
    entries, entries_path = stored_path(by_list(lists, _live_entries, "token long, sid long, meta long"), "entries")
    order.unpersist()
    release_shuffles(spark)
    bitmaps = (scan.filter("sid IS NOT NULL").join(entries.select("sid").distinct(), "sid", "left_semi")
               .groupBy("sid").agg(F.first("bits").alias("bits")))
    live, live_path = stored_path(
        by_list(entries.join(bitmaps.hint("merge"), "sid").select("token", "sid", "meta", "bits"), _list_partners,
                "token long, sid long, meta long, bits binary, partner long"), "lists")
    discard(spark, entries_path)
    release_shuffles(spark)

    near = stored(live.filter("partner IS NOT NULL")
                  .select(F.least("sid", "partner").alias("a"), F.greatest("sid", "partner").alias("b")).distinct(), "near")
    holder = (named.filter("doc IS NOT NULL AND sid IS NOT NULL").join(live.select("sid").distinct(), "sid", "left_semi")
              .groupBy("sid").agg(F.min("doc").alias("holder")))
    texts = d.join(holder.hint("merge"), d["doc"] == holder["holder"]).select("text", "sid")
    sets, sets_path = stored_path(texts.mapInArrow(_sets(width), "sid long, tokens binary"), "tokens")
    release_shuffles(spark)

    links = stored(verified(near, sets, percent), "links1")
    release_shuffles(spark)
    label = components(links)
    lab = (live.select("token", "sid", "meta", "bits").join(label, F.col("sid") == F.col("node"), "left")
           .select("token", "sid", "meta", "bits", F.coalesce("root", "sid").alias("label")))
    mixed_lists = (lab.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                   .filter("lo <> hi").select("token"))
    rest = stored(by_list(lab.join(mixed_lists, "token", "left_semi"), _cross_pairs, "a long, b long").distinct(), "rest")
    if rest.head(1):
        wanted = rest.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        more = stored(verified(rest, sets.join(wanted, "sid", "left_semi"), percent), "links2")
        stars = label.select(F.col("node").alias("a"), F.col("root").alias("b"))
        label = components(stars.union(more))
    discard(spark, live_path)
    discard(spark, sets_path)

    joined = (named.join(label, F.col("sid") == F.col("node"), "left")
              .withColumn("root", F.coalesce("root", "sid")).drop("node"))
    first = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("first"))
    return (joined.join(first.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left")
            .select("doc", "tkey", "n", "sid", "root", F.when(F.col("doc").isNull(), F.lit(None))
                    .when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("first")).alias("component")))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id`` (smallest id of the class) per row."""
    c = named_classes(docs, id_col, text, width, percent)
    return c.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5,
                  percent: int = 80) -> DataFrame:
    """``docs`` with one row of every class: of its rows with the smallest id, the
    one whose text has the smallest hash. Ids may repeat, with one text or several:
    rows are told apart by id and text, so a row leaves only for a row of its own
    class. Rows that repeat an id and its text count once; rows without id or
    words all stay."""
    named = named_classes(docs, id_col, text, width, percent).filter("doc IS NOT NULL AND root IS NOT NULL")
    first = named.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("doc", "tkey")).alias("stays"))
    gone = (named.join(first, F.col("root") == F.col("r")).filter("doc <> stays.doc OR tkey <> stays.tkey")
            .select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey")).distinct())
    left = docs.join(gone, (F.col(id_col) == F.col("__doc")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__tkey")), "left_anti")
    whole = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text])
    return whole.unionByName(left.filter(F.col(id_col).isNull()))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
           THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g),
r AS (
  SELECT s.doc_id, s.g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, g) AS p
  FROM s JOIN f USING (g) JOIN n USING (doc_id)),
pre AS (SELECT * FROM r WHERE p <= n - ceil(0.9 * n - 0.000001) + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 0.000001),
i AS (
  SELECT x, y, count(*) AS i FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g
  GROUP BY x, y),
l AS (
  SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = d.doc_id
"""


@register("op6_jaccard", SQL)
def op6_jaccard(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), width=3, percent=90)
