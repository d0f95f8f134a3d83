"""Removal of byte passages that also start in an earlier document.

A byte goes when a ``WIDTH``-byte string that covers it also starts in a
document with a smaller id. Every window of that width is named by its anchor,
the position of the least hash among its ``GRAM``-byte strings, so equal
windows have equal anchors; consecutive windows with one anchor form a stretch.

1. Documents are dealt into runs by a hash of their id. Each run sends the
   sorted keys of its anchors and of its whole stretches, coded as differences,
   with counts and smallest ids; ranges of keys merge them and answer each run
   with the keys that occur twice or more.
2. A stretch whose like stands in a smaller document is removed whole. Only the
   first document of a stretch whose anchor has other stretches too is left to
   compare: the suffix at the anchor, up to the stretch's end, is what is sorted.
3. Runs of sorted suffixes are front-coded and exchanged by splitters, and each
   range merges its runs with a loser tree that keeps known common prefixes. The
   prefixes it puts out delimit the suffixes of one anchor; their windows are
   compared inside the group, and those seen in a smaller document are removed.

Scale: a key occurs once per run whatever the number of copies. Anchors with
more than ``hot_group`` stretches (a passage in a third of all documents) are
not sorted in one task: their windows are aggregated by content in a shuffle of
their own. Runs and ranges hold about ``run_bytes`` of text each. Only the
splitters and the total size reach the driver.

Windows and stretches are compared by 64-bit hashes within an anchor's group
(128 bits for hot anchors).

Defined cases: NULL or empty texts have no byte; rows with a NULL id are
returned unchanged and are no source; rows that repeat an id are cleaned one by
one and do not remove each other; an empty table gives an empty result; texts
of any length are taken in pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, release_shuffles, scratch_path, table
from tabloom.llm.lcp_merge import front_code, front_decode, merge
from tabloom.llm.textbytes import _BYTE, SLICE_BYTES, mixed, powers, raw_bytes
from tabloom.llm.token_orc import text_slices

WIDTH = 50
GRAM = 20
LEFT = WIDTH - GRAM
RUN_BYTES = 8 << 20
HOT_GROUP = 50_000
MAX_RANGES = 1 << 16  # splitters that the driver holds; beyond 512 GB of text ranges grow
PIECE = SLICE_BYTES // 2
_LOW = np.uint64(0xFFFFFFFF)


# -- anchors ------------------------------------------------------------------

def _piece_stretches(data: np.ndarray, lengths: np.ndarray):
    """Stretches of one piece; ``lengths[s]`` is the end of the text that byte s
    belongs to. Returns anchor, first window, last window, gram and stretch keys."""
    n = len(data)
    if n < WIDTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * inv[:n - GRAM + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < LEFT + 1:
        step = min(span, LEFT + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    s = np.flatnonzero(np.arange(len(least)) + WIDTH <= lengths[:len(least)])
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    a = (least[s] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)])
    lo, hi = s[first], s[np.r_[first[1:] - 1, len(s) - 1]]
    end = hi + WIDTH
    whole = mixed((total[end] - total[lo]) * inv[lo] + (end - lo).astype(np.uint64))
    # an anchor's hash is the least of many: mixed once more, its keys fill all ranges alike
    return a[first], lo, hi, mixed(grams[a[first]]) >> np.uint64(16), whole


def stretches(texts: pa.Array):
    """For slices of the texts: (first row, bytes, offsets, row, anchor, first
    window, last window, gram key of 48 bits, stretch key of 64 bits)."""
    for x, y in text_slices(texts, SLICE_BYTES // 2):
        data, offsets = raw_bytes(texts.slice(x, y - x))
        ends = np.repeat(offsets[1:], np.diff(offsets))
        parts = []
        for at in range(0, max(len(data), 1), PIECE):
            stop = min(len(data), at + PIECE + WIDTH - 1)
            a, lo, hi, g, w = _piece_stretches(data[at:stop], np.minimum(ends[at:stop], stop) - at)
            parts.append((a + at, lo + at, hi + at, g, w))
        a, lo, hi, g, w = (np.concatenate(c) for c in zip(*parts))
        yield x, data, offsets, np.searchsorted(offsets, lo, side="right") - 1, a, lo, hi, g, w


# -- exchange of keys -----------------------------------------------------------

def _pack_numbers(x: np.ndarray, raw: int) -> bytes:
    """Unsigned integers as byte planes: the ``raw`` low ones as they are, the
    rest compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def _unpack_numbers(blob: bytes, n: int, raw: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    out[:raw] = np.frombuffer(blob, np.uint8, raw * n).reshape(raw, n)
    out[raw:] = np.frombuffer(zlib.decompress(blob[raw * n:]), np.uint8).reshape(8 - raw, n)
    return np.ascontiguousarray(out.T).view("<u8").reshape(-1).astype(np.uint64)


def _pack_keys(keys, counts, docs) -> bytes:
    """Sorted keys as differences, counts, and ids as distances from the least."""
    base = docs.min() if len(docs) else np.int64(0)
    k = _pack_numbers(np.r_[keys[:1], np.diff(keys)], 3)
    c = _pack_numbers(counts, 0)
    d = _pack_numbers((docs - base).astype(np.uint64), 1)
    return np.array([len(keys), len(k), len(c), base], "<i8").tobytes() + k + c + d


def _unpack_keys(blob: bytes):
    n, a, b, base = np.frombuffer(blob, "<i8", 4)
    keys = np.cumsum(_unpack_numbers(blob[32:32 + a], n, 3), dtype=np.uint64)
    counts = _unpack_numbers(blob[32 + a:32 + a + b], n, 0).astype(np.int64)
    docs = _unpack_numbers(blob[32 + a + b:], n, 1).astype(np.int64) + base
    return keys, counts, docs


def _summed(keys, counts, docs):
    """Distinct keys with the sum of their counts and their smallest id."""
    order = np.argsort(keys, kind="stable")
    keys, counts, docs = keys[order], counts[order], docs[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, counts, docs
    return keys[first], np.add.reduceat(counts, first), np.minimum.reduceat(docs, first)


KEY_SCHEMA = "kind int, part int, run int, keys binary"
GRAMS, WHOLES = 0, 1
_BITS = {GRAMS: 48, WHOLES: 64}


def _send_keys(n_parts: int):
    def rows(group: pa.Table) -> pa.Table:
        run = group.column("run")[0].as_py()
        docs = group.column("doc").to_numpy()
        found: dict[int, list] = {GRAMS: [], WHOLES: []}
        for x, _, _, row, _, _, _, gram, whole in stretches(group.column("text").combine_chunks()):
            d, one = docs[x + row], np.ones(len(row), np.int64)
            found[GRAMS].append(_summed(gram, one, d))
            found[WHOLES].append(_summed(whole, one, d))
        out = []
        for kind, parts in found.items():
            keys, counts, least = _summed(*(np.concatenate(c) for c in zip(*parts)))
            part = _part_of(keys, kind, n_parts)
            cut = np.searchsorted(part, np.arange(n_parts + 1))
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                out.append((kind, int(k), run, _pack_keys(keys[s], counts[s], least[s])))
        return _key_table(out)
    return rows


def _part_of(keys: np.ndarray, kind: int, n_parts: int) -> np.ndarray:
    high = keys >> np.uint64(_BITS[kind] - 32)
    return ((high * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)


def _key_table(out: list[tuple]) -> pa.Table:
    c = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()),
                     pa.array(c[3], pa.binary())], names=["kind", "part", "run", "keys"])


def _answer_keys(group: pa.Table) -> pa.Table:
    """Merge a range's keys and answer each run with those that occur again."""
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    runs = group.column("run").to_pylist()
    parts = [_unpack_keys(b) for b in group.column("keys").to_pylist()]
    keys, counts, docs = _summed(*(np.concatenate(c) for c in zip(*parts)))
    again = counts > 1
    keys, counts, docs = keys[again], counts[again], docs[again]
    out = []
    for run, (k, _, _) in zip(runs, parts):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            at = at[keys[at] == k]
            if len(at):
                out.append((kind, part, run, _pack_keys(keys[at], counts[at], docs[at])))
    return _key_table(out)


# -- stretches ------------------------------------------------------------------

PART_SCHEMA = "kind int, part int, doc long, tkey long, start long, stop long, w1 long, w2 long, suffixes binary"
_PART_TYPES = [pa.int32(), pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
_PART_NAMES = [c.split()[0] for c in PART_SCHEMA.split(", ")]
SPAN, SUFFIX, WINDOW = 0, 1, 2


def _part_table(chunks: list[dict]) -> pa.Table:
    tables = []
    for c in chunks:
        n = len(next(iter(c.values())))
        tables.append(pa.table([c[name] if isinstance(c.get(name), pa.Array) else pa.array(c[name], kind) if name in c
                                else pa.nulls(n, kind) for name, kind in zip(_PART_NAMES, _PART_TYPES)], names=_PART_NAMES))
    schema = pa.schema(list(zip(_PART_NAMES, _PART_TYPES)))
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _spans(doc, tkey, start, stop) -> dict:
    """Overlapping and adjacent spans of each (doc, tkey) as one."""
    order = np.lexsort((start, tkey, doc))
    doc, tkey, start, stop = doc[order], tkey[order], start[order], stop[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])] if len(doc) else np.zeros(0, bool)
    group = np.cumsum(new)
    reach = np.maximum.accumulate(stop + group * (1 << 40)) - group * (1 << 40) if len(doc) else stop
    begin = np.flatnonzero(new | np.r_[True, start[1:] > reach[:-1]]) if len(doc) else np.zeros(0, np.int64)
    end = np.r_[begin[1:] - 1, len(doc) - 1] if len(doc) else begin
    return {"kind": np.full(len(begin), SPAN, np.int32), "doc": doc[begin], "tkey": tkey[begin],
            "start": start[begin], "stop": reach[end]}


def _lookup(keys, values, default, wanted):
    if not len(keys):
        return np.broadcast_to(default, len(wanted)).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _known(answers: pa.Table, kind: int):
    blobs = [b for k, b in zip(answers.column("kind").to_pylist(), answers.column("keys").to_pylist()) if k == kind]
    if not blobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(*(np.concatenate(c) for c in zip(*map(_unpack_keys, blobs))))


def _judge_stretches(splitters: list[int], hot_group: int):
    """Spans that are removed whole, and the suffixes left to compare."""
    bounds = np.array(splitters, np.int64)

    def rows(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return _part_table([])
        docs, tkeys = group.column("doc").to_numpy(), group.column("tkey").to_numpy()
        g_keys, g_count, _ = _known(answers, GRAMS)
        w_keys, w_count, w_doc = _known(answers, WHOLES)
        spans, chunks, strings = [], [], []
        for x, data, offsets, row, a, lo, hi, gram, whole in stretches(group.column("text").combine_chunks()):
            n_gram = _lookup(g_keys, g_count, 1, gram)
            pick = np.flatnonzero(n_gram > 1)
            row, a, lo, hi, whole, n_gram = row[pick], a[pick], lo[pick], hi[pick], whole[pick], n_gram[pick]
            doc, tkey, base = docs[x + row], tkeys[x + row], offsets[row]
            least = np.minimum(_lookup(w_keys, w_doc, np.iinfo(np.int64).max, whole), doc)
            gone = least < doc
            spans.append((doc[gone], tkey[gone], (lo - base)[gone], (hi + WIDTH - base)[gone]))
            left = np.flatnonzero(~gone & (n_gram > _lookup(w_keys, w_count, 1, whole)))
            hot = left[n_gram[left] > hot_group]
            if len(hot):
                chunks.append(_hot_windows(data, doc[hot], tkey[hot], base[hot], lo[hot], hi[hot]))
            raw = data.tobytes()
            for i in left[n_gram[left] <= hot_group]:
                strings.append((raw[a[i]:hi[i] + WIDTH], raw[lo[i]:a[i]], int(doc[i]), int(tkey[i]), int(a[i] - base[i])))
        chunks.append(_spans(*(np.concatenate(c) for c in zip(*spans))))
        if strings:
            chunks.append(_suffix_runs(strings, bounds))
        return _part_table([c for c in chunks if len(c["kind"])])
    return rows


def _suffix_runs(strings: list[tuple], bounds: np.ndarray) -> dict:
    """One front-coded sorted run per range of the splitters. Stretches of one
    document that are alike are sent once: they are removed alike or not at all."""
    strings.sort(key=lambda s: s[0])
    head = np.array([int.from_bytes(s[0][:6], "big") for s in strings], np.int64)
    part = np.searchsorted(bounds, head, side="right")
    cut = np.searchsorted(part, np.arange(len(bounds) + 2))
    parts, blobs = [], []
    for k in np.flatnonzero(np.diff(cut)):
        some = strings[cut[k]:cut[k + 1]]
        code = front_code([s[0] for s in some])
        left = zlib.compress(bytes(len(s[1]) for s in some) + b"".join(s[1] for s in some), 1)
        numbers = zlib.compress(np.array([s[2:] for s in some], "<i8").T.tobytes(), 1)
        parts.append(int(k))
        blobs.append(np.array([len(some), len(code), len(left)], "<i8").tobytes() + code + left + numbers)
    return {"kind": np.full(len(parts), SUFFIX, np.int32), "part": np.array(parts, np.int32), "suffixes": pa.array(blobs, pa.binary())}


def _hot_windows(data, doc, tkey, base, lo, hi) -> dict:
    """Every window of the stretches of hot anchors, by a 128-bit digest."""
    import hashlib
    raw, out = data.tobytes(), []
    for d, t, b, x, y in zip(doc.tolist(), tkey.tolist(), base.tolist(), lo.tolist(), hi.tolist()):
        for s in range(x, y + 1):
            h = hashlib.blake2b(raw[s:s + WIDTH], digest_size=16).digest()
            out.append((d, t, s - b, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
    c = np.array(out, np.int64).T
    return {"kind": np.full(len(out), WINDOW, np.int32), "doc": c[0], "tkey": c[1], "start": c[2], "stop": c[2] + WIDTH,
            "w1": c[3], "w2": c[4]}


# -- merge ------------------------------------------------------------------------

def _decode_run(blob: bytes):
    n, a, b = np.frombuffer(blob, "<i8", 3)
    at = 24
    strings, lcps = front_decode(blob[at:at + a])
    left = zlib.decompress(blob[at + a:at + a + b])
    lens = left[:n]
    ends = np.cumsum(np.frombuffer(lens, np.uint8).astype(np.int64)) + n
    lefts = [left[e - k:e] for e, k in zip(ends.tolist(), lens)]
    numbers = np.frombuffer(zlib.decompress(blob[at + a + b:]), "<i8").reshape(3, n)
    return strings, lcps, lefts, numbers


def _merge_suffixes(group: pa.Table) -> pa.Table:
    """Merge the runs of a range; windows of one anchor's suffixes that a smaller
    document has are removed."""
    runs = [_decode_run(b) for b in group.column("suffixes").to_pylist()]
    held, groups, out, current = [], [], [], -1
    for run, i, prefix in merge([r[:2] for r in runs]):
        if prefix < GRAM:
            if len(held) > 10_000:
                out.append(_compare(runs, held, groups))
                held, groups = [], []
            current += 1
        held.append((run, i))
        groups.append(current)
    if held:
        out.append(_compare(runs, held, groups))
    return _part_table([c for c in out if len(c["kind"])])


def _compare(runs, held, groups) -> dict:
    """Spans of the windows that stand in a smaller document of their group."""
    n = len(held)
    numbers = np.array([runs[r][3][:, i] for r, i in held]).T
    order = np.argsort(numbers[0], kind="stable")  # by document: the first of equal windows is the smallest
    doc, tkey, at = numbers[:, order]
    group = np.array(groups, np.uint64)[order]
    size = LEFT + WIDTH
    text = b"".join(runs[r][2][i].rjust(LEFT, b"\0") + runs[r][0][i].ljust(WIDTH, b"\0") for r, i in (held[k] for k in order))
    left = np.array([len(runs[r][2][i]) for r, i in held])[order]
    right = np.array([len(runs[r][0][i]) for r, i in held])[order]
    p, inv = powers(size + 1)
    total = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_BYTE[np.frombuffer(text, np.uint8).reshape(n, size)] * p[:size], axis=1, out=total[:, 1:])
    gone = np.zeros((n, LEFT + 2), bool)
    salt = mixed(group + np.uint64(1))
    for a in range(LEFT + 1):
        rows = np.flatnonzero((left >= a) & (right >= WIDTH - a))
        if len(rows) < 2:
            continue
        s = LEFT - a
        key = mixed((total[rows, s + WIDTH] - total[rows, s]) * inv[s]) ^ salt[rows]
        o = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
        least = np.repeat(doc[rows[o[first]]], np.diff(np.r_[first, len(o)]))
        gone[rows[o], a + 1] = least < doc[rows[o]]
    change = np.diff(gone.astype(np.int8), axis=1, append=0)
    up, down = np.argwhere(change[:, :-1] == 1), np.argwhere(change == -1)
    # up[k], down[k]: offsets a from .. to of a row's run of removed windows
    i, a_min, a_max = up[:, 0], up[:, 1], down[:, 1] - 1
    return _spans(doc[i], tkey[i], at[i] - a_max, at[i] - a_min + WIDTH)


# -- the operator -------------------------------------------------------------------

def _runs_and_splitters(d: DataFrame, run_bytes: int) -> tuple[int, list[int]]:
    """Number of runs, and splitters from one random position of each text."""
    b = F.encode("text", "utf-8")
    at = F.pmod(F.xxhash64("doc", F.lit(3)), F.greatest(F.octet_length(b), F.lit(1)).cast("long")).cast("int") + 1
    head = F.conv(F.hex(F.rpad(F.substring(b, at, 6), 6, F.lit(b"\0"))), 16, 10).cast("long")
    sized = d.select(F.octet_length(b).alias("n"), head.alias("h"))
    n = max(1, -(-(sized.agg(F.sum("n")).head()[0] or 0) // run_bytes))
    if n == 1:
        return n, []
    ranges = min(n, MAX_RANGES)
    cuts = sized.agg(F.percentile_approx("h", [k / ranges for k in range(1, ranges)], 10 * ranges)).head()[0]
    return n, sorted(set(cuts or []))


def _expand(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(t).alias("tkey"), t.alias("text"))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES,
                  hot_group: int = HOT_GROUP) -> DataFrame:
    """(doc, tkey, start, stop) of the removed bytes; ``tkey`` is the xxhash64 of
    the text, which tells rows of one id apart. Spans may overlap."""
    spark = docs.sparkSession
    d = _expand(docs, id_col, text).filter("doc IS NOT NULL")
    n_runs, splitters = _runs_and_splitters(d, run_bytes)
    d = d.withColumn("run", F.pmod(F.xxhash64("doc"), F.lit(n_runs)).cast("int"))
    answers_path, parts_path = scratch_path(spark, "keys"), scratch_path(spark, "stretches")
    (d.select("run", "doc", "text").groupBy("run").applyInArrow(_send_keys(n_runs), KEY_SCHEMA)
     .groupBy("kind", "part").applyInArrow(_answer_keys, KEY_SCHEMA).write.parquet(answers_path))
    release_shuffles(spark)
    answers = spark.read.schema(KEY_SCHEMA).parquet(answers_path)
    (d.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_judge_stretches(splitters, hot_group), PART_SCHEMA)
     .write.parquet(parts_path))
    discard(spark, answers_path)
    release_shuffles(spark)
    parts = spark.read.schema(PART_SCHEMA).parquet(parts_path)
    columns = ["doc", "tkey", "start", "stop"]
    merged = (parts.filter(F.col("kind") == SUFFIX).select("part", "suffixes").groupBy("part")
              .applyInArrow(_merge_suffixes, PART_SCHEMA).select(*columns))
    windows = parts.filter(F.col("kind") == WINDOW).select("w1", "w2", *columns)
    least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
    hot = windows.join(least, ["w1", "w2"]).filter("least < doc").select(*columns)
    return parts.filter(F.col("kind") == SPAN).select(*columns).unionByName(merged).unionByName(hot)


def _cut(batches):
    for batch in batches:
        sizes, removed, counts, kept, runs = [], [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            sizes.append(len(raw))
            found = []
            for s in sorted((x["start"], x["stop"]) for x in spans.as_py()) if spans.is_valid else ():
                if found and s[0] <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], s[1])
                else:
                    found.append(list(s))
            removed.append(sum(b - a for a, b in found))
            counts.append(len(found))
            edges = [0, *(x for f in found for x in f), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            runs.append([{"start": a, "stop": b} for a, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
             pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row ``id_col, n_bytes, n_removed, n_spans, kept`` (remaining bytes) and
    the maximal removed ``spans``."""
    spans = (removed_spans(docs, id_col, text, **options).groupBy(F.col("doc").alias("sd"), F.col("tkey").alias("st"))
             .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    d = _expand(docs, id_col, text)
    joined = d.join(spans, (d["doc"] == spans["sd"]) & (d["tkey"] == spans["st"]), "left").select("doc", "text", "spans")
    out = joined.mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, "
                                  "spans array<struct<start:long,stop:long>>")
    return out.withColumnRenamed("doc", id_col)


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
