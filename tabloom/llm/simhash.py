"""Near-duplicate classes by SimHash fingerprints and multi-index hashing.

A text's fingerprint has a bit set where more than half of its shingles' XXH64
values (seed 42, repeats counted) have it; two texts link when their
fingerprints differ in at most ``bits`` bits.

1. Fingerprints are computed once per text; equal ones become one row that
   carries the smallest id.
2. Fingerprints are sorted in a few rotations, and neighbours within the radius
   are linked. This finds most links of dense groups in linear work; stars over
   the found links give every fingerprint a label.
3. Multi-index hashing finds the rest. The 64 bits are cut into ``m`` segments;
   with ``bits = m * a + b`` a linked pair differs by at most ``a`` bits in one
   of the first ``b + 1`` segments or by at most ``a - 1`` in another one. Each
   fingerprint is filed under its own value of each segment and under the
   smaller values of the Hamming ball around it, so a pair meets in the bucket
   of its smaller value. Complete distances are verified in the bucket, between
   fingerprints of different labels only, and labels that link are merged.

Scale: ``m`` is the number of segments with the least rows and comparisons for
the counted number of fingerprints (few wide segments on large tables); the
result is the same for each. Buckets whose rows all have one label are dropped
before they are dealt. A larger bucket is cut into blocks, and pairs of blocks
are tasks of their own, so no task holds more than two blocks of a bucket.
Links are put out between labels, at most one per label and tile, never as all
pairs of a group. Only counts reach the driver.

Defined cases: a NULL or empty text, or one of white space only, has fingerprint
zero and links like any other; a text with fewer words than a shingle is one
shingle; rows with a NULL id get a fingerprint, a NULL class, and link with
nothing; rows that repeat an id are each judged by their text, and the class of
a row is the smallest id that its own text reaches; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, register, stored, stored_path, table
from tabloom.llm.components import components

WIDTH = 4
BITS = 4
SEED = 42
CHUNK = 1 << 16
BLOCK = 2048
SMALL = 128
NEIGHBOURS = 4
ROTATIONS = (0, 16, 32, 48)


# -- fingerprints ---------------------------------------------------------------

def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of the UTF-8 bytes of a text."""
    words = (text or b"").lower().split()  # on bytes: A-Z, and white space U+0009-U+000D and U+0020
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) < width:
        starts, ends = [0], [len(joined) + 1]
    else:
        ends = ends[width - 1:]
    total = np.zeros(64, np.int64)
    for at in range(0, len(ends), CHUNK):
        part = [xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        planes = np.array(part, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(planes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(ends)).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        _fingerprints(width), "doc long, fp long")


# -- neighbours in sorted rotations ----------------------------------------------

def _near_neighbours(bits: int):
    def run(batches):
        tail = np.zeros(0, np.uint64)
        for batch in batches:
            fp = np.concatenate([tail, batch.column(0).to_numpy().view(np.uint64)])
            for d in range(1, NEIGHBOURS + 1):
                near = np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= bits)
                a, b = fp[near].view(np.int64), fp[near + d].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            tail = fp[-NEIGHBOURS:]
    return run


def neighbour_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links between fingerprints that stand close in one of the sorted rotations."""
    turned = F.array(*[F.struct(F.lit(r).alias("r"), (F.col("fp") if not r else F.shiftleft("fp", r).bitwiseOR(
        F.shiftrightunsigned("fp", 64 - r))).alias("v")) for r in ROTATIONS])
    rows = fps.select("fp", F.explode(turned).alias("t")).select("fp", "t.r", "t.v")
    return (rows.repartitionByRange("r", "v").sortWithinPartitions("r", "v").select("fp")
            .mapInArrow(_near_neighbours(bits), "a long, b long"))


# -- multi-index hashing ---------------------------------------------------------

def segments(m: int, bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the segments that have to be searched."""
    a, b = divmod(bits, m)
    out, shift = [], 64
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        shift -= width
        radius = a if k <= b else a - 1
        if radius >= 0:
            out.append((shift, width, radius))
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to ``radius`` bits."""
    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]


def choose_segments(n: int, bits: int) -> int:
    """Number of segments with the least cost for ``n`` fingerprints: a filed row
    counts 200 comparisons."""
    def cost(m: int) -> float:
        parts = [(w, len(ball(w, r))) for _, w, r in segments(m, bits)]
        return 200 * n * sum(1 + k / 2 for _, k in parts) + n * n * sum((1 + k) / 2.0 ** (w + 1) for w, k in parts)
    return min(range(max(2, bits // 2), bits + 2), key=cost)


def filed(fps: DataFrame, m: int, bits: int) -> DataFrame:
    """(key, probe, fp, label): own values of the segments, and smaller values
    within the radius as probes."""
    def entries(k: int, shift: int, width: int, radius: int) -> list:
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        base = F.lit(k << 40)
        own = F.array(F.struct((base + value).alias("key"), F.lit(False).alias("probe")))
        if not radius:
            return [own]
        masks = F.array(*[F.lit(x).cast("long") for x in ball(width, radius)])
        near = F.filter(F.transform(masks, lambda x: value.bitwiseXOR(x)), lambda x: x < value)
        return [own, F.transform(near, lambda x: F.struct((base + x).alias("key"), F.lit(True).alias("probe")))]

    parts = [e for k, s in enumerate(segments(m, bits)) for e in entries(k, *s)]
    return fps.select("fp", "label", F.explode(F.concat(*parts)).alias("e")).select("e.key", "e.probe", "fp", "label")


def tiles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of the buckets with more than one label, dealt to pairs of blocks:
    (key, i, j, side, probe, fp, label)."""
    sizes = (rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                                     F.min("probe").alias("only"))
             .filter("lo <> hi AND NOT only").select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    dealt = rows.join(sizes, "key").withColumn("at", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (dealt.withColumn("other", other)
            .select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"),
                    (F.col("at") > F.col("other")).alias("side"), "probe", "fp", "label"))


class _Labels:
    """Labels of a tile's rows; links merge them and are kept once."""

    def __init__(self):
        self.links: list[tuple[int, int]] = []

    def merged(self, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((min(x, y), max(x, y)))
        old = np.array(sorted(parent), np.int64)
        new = np.array([root(x) for x in old.tolist()], np.int64)
        at = np.minimum(np.searchsorted(old, labels), len(old) - 1)
        return np.where(old[at] == labels, new[at], labels)


def tile_links(fp, label, probe, side, bits: int) -> list[tuple[int, int]]:
    """Links between the labels of one tile."""
    out = _Labels()
    order = np.argsort(probe, kind="stable")  # own values first: two probes need no comparison here
    fp, label, probe, side = fp[order], label[order], probe[order], side[order]
    left = np.flatnonzero(~side) if side.any() else np.flatnonzero(~probe)
    right = np.flatnonzero(side) if side.any() else np.arange(len(fp))
    for at in range(0, len(left), 256):
        x = left[at:at + 256]
        open_ = right[(label[right] != label[x[0]])] if (label[x] == label[x[0]]).all() else right
        if not len(open_):
            continue
        near = np.bitwise_count(fp[x, None] ^ fp[open_]) <= bits
        near &= label[x, None] != label[open_]
        near &= ~(probe[x, None] & probe[open_])
        i, j = np.nonzero(near)
        if len(i):
            label = out.merged(label, label[x[i]], label[open_[j]])
    return out.links


def _small_links(fp, label, probe, first, last, bits: int):
    """Links of many small buckets at once: every own row against the rows behind
    it; rows are sorted with own values first in each bucket."""
    own = np.flatnonzero(~probe)
    stop = last[np.searchsorted(first, own, side="right") - 1]
    count = stop - own - 1
    for lo, hi in _slices(count, 1 << 20):
        n, x = count[lo:hi], own[lo:hi]
        a = np.repeat(x, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (label[a] != label[b])
        if near.any():
            yield np.unique(np.sort(np.stack([label[a[near]], label[b[near]]]), axis=0), axis=1)


def _slices(count: np.ndarray, most: int):
    """Runs of positions whose counts add up to about ``most``."""
    if len(count):
        cut = np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1
        edges = [0, *cut.tolist(), len(count)]
        yield from zip(edges[:-1], edges[1:])


def _search(bits: int):
    """Links of a partition sorted by key, i, j and probe."""
    def run(batches):
        def links(t: pa.Table):
            key, i, j, side, probe, fp, label = (t.column(c).to_numpy() for c in range(7))
            fp = fp.view(np.uint64)
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(key)])
            found = []
            small = np.repeat(size <= SMALL, size)
            if small.any():
                n = size[size <= SMALL]
                end = np.cumsum(n)
                found += list(_small_links(fp[small], label[small], probe[small], end - n, end, bits))
            for k in np.flatnonzero(size > SMALL):
                s = slice(first[k], first[k] + size[k])
                got = tile_links(fp[s], label[s], probe[s], side[s], bits)
                if got:
                    found.append(np.array(got, np.int64).T)
            pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            tail = [t.column(c).to_numpy() for c in range(3)]
            same = np.all([c == c[-1] for c in tail], axis=0)  # the last tile may go on in the next batch
            cut = t.num_rows - int(same[::-1].argmin() if not same.all() else len(same))
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)
    return run


def search_links(fps: DataFrame, bits: int, m: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the labels of ``fps`` (fp, label)."""
    t = tiles(filed(fps, m, bits), block)
    return (t.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "probe")
            .mapInArrow(_search(bits), "a long, b long"))


# -- the operator ----------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS,
                    m: int | None = None, block: int = BLOCK) -> DataFrame:
    """``id_col, fp, component_id`` of every row; the class is named by its
    smallest id. ``m`` fixes the number of segments."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, id_col, text, width), "prints")
    known, known_path = stored_path(prints.filter("doc IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("first")), "known")
    near = components(neighbour_links(known, bits))
    labelled = known.join(near, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("label"))
    labelled, labelled_path = stored_path(labelled, "labelled")
    more = components(search_links(labelled, bits, m or choose_segments(labelled.count(), bits), block))
    classed = (labelled.join(more, F.col("label") == F.col("node"), "left")
               .select("fp", "first", F.coalesce("root", "label").alias("class")))
    least = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    named = stored(classed.join(least, "class").select(F.col("fp").alias("known"), "component_id"), "classes")
    discard(spark, known_path)
    discard(spark, labelled_path)
    known_class = F.when(F.col("doc").isNotNull(), F.col("component_id"))
    return (prints.join(named, F.col("fp") == F.col("known"), "left")
            .select(F.col("doc").alias(id_col), "fp", known_class.alias("component_id")))


@register("op11_simhash")
def op11_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
