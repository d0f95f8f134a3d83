"""Incremental, reversible line deduplication.

A line's key is a 128-bit digest of the line with white space stripped and A-Z
lower-cased. The index keeps:

* ``postings``: one row per (key, document), the exact references;
* ``counts``: per key the number of documents and the largest id, the exact
  reference counts derived from the postings;
* ``filters``: per shard of the keys a cuckoo filter of those that ``min_docs`` or
  more documents hold. The number of shards follows the counted keys: about
  ``KEYS_PER_SHARD`` distinct ones each, so a shard's task keeps its size as the
  corpus grows; an update that outgrows it deals and builds the filters anew.

Inserting documents raises counts and adds the keys that become common to the
filters; deleting documents lowers them and takes keys out of the filters
again, so a removed document leaves no trace. Cleaning a batch asks the
filters first, with the batch's distinct keys only; the exact counts are read
for the keys a filter reports, and decide.

Every update writes a new version of the tables in the shared folder and then
names it in a ``CURRENT`` table, so a failed update leaves the old state.

Scale: distinct keys are aggregated before every shuffle, so a line in a third
of all documents is one row per map task; a document only ever gathers its own
line keys. Nothing is collected or broadcast by this module.

Defined cases: NULL or empty text is one empty line; lines whose key is shorter
than ``min_chars`` code points are never dropped; rows with a NULL id are
returned unchanged and counted nowhere; repeated rows of one id count as one
document and each row is cleaned; inserting a document twice counts once.
Other columns are passed through by ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import SPACE_BYTES, register, scratch_path, table
from tabloom.llm.cuckoo import CuckooFilter

LEAST_SHARDS = 64
KEYS_PER_SHARD = 100_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line, None when the normalised line is too short."""
    bare = line.strip(SPACE_BYTES)
    if len(bare) < min_chars:
        return None
    if not bare.isascii() and len(bare.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(bare.lower(), digest_size=16).digest()  # bytes.lower() maps A-Z only


def _key_rows(min_chars: int):
    def rows(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not text.is_valid:
                    continue
                found = {line_key(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")}
                found.discard(None)
                keys.extend(found)
                ids.extend([i] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc"])
    return rows


def line_postings(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(key, doc) once per row of ``docs`` and long line."""
    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(
        _key_rows(min_chars), "key binary, doc long")


def _sharded(keys: DataFrame, n_shards: int) -> DataFrame:
    return keys.select(F.pmod(F.crc32("key"), F.lit(n_shards)).cast("int").alias("shard"), "key")


def _build_filter(group: pa.Table) -> pa.Table:
    keys = group.column("key").to_pylist()
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                     "cells": pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())})


def _update_filter(old: pa.Table, changes: pa.Table) -> pa.Table:
    """Apply key additions and removals; an overfull filter asks for a rebuild."""
    shard = (old if old.num_rows else changes).column("shard")[0].as_py()
    f = CuckooFilter.from_bytes(old.column("cells")[0].as_py()) if old.num_rows else CuckooFilter(64)
    full = False
    for key, add in zip(changes.column("key").to_pylist(), changes.column("add").to_pylist()):
        if add:
            full = full or not f.add(key)
        else:
            f.discard(key)
    return pa.table({"shard": pa.array([shard], pa.int32()),
                     "cells": pa.array([None if full else f.to_bytes()], pa.binary())})


def _probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
    if not filters.num_rows or not keys.num_rows:
        return pa.table({"key": pa.array([], pa.binary())})
    f = CuckooFilter.from_bytes(filters.column("cells")[0].as_py())
    return pa.table({"key": pa.array([k for k in keys.column("key").to_pylist() if k in f], pa.binary())})


def _rewrite(min_chars: int):
    """Drop the listed keys' lines; columns: packed row, text, dropped keys."""
    def rows(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                if drop.is_valid:
                    gone = set(drop.as_py())
                    left = [x for x in lines if line_key(x, min_chars) not in gone]
                else:
                    left = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])
    return rows


class LineIndex:
    """Line references of a corpus in versioned tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None, min_chars: int = 40, min_docs: int = 5,
                 n_shards: int | None = None, id_col: str = "doc_id", text: str = "text"):
        self.spark, self.root = spark, root or scratch_path(spark, "lines")
        self.min_chars, self.min_docs, self.fixed_shards = min_chars, min_docs, n_shards
        self.id_col, self.text = id_col, text
        self.version, self.n_shards = self._current()

    # -- tables -------------------------------------------------------------

    def _current(self) -> tuple[int, int]:
        """Version and number of shards in force; (0, 0) for a new index."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return 0, 0
        last = self.spark.read.parquet(f"{self.root}/CURRENT").agg(F.max(F.struct("version", "shards"))).head()[0]
        return (last["version"], last["shards"]) if last else (0, 0)

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        schema = {"postings": "key binary, doc long", "counts": "key binary, n_docs long, max_doc long",
                  "filters": "shard int, cells binary"}[name]
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}")

    def _publish(self, postings: DataFrame) -> None:
        """Write the next version: postings, their counts and the filters."""
        new = self.version + 1
        postings.write.mode("overwrite").parquet(f"{self.root}/postings/v{new}")
        counts = (self._table("postings", new).groupBy("key")
                  .agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc")))
        counts.write.mode("overwrite").parquet(f"{self.root}/counts/v{new}")
        shards = self.fixed_shards or self._shards(self._table("counts", new).count())
        self._new_filters(new, shards).write.mode("overwrite").parquet(f"{self.root}/filters/v{new}")
        self.spark.range(1).select(F.lit(new).alias("version"), F.lit(shards).alias("shards")) \
            .write.mode("append").parquet(f"{self.root}/CURRENT")
        self.version, self.n_shards = new, shards

    def _shards(self, n_keys: int) -> int:
        """Shards for so many keys: the present number until they hold twice their share."""
        if self.version and n_keys <= 2 * KEYS_PER_SHARD * self.n_shards:
            return self.n_shards
        return max(LEAST_SHARDS, -(-n_keys // KEYS_PER_SHARD))

    def _common(self, version: int, shards: int) -> DataFrame:
        return _sharded(self._table("counts", version).filter(F.col("n_docs") >= self.min_docs), shards)

    def _new_filters(self, new: int, shards: int) -> DataFrame:
        """Filters of version ``new``: the old ones with the keys that crossed the
        threshold added or taken out; a shard that overflows is rebuilt, and all of
        them when the number of shards changes."""
        if shards != self.n_shards:
            return self._common(new, shards).groupBy("shard").applyInArrow(_build_filter, "shard int, cells binary")
        was, now = self._common(self.version, shards), self._common(new, shards)
        on = ["shard", "key"]
        changes = (now.join(was, on, "left_anti").withColumn("add", F.lit(True))
                   .unionByName(was.join(now, on, "left_anti").withColumn("add", F.lit(False))))
        path = f"{self.root}/filters-draft/v{new}"
        (self._table("filters").groupBy("shard").cogroup(changes.groupBy("shard"))
         .applyInArrow(_update_filter, "shard int, cells binary").write.mode("overwrite").parquet(path))
        draft = self.spark.read.schema("shard int, cells binary").parquet(path)
        full = draft.filter(F.col("cells").isNull()).select("shard")
        rebuilt = (now.join(full, "shard", "left_semi").groupBy("shard")
                   .applyInArrow(_build_filter, "shard int, cells binary"))
        return draft.filter(F.col("cells").isNotNull()).unionByName(rebuilt)

    # -- updates ------------------------------------------------------------

    def _postings(self, docs: DataFrame) -> DataFrame:
        return line_postings(docs, self.id_col, self.text, self.min_chars)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Add the lines of ``docs``; documents already present count once."""
        rows = self._postings(docs)
        if self.version:
            rows = self._table("postings").unionByName(rows)
        self._publish(rows.distinct())
        return self

    def delete(self, docs: DataFrame) -> "LineIndex":
        """Take all lines of the documents with the ids of ``docs`` out again."""
        gone = docs.select(F.col(self.id_col).cast("long").alias("doc")).distinct()
        self._publish(self._table("postings").join(gone, "doc", "left_anti").select("key", "doc"))
        return self

    # -- answers ------------------------------------------------------------

    def common_keys(self, postings: DataFrame) -> DataFrame:
        """(key, max_doc) of the keys of ``postings`` that ``min_docs`` or more
        indexed documents hold: filters first, exact counts for what they report."""
        if not self.version:
            return self._table("counts").select("key", "max_doc")
        keys = _sharded(postings.select("key").distinct(), self.n_shards)
        reported = (self._table("filters").groupBy("shard").cogroup(keys.groupBy("shard"))
                    .applyInArrow(_probe, "key binary"))
        exact = self._table("counts").filter(F.col("n_docs") >= self.min_docs).select("key", "max_doc")
        return exact.join(reported, "key", "left_semi")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``row`` (all columns of ``docs`` as a struct), ``n_lines``, ``n_dropped``
        and the ``kept`` text of each row of ``docs``."""
        postings = self._postings(docs)
        drops = (postings.join(self.common_keys(postings), "key").filter(F.col("doc") != F.col("max_doc"))
                 .groupBy("doc").agg(F.collect_set("key").alias("drop")))
        packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(self.text).cast("string").alias("text"),
                             F.col(self.id_col).cast("long").alias("id"))
        joined = packed.join(drops, packed["id"] == drops["doc"], "left").select("row", "text", "drop")
        row_type = packed.schema["row"].dataType.simpleString()
        return joined.mapInArrow(_rewrite(self.min_chars), f"row {row_type}, n_lines long, n_dropped long, kept string")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with common lines removed from all but the last document that
    holds them; same columns. Documents of which nothing is left go."""
    text = options.get("text", "text")
    index = LineIndex(docs.sparkSession, **options).insert(docs)
    cleaned = index.clean(docs)
    left = F.btrim(F.col("kept"), F.lit(" \t\n\x0b\x0c\r")) != ""
    return (cleaned.filter(left | (F.col("n_dropped") == 0))
            .select(*[(F.when(F.col("n_dropped") == 0, F.col("row").getField(c)).otherwise(F.col("kept"))
                       if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (
  SELECT doc_id, line, i,
         translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(k.doc_id <> c.last, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op1_line_dedup", SQL)
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = LineIndex(spark).insert(docs).clean(docs)
    return cleaned.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                          F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
