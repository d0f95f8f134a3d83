"""Packing documents into padded batches with optimal length buckets.

Documents are cut into pieces of at most ``max_len`` tokens, so nothing is
lost and the global histogram has at most ``max_len`` entries whatever the
corpus. A dynamic program over that histogram chooses the bucket boundaries
with the least padding; every piece goes to the smallest boundary that holds
it. Inside a bucket pieces are dealt in the order of a seeded hash into batches
of ``token_budget // boundary`` rows, so all batches of a bucket but the last
are full.

Scale: a bucket may hold most rows, so positions inside it come from sub-buckets
of the hash with about ``SUB_ROWS`` rows, and the counts of the sub-buckets
before. Only the histogram (at most ``max_len`` rows) reaches the driver.

Defined cases: NULL and empty texts have no token and give no piece; repeated
rows and ids are packed one by one (ties of the hash in the order of length);
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import bucket_of, register, stored, table, unit_hash, word_count

MAX_LEN = 2048
N_BUCKETS = 16
TOKEN_BUDGET = 32768
SUB_ROWS = 2048
SEED = 77


def optimal_boundaries(counts: dict[int, int], n_buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest length) that minimise the
    padding sum(count * (boundary - length)) with at most ``n_buckets`` buckets."""
    lens = np.array(sorted(counts), dtype=np.int64)
    if not len(lens):
        return []
    c = np.array([counts[x] for x in lens], dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(c)])
    t = np.concatenate([[0.0], np.cumsum(c * lens)])
    k, m = min(n_buckets, len(lens)), len(lens)
    # cost of one bucket over lens[i:j] is (n[j] - n[i]) * lens[j - 1] - (t[j] - t[i])
    best = np.concatenate([[0.0], n[1:] * lens - t[1:]])
    cuts = []
    for _ in range(1, k):
        new, cut = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + (n[j] - n[:j]) * lens[j - 1] - (t[j] - t[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = new
    out, j = [], m
    for cut in reversed(cuts):
        if cut[j] > 0:
            out.append(int(lens[j - 1]))
            j = int(cut[j])
        elif cut[j] == 0:
            break
    out.append(int(lens[j - 1]))
    return sorted(set(out))


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, n_tokens): the documents cut to at most ``max_len`` tokens."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text)).alias("n"))
    last = F.ceil(F.col("n") / max_len).cast("int") - 1
    return (sized.filter("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
            .select("doc_id", "piece", F.least(F.lit(max_len), F.col("n") - F.col("piece").cast("long") * max_len)
                    .cast("long").alias("n_tokens")))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
         n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = SEED) -> DataFrame:
    """One row per piece: ``doc_id, piece, n_tokens, bucket_len, batch, slot``.

    ``batch`` counts from 0 within a bucket; a batch has
    ``max(1, token_budget // bucket_len)`` slots of ``bucket_len`` tokens.
    """
    spark = docs.sparkSession
    p = stored(pieces(docs, id_col, text, max_len), "pieces")
    histogram = {r[0]: r[1] for r in p.groupBy("n_tokens").count().collect()}  # at most max_len rows
    bounds = optimal_boundaries(histogram, n_buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, piece int, n_tokens long, bucket_len long, batch long, slot int")
    per = {b: sum(c for x, c in histogram.items() if x <= b and all(x > a for a in bounds if a < b)) for b in bounds}
    bucket, subs = F.lit(bounds[-1]), F.lit(1)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    for b in bounds:
        subs = F.when(F.col("bucket_len") == b, F.lit(-(-per[b] // SUB_ROWS))).otherwise(subs)
    d = p.withColumn("bucket_len", bucket.cast("long")).withColumn("u", unit_hash(F.lit(seed), "doc_id", "piece"))
    d = d.withColumn("sub", bucket_of(F.col("u"), subs))
    sums = d.groupBy("bucket_len", "sub").count()
    before = sums.select(F.col("bucket_len").alias("bl"), F.col("sub").alias("sb"),
                         F.coalesce(F.sum("count").over(Window.partitionBy("bucket_len").orderBy("sub")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("bucket_len", "sub").orderBy("u", "doc_id", "piece", "n_tokens")
    at = F.col("before") + F.row_number().over(w) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    return (d.join(before, (d["bucket_len"] == before["bl"]) & (d["sub"] == before["sb"]))
            .withColumn("at", at)
            .select("doc_id", "piece", "n_tokens", "bucket_len", F.floor(F.col("at") / rows).cast("long").alias("batch"),
                    (F.col("at") % rows).cast("int").alias("slot")))


@register("op8_packing")
def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
