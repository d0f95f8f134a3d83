"""Nearest neighbours by inner product with a block matrix join.

Vectors are scaled to int8. Queries and candidates are dealt into blocks by a
hash of their id, and every pair of blocks is one tile: the int8 product gives
all its inner products at once, each within a known bound

    |q.c - q^.c^| <= |q^| |c - c^| + |q - q^| |c|

where ``^`` marks the quantised vector. A pair survives when its upper bound
reaches the k-th largest lower bound of its query in the tile; survivors are
recomputed from the original vectors in double precision, so the result is
exact. Each tile keeps ``k`` rows per query and heaps merge the tiles.

The int8 products are summed in float32 matrix products, which are exact for
up to 1,040 components (larger vectors use float64).

Scale: a tile holds ``block`` queries and ``block`` candidates whatever the
table size; block counts come from row counts. Vectors of different length
never meet.

Defined cases: vectors that are NULL, zero or hold a NULL, NaN or infinite
component take no part, neither do rows with a NULL id; repeated rows of one id
count once (the largest vector, component by component, stands for the id);
a query never finds its own id; ties go to the smaller id; queries with fewer
than ``k`` candidates return them all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import bucket_of, register, stored, table, unit_hash

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, and the norms of the quantised rows
    and of what quantising lost."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from left to right,
    so a pair's value does not depend on where it stands in a block."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 4096):
        out[lo:lo + 4096] = np.cumsum(a[lo:lo + 4096] * b[lo:lo + 4096], axis=1)[:, -1]
    return out


def tile_nearest(qid, q, cid, c, k: int):
    """The ``k`` nearest candidates of each query within one tile."""
    with np.errstate(over="ignore", invalid="ignore"):
        qi, qs, qn, qr = quantise(q)
        ci, cs, _, cr = quantise(c)
        cn = np.linalg.norm(c, axis=1)
        wide = np.float32 if q.shape[1] <= 1040 else np.float64
        right = ci.astype(wide).T
        found = []
        for lo in range(0, len(qid), 64):
            s = slice(lo, lo + 64)
            approx = (qi[s].astype(wide) @ right).astype(np.float64) * qs[s, None] * cs[None, :]
            bound = qn[s, None] * cr[None, :] + qr[s, None] * cn[None, :]
            bound += 1e-9 * (np.abs(approx) + bound)
            own = qid[s, None] == cid[None, :]
            low = np.where(own | np.isnan(approx - bound), -np.inf, approx - bound)
            floor = np.full(len(low), -np.inf)
            if low.shape[1] > k:
                floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
            i, j = np.nonzero(~own & ~(approx + bound < floor[:, None]))
            score = exact_products(q[lo + i], c[j])
            order = np.lexsort((cid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, np.arange(len(low)))
            keep = np.arange(len(i)) - first[i] < k
            found.append((qid[lo + i[keep]], cid[j[keep]], score[keep]))
    return [np.concatenate(x) for x in zip(*found)]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 vectors; of repeated ids the largest vector stays."""
    t = t.combine_chunks()
    ids = t.column("id").to_numpy()
    lists = t.column("vec").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    last = np.append(ids[1:] != ids[:-1], True)
    return ids[last], x[last]


_PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _PAIR.empty_table()
        got = tile_nearest(*_matrix(queries), *_matrix(candidates), k)
        return pa.table([pa.array(got[0]), pa.array(got[1]), pa.array(got[2])], schema=_PAIR)
    return run


def _merge(k: int):
    """Heap of the k best of a query over all its tiles."""
    def run(rows: pa.Table) -> pa.Table:
        by_query: dict[int, list] = {}
        for q, v, s in zip(*(rows.column(n).to_pylist() for n in ("query_id", "vec_id", "score"))):
            heap = by_query.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
        out = [(q, r, -v, s) for q, heap in by_query.items()
               for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                         pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                        names=["query_id", "rank", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles, dim) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .filter(~bad & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", query_block: int = QUERY_BLOCK,
            candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries``:
    ``query_id, rank, vec_id, score``."""
    c, q = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    n_c, n_q = c.count(), q.count()
    if not n_c or not n_q:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c_blocks, q_blocks = -(-n_c // candidate_block), -(-n_q // query_block)
    u = unit_hash(F.lit(5), F.col("id"))
    c = (c.withColumn("cb", bucket_of(u, F.lit(c_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    q = (q.withColumn("qb", bucket_of(u, F.lit(q_blocks)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    tile = ["dim", "qb", "cb"]
    pairs = (q.groupBy(*tile).cogroup(c.groupBy(*tile))
             .applyInArrow(_tile(k), "query_id long, vec_id long, score double"))
    groups = F.pmod(F.xxhash64("query_id"), F.lit(max(8, n_q // 64)))
    return (stored(pairs, "tiles").withColumn("g", groups).groupBy("g")
            .applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double"))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op5_ann", SQL)
def op5_ann(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.filter(F.col("vec_id") % 20 == 0), k=20)
