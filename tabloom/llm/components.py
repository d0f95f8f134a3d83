"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored

MAX_LOCAL = 200_000


def _contract(batches):
    """Replace the links of a bounded run of rows by stars to their smallest node."""
    for batch in batches:
        for lo in range(0, batch.num_rows, MAX_LOCAL):
            part = batch.slice(lo, MAX_LOCAL)
            parent: dict[int, int] = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            out = [(x, root(x)) for x in parent]
            out = np.array([p for p in out if p[0] != p[1]], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns ``a, b``) that is not its
    component's smallest node. Rounds of large and small stars; a hot node's
    links are only ever aggregated and joined, never gathered."""
    e = stored(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
               .filter("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "links")
    was = None
    while True:
        shape = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if not shape[0] or shape == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = shape
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
