"""Dataset catalog (SRC-6..9): named DataFrames + temp views + metadata.

The catalog holds lazy DataFrames; nothing is materialised on registration.
``list()`` and ``shapes()`` return DataFrames. Ids are reproducible from the
seed so a replayed analysis gets the same generated names.
"""

from __future__ import annotations

import random
import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.expressions import OperatorError, qcol
from tabloom.operators.relational import page
from tabloom.sources.paged import read_page, write_paged


@dataclass
class Entry:
    df: DataFrame
    description: str = ""
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    labels: dict = field(default_factory=dict)
    source_key: str | None = None
    pages: str | None = None


class Catalog:
    """Mutable map id -> DataFrame, mirrored as temp views for ``sql``."""

    def __init__(self, spark: SparkSession, seed: int = 42):
        self.spark = spark
        self.seed = seed
        self._rng = random.Random(seed)
        self._entries: dict[str, Entry] = {}
        self._initial: dict[str, Entry] = {}

    # ids ------------------------------------------------------------------
    def new_id(self) -> str:
        return str(uuid.UUID(int=self._rng.getrandbits(128), version=4))

    @staticmethod
    def view_name(dataset_id: str) -> str:
        return "ds_" + re.sub(r"[^A-Za-z0-9_]", "_", dataset_id)

    # CRUD -----------------------------------------------------------------
    def create(self, df: DataFrame, dataset_id: str | None = None, description: str = "",
               source_key: str | None = None, initial: bool = False) -> str:
        if source_key is not None:
            for k, e in self._entries.items():
                if e.source_key == source_key:
                    return k  # registration dedupes by source unique id
        did = dataset_id or self.new_id()
        self._entries[did] = Entry(df, description, source_key=source_key)
        df.createOrReplaceTempView(self.view_name(did))
        if initial:
            self._initial[did] = self._entries[did]
        return did

    def exists(self, dataset_id: str) -> bool:
        return dataset_id in self._entries

    def read(self, dataset_id: str) -> DataFrame:
        if dataset_id not in self._entries:
            raise OperatorError(f"unknown dataset {dataset_id!r}")
        return self._entries[dataset_id].df

    get = read

    def rename(self, old: str, new: str) -> None:
        e = self._entries.pop(old)
        self.spark.catalog.dropTempView(self.view_name(old))
        self._entries[new] = e
        e.df.createOrReplaceTempView(self.view_name(new))

    def write_pages(self, dataset_id: str, path: str, order_by) -> str:
        """SRC-6: keep a sorted, indexed copy of the dataset for :meth:`page`."""
        self._entries[dataset_id].pages = write_paged(self.read(dataset_id), path, order_by)
        return path

    def page(self, dataset_id: str, skip: int = 0, limit: int = 100, order_by=None) -> DataFrame:
        """SRC-6: one page, from the sorted copy unless another order is asked for."""
        df = self.read(dataset_id)
        pages = self._entries[dataset_id].pages
        if order_by is None and pages is None:
            raise OperatorError("page needs order_by, or write_pages before")
        return read_page(self.spark, pages, skip, limit) if order_by is None else page(df, order_by, skip, limit)

    def reset(self) -> None:
        for k in list(self._entries):
            self.spark.catalog.dropTempView(self.view_name(k))
        self._entries = dict(self._initial)
        for k, e in self._entries.items():
            e.df.createOrReplaceTempView(self.view_name(k))
        self._rng = random.Random(self.seed)

    def ids(self) -> list[str]:
        return list(self._entries)

    def list(self) -> DataFrame:
        """Metadata table: id, view, description, created_at, column count."""
        rows = [(k, self.view_name(k), e.description, e.created_at, len(e.df.columns))
                for k, e in self._entries.items()]
        return self.spark.createDataFrame(
            rows, "id string, view string, description string, created_at string, columns long")

    def shapes(self) -> DataFrame:
        """SRC-7 for every dataset: one count job per dataset, unioned."""
        parts = [e.df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(k).alias("id"), "rows", F.lit(len(e.df.columns)).cast("long").alias("columns"))
            for k, e in self._entries.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # labels -----------------------------------------------------------------
    def set_labels(self, dataset_id: str, labels: dict) -> DataFrame:
        """SRC-8: store column labels as column metadata (kept with the data)."""
        df = self.read(dataset_id)
        out = df.select(*[qcol(c).alias(c, metadata={"label": labels[c]}) if c in labels else qcol(c)
                          for c in df.columns])
        self._entries[dataset_id].df = out
        self._entries[dataset_id].labels.update(labels)
        out.createOrReplaceTempView(self.view_name(dataset_id))
        return out

    def sql(self, query: str) -> DataFrame:
        """PRJ-7: ad-hoc SQL over the catalog's views."""
        return self.spark.sql(query)


def shape(df: DataFrame) -> tuple[int, int]:
    """SRC-7: (rows, columns); the count is pushed into the scan."""
    return df.count(), len(df.columns)


def overview(df: DataFrame, n: int = 5, order_by=None):
    """SRC-8: schema table (column, dtype, label) and the first ``n`` rows
    (labels, when set, become the preview's headers)."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("label")) for f in df.schema.fields]
    schema = spark.createDataFrame(rows, "column string, dtype string, label string")
    prev = df.orderBy(*([order_by] if isinstance(order_by, str) else list(order_by or []))).limit(n) \
        if order_by else df.limit(n)
    renames = {f.name: f.metadata["label"] for f in df.schema.fields if f.metadata.get("label")}
    if renames:
        prev = prev.withColumnsRenamed(renames)
    return schema, prev
