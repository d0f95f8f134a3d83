"""Exact, reproducible sampling and splitting (SMP-1..7).

Rows are ordered by a seeded hash of a key instead of drawn with an RNG, so the
selection is stable under re-partitioning and task retries, and the same
arithmetic can be run in SQL. "Take the first n rows by hash" is done without a
global sort: a two-level histogram of the hash finds the exact cut value per
stratum, then one filter keeps the rows below it. Only histogram tables (at
most 65,536 rows per stratum) are ranked with windows, so a stratum holding a
third of the data does not end up in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.expressions import (OperatorError, col_type, null_safe_join, portable_hash, qcol,
                                           require_columns, row_hash)
from tabloom.session import cut_lineage

_BUCKET_BITS = 16
# Small n: a top-k (TakeOrderedAndProject) is cheaper than the histogram passes.
TOPK_LIMIT = 100_000
# Largest stratum ranked directly in one window partition (checked by a count).
WINDOW_LIMIT = 1_000_000


def hash_column(df: DataFrame, key=None, seed: int = 42) -> tuple[Column, int]:
    """Seeded order hash and its bit width (portable for one integer key); rows
    with a NULL key come first."""
    if key is not None and isinstance(key, str) and isinstance(
            col_type(df, key), (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.coalesce(portable_hash(qcol(key), seed), F.lit(-1).cast("long")), 32
    cols = [key] if isinstance(key, str) else (list(key) if key else df.columns)
    return F.pmod(row_hash(cols, seed), F.lit(1 << 62)), 62


def hash_cutoffs(df: DataFrame, h: Column, bits: int, groups, need) -> DataFrame:
    """Per group, the largest hash value among the ``need`` smallest hashes.

    ``need`` is an int (no groups) or a DataFrame ``groups + __tb_need``.
    Returns ``groups + __tb_cut, __tb_rest, __tb_at``: of the ``__tb_at`` rows
    with the cut's hash, ``__tb_rest`` belong to the selection. Groups that
    select nothing have no row. A NULL group is a group.
    """
    g = [qcol(c) for c in groups]
    shift = bits - _BUCKET_BITS
    base = df.select(*g, h.alias("__tb_h")).withColumn("__tb_b", F.shiftright("__tb_h", shift))
    hist = base.groupBy(*g, "__tb_b").agg(F.count(F.lit(1)).alias("__tb_n"))
    if isinstance(need, DataFrame):
        hist = null_safe_join(hist, need, groups, "inner")
    else:
        hist = hist.withColumn("__tb_need", F.lit(int(need)).cast("long"))
    w = Window.partitionBy(*g).orderBy("__tb_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__tb_cum", F.sum("__tb_n").over(w))
    crossing = hist.filter((F.col("__tb_cum") >= F.col("__tb_need")) &
                           (F.col("__tb_cum") - F.col("__tb_n") < F.col("__tb_need")) &
                           (F.col("__tb_need") > 0)) \
        .select(*g, "__tb_b", (F.col("__tb_need") - (F.col("__tb_cum") - F.col("__tb_n"))).alias("__tb_want"))
    inner = null_safe_join(base, crossing, [*groups, "__tb_b"], "inner") \
        .groupBy(*g, "__tb_h", "__tb_want").agg(F.count(F.lit(1)).alias("__tb_n"))
    w2 = Window.partitionBy(*g).orderBy("__tb_h").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("__tb_cum", F.sum("__tb_n").over(w2))
    before = F.col("__tb_cum") - F.col("__tb_n")
    return inner.filter((F.col("__tb_cum") >= F.col("__tb_want")) & (before < F.col("__tb_want"))) \
        .select(*g, F.col("__tb_h").alias("__tb_cut"), (F.col("__tb_want") - before).alias("__tb_rest"),
                F.col("__tb_n").alias("__tb_at"))


def tie_hash(df: DataFrame, seed: int = 42) -> Column:
    """Order of rows whose key hashes are equal: a hash of the whole row."""
    return F.pmod(row_hash(df.columns, seed + 7919), F.lit(1 << 62))


def _with_cuts(df: DataFrame, cuts: DataFrame, groups) -> DataFrame:
    """The cut of its group beside every row; without groups it is one literal row."""
    if groups:
        return null_safe_join(df, cuts, groups, "left")
    row = cuts.head()
    return df.select("*", *[F.lit(row[f.name] if row else None).cast(f.dataType).alias(f.name) for f in cuts.schema])


def _flag_first(df: DataFrame, h: Column, bits: int, groups, need, seed: int = 42) -> DataFrame:
    """Add boolean ``__tb_sel``: the row is among the ``need`` smallest of its
    group in the order (hash, hash of the whole row).

    Three cuts, each only for the rows on the one before: by the hash, by the
    row hash, and by count among identical rows. Identical rows are counted and
    multiplied again, so any number of copies is split exactly.
    """
    groups = list(groups)
    tie = tie_hash(df, seed)
    cuts = cut_lineage(hash_cutoffs(df, h, bits, groups, need))
    marked = _with_cuts(df.withColumn("__tb_h", h), cuts, groups)
    on_cut = F.col("__tb_h") == F.col("__tb_cut")
    below = F.coalesce(F.col("__tb_h") < F.col("__tb_cut"), F.lit(False))
    if not cuts.filter(F.col("__tb_rest") < F.col("__tb_at")).head(1):  # whole ties only
        return marked.withColumn("__tb_sel", below | F.coalesce(on_cut, F.lit(False))) \
            .drop("__tb_h", "__tb_cut", "__tb_rest", "__tb_at")
    names = [c for c in df.columns]
    tied = marked.withColumn("__tb_t", tie).filter(on_cut)
    need2 = cuts.select(*[qcol(c) for c in groups], F.col("__tb_rest").alias("__tb_need"))
    rest = tied.select(*[qcol(c) for c in names], "__tb_t")
    if not groups:
        need2 = need2.head()["__tb_need"]
    cuts2 = hash_cutoffs(rest, F.col("__tb_t"), 62, groups, need2)
    cuts2 = cut_lineage(cuts2).withColumnsRenamed({"__tb_cut": "__tb_cut2", "__tb_rest": "__tb_rest2", "__tb_at": "__tb_at2"})
    rest = _with_cuts(rest, cuts2, groups)
    copies = F.col("__tb_t") == F.col("__tb_cut2")
    clear = rest.filter(~F.coalesce(copies, F.lit(False))) \
        .withColumn("__tb_sel", F.coalesce(F.col("__tb_t") < F.col("__tb_cut2"), F.lit(False)))
    same = rest.filter(copies).groupBy(*[qcol(c) for c in names], "__tb_rest2").agg(F.count(F.lit(1)).alias("__tb_n")) \
        .withColumn("__tb_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tb_n")))) \
        .withColumn("__tb_sel", F.col("__tb_i") <= F.col("__tb_rest2"))
    out = [qcol(c) for c in names] + [F.col("__tb_sel")]
    off_cut = marked.filter(~F.coalesce(on_cut, F.lit(False))).withColumn("__tb_sel", below)
    return off_cut.select(*out).unionAll(clear.select(*out)).unionAll(same.select(*out))


def _round_half_even(x: float) -> int:
    return int(round(x))


def sample(df: DataFrame, n: int | None = None, frac: float | None = None,
           seed: int = 42, key=None, stratify_by: str | None = None,
           topk_limit: int = TOPK_LIMIT, window_limit: int | None = None) -> DataFrame:
    """SMP-1/2/3: exactly ``n`` rows, or ``round(frac*rows)`` rows (per stratum).

    Without replacement, reproducible for a seed. ``key`` (a unique integer
    column is best) defines the hash; default is all columns.
    """
    if (n is None) == (frac is None):
        raise OperatorError("give exactly one of n or frac")
    if frac is not None and not (0 < frac <= 1):
        raise OperatorError("frac must be in (0, 1]")
    if stratify_by is not None:
        require_columns(df, [stratify_by])
    h, bits = hash_column(df, key, seed)
    tie = tie_hash(df, seed)
    if stratify_by is None:
        total = df.count()
        if n is None:
            n = _round_half_even(frac * total)
        if n <= 0 or n > total:
            raise OperatorError(f"n must be in (0, {total}]")
        if n <= topk_limit:
            return df.orderBy(h, tie).limit(n)
        return _flag_first(df, h, bits, [], n, seed).filter("__tb_sel").drop("__tb_sel")
    if frac is None:
        raise OperatorError("stratified sampling takes frac")
    sizes = df.groupBy(qcol(stratify_by).alias(stratify_by)).agg(F.count(F.lit(1)).alias("__tb_n"))
    largest = sizes.agg(F.max("__tb_n")).first()[0] or 0
    if largest <= (WINDOW_LIMIT if window_limit is None else window_limit):
        # checked size: every stratum fits one window partition
        s = qcol(stratify_by)
        w = Window.partitionBy(s).orderBy(h, tie)
        need = F.bround(F.count(F.lit(1)).over(Window.partitionBy(s)) * F.lit(float(frac)), 0)
        return df.withColumn("__tb_rn", F.row_number().over(w)).withColumn("__tb_need", need) \
            .filter(F.col("__tb_rn") <= F.col("__tb_need")).drop("__tb_rn", "__tb_need")
    need = sizes.select(qcol(stratify_by), F.bround(F.col("__tb_n") * F.lit(float(frac)), 0).cast("long").alias("__tb_need"))
    return _flag_first(df, h, bits, [stratify_by], need, seed).filter("__tb_sel").drop("__tb_sel")


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key=None,
                     flag: str = "is_test", topk_limit: int = TOPK_LIMIT) -> DataFrame:
    """SMP-5: exact ``ceil(test_size*rows)`` test rows chosen by hash; adds ``flag``.

    The hash cut comes from a bounded top-k for up to ``TOPK_LIMIT`` test rows
    when no two rows share the cut's hash, else from the hash histogram; ties
    are broken by the whole row and identical rows are counted, so the number
    of test rows is exact for any data."""
    if not (0 < test_size < 1):
        raise OperatorError("test_size must be in (0, 1)")
    total = df.count()
    n_test = int(math.ceil(test_size * total))
    h, bits = hash_column(df, key, seed)
    if n_test <= topk_limit:
        # a bounded top-k over the hash alone finds the cut; one more row tells of a tie
        top = df.select(h.alias("__tb_h")).orderBy("__tb_h").limit(n_test + 1) \
            .withColumn("__tb_i", F.row_number().over(Window.orderBy("__tb_h")))  # bounded by topk_limit
        row = top.agg(F.count(F.lit(1)), F.max("__tb_h"), F.max(F.when(F.col("__tb_i") <= n_test, F.col("__tb_h")))).head()
        n, over, cut = row
        if cut is None or n == n_test or over != cut:
            return df.withColumn(flag, F.lit(False) if cut is None else (h <= F.lit(cut)))
    return _flag_first(df, h, bits, [], n_test, seed).withColumnRenamed("__tb_sel", flag)


def time_split(df: DataFrame, order_by, test_size: float = 0.2, partition_by=(),
               flag: str = "is_test", rows_per_block: int | None = None) -> DataFrame:
    """SMP-6: chronological split at ``int((1-test_size)*n)`` rows per series.

    Positions come from :func:`tabloom.operators.windows.series_positions`,
    which splits a large series into order-value blocks.
    """
    from tabloom.operators.windows import series_positions
    pos = series_positions(df, order_by, partition_by, rows_per_block, pos="__tb_pos", size="__tb_size")
    n_train = F.floor(F.col("__tb_size") * F.lit(1.0 - test_size))
    return pos.withColumn(flag, F.col("__tb_pos") > n_train).drop("__tb_pos", "__tb_size")


def kfold(df: DataFrame, k: int = 5, seed: int = 42, key=None, fold_col: str = "fold") -> DataFrame:
    """SMP-7: fold id = hash mod k (stateless, stable under retries)."""
    h, _ = hash_column(df, key, seed)
    return df.withColumn(fold_col, F.pmod(h, F.lit(k)).cast("int"))
