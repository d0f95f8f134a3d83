"""Window-style operators (WIN-1..8).

Order-dependent operators take an explicit ``order_by`` (pandas relies on row
position; Spark has no row order) and a ``partition_by`` series key. A window
without ``partition_by`` runs in a single task, so every operator here warns
about it; group-wide aggregates (WIN-1) use ``groupBy`` + join instead of a
window so partial aggregation and AQE skew-join splitting apply.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.expressions import (OperatorError, as_list as _as_list, is_numeric, null_safe_join,
                                           qcol, require_columns)
from tabloom.session import cut_lineage

_AGGS = ("mean", "median", "sum", "min", "max", "std", "count", "nunique")


def ordered_window(order_by, partition_by=()) -> Window:
    keys, parts = _as_list(order_by), _as_list(partition_by)
    if not keys:
        raise OperatorError("order-dependent operator needs order_by")
    if not parts:
        warnings.warn("window without partition_by runs in a single task", stacklevel=3)
    return Window.partitionBy(*[qcol(p) for p in parts]).orderBy(*[qcol(k) for k in keys])


def _agg_expr(kind: str, c: Column, approx: bool) -> Column:
    if kind == "mean":
        return F.avg(c)
    if kind == "median":
        return F.percentile_approx(c, 0.5, 10000) if approx else F.median(c)
    if kind == "sum":
        return F.sum(c)
    if kind == "min":
        return F.min(c)
    if kind == "max":
        return F.max(c)
    if kind == "std":
        return F.stddev_samp(c)
    if kind == "count":
        return F.count(c)
    if kind == "nunique":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    raise OperatorError(f"unknown aggregation {kind!r}; use one of {_AGGS}")


def aggregated_feature(df: DataFrame, name: str, by, target: str, agg: str = "mean",
                       approx: bool = False, group_limit: int | None = None) -> DataFrame:
    """WIN-1: per-group aggregate of ``target`` attached to every row.

    ``groupBy`` (map-side partial aggregation) + left join back on the group
    key; a NULL group key gets NULL, as in pandas. AQE broadcasts the group
    table when it is small and splits a hot key's partition otherwise.
    """
    keys = _as_list(by)
    require_columns(df, keys + [target])
    if agg not in ("count", "nunique", "min", "max") and not is_numeric(df, target):
        raise OperatorError(f"{agg} needs a numeric target column")
    if agg == "median" and not approx:
        # exact, and split into buckets when a group is too large for one task
        from tabloom.operators.quantiles import group_quantiles
        stats = group_quantiles(df, keys, target, [0.5], [name], group_limit=group_limit)
    else:
        stats = df.groupBy(*[qcol(k) for k in keys]).agg(_agg_expr(agg, qcol(target), approx).alias(name))
    base = df.drop(name) if name in df.columns else df
    return base.join(stats, on=keys, how="left")


# --------------------------------------------------------------------------
# Fills along an order (WIN-2..4)
# --------------------------------------------------------------------------


def ffill_expr(c: Column, w: Window) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill_expr(c: Column, w: Window) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate_expr(c: Column, w: Window, rn: Column) -> Column:
    """Linear in row position; leading gap stays NULL, trailing gap repeats last."""
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.when(c.isNotNull(), rn)
    pv, pp = F.last(c, True).over(before), F.last(pos, True).over(before)
    nv, np_ = F.first(c, True).over(after), F.first(pos, True).over(after)
    lin = pv + (nv - pv) * (rn - pp) / (np_ - pp)
    return F.coalesce(c.cast("double"), lin, pv.cast("double"))


def fill_ordered(df: DataFrame, columns, method: str, order_by, partition_by=(),
                 rows_per_block: int | None = None) -> DataFrame:
    """Forward fill, backward fill or interpolate ``columns``.

    Small tables use one window per series. When the table holds more than
    ``rows_per_block`` rows (default ``ROWS_PER_BLOCK``), the series are cut into
    value-range blocks of the first order column (of the rows' numbers in a range
    sort where that column is text) and filled with a two-level scan (see
    :func:`segmented_fill`), so one hot series never sits in a single task.
    """
    cols = _as_list(columns)
    require_columns(df, cols)
    if method not in ("fill_forward", "fill_backward", "interpolate"):
        raise OperatorError(f"unknown ordered fill {method!r}")
    cols = [c for c in cols if method != "interpolate" or is_numeric(df, c)]
    limit = ROWS_PER_BLOCK if rows_per_block is None else rows_per_block
    first = _as_list(order_by)[0]
    if cols:
        n = df.count()
        if n > limit:
            blocks = max(2, -(-n // limit))
            if _order_number(df, first) is not None:
                return segmented_fill(df, cols, method, order_by, partition_by, blocks)
            rows = numbered(df, [qcol(k) for k in _as_list(order_by)], "__tb_order")
            return segmented_fill(rows, cols, method, "__tb_order", partition_by, blocks).drop("__tb_order")
    w = ordered_window(order_by, partition_by)
    rn = F.row_number().over(w) if method == "interpolate" else None
    exprs = []
    for name in df.columns:
        c = qcol(name)
        if name not in cols:
            exprs.append(c)
        elif method == "fill_forward":
            exprs.append(ffill_expr(c, w).alias(name))
        elif method == "fill_backward":
            exprs.append(bfill_expr(c, w).alias(name))
        else:
            exprs.append(interpolate_expr(c, w, rn).alias(name))
    return df.select(*exprs)


ROWS_PER_BLOCK = 2_000_000


def _order_number(df: DataFrame, name: str):
    from pyspark.sql import types as T
    t = dict((f.name, f.dataType) for f in df.schema.fields)[name]
    c = qcol(name)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, T.NumericType):
        return c.cast("double")
    return None


def tag_blocks(df: DataFrame, order_column: str, blocks: int) -> DataFrame:
    """Add ``__tb_blk``: value-range block of ``order_column`` by approximate
    quantile boundaries; NULL keys, which sort first, form a block before all."""
    import math
    from pyspark.ml.feature import Bucketizer
    ok = _order_number(df, order_column)
    probs = [i / blocks for i in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(ok, probs, 10 * blocks).alias("q")).first()["q"] or []
    splits = [-math.inf] + sorted(set(float(x) for x in cuts if math.isfinite(x))) + [math.inf]
    tagged = Bucketizer(splits=splits, inputCol="__tb_ok", outputCol="__tb_blk", handleInvalid="keep") \
        .transform(df.withColumn("__tb_ok", ok))
    return tagged.withColumn("__tb_blk", F.when(F.col("__tb_ok").isNull(), F.lit(-1.0)).otherwise(F.col("__tb_blk"))) \
        .drop("__tb_ok")


def series_positions(df: DataFrame, order_by, partition_by=(), rows_per_block: int | None = None,
                     pos: str = "_pos", size: str = "_size", n_rows: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in its series and the series size.

    Large tables use value-range blocks of the first order column (a numbered
    range sort where that is text): positions
    inside a (series, block) window plus the block offsets of the series (a
    per-series scan over at most ``blocks`` summary rows), joined back.
    """
    keys, parts = _as_list(order_by), _as_list(partition_by)
    pcols = [qcol(p) for p in parts]
    limit = ROWS_PER_BLOCK if rows_per_block is None else rows_per_block
    n = df.count() if n_rows is None else n_rows
    if n <= limit:
        w = Window.partitionBy(*pcols).orderBy(*[qcol(k) for k in keys])
        return df.withColumn(pos, F.row_number().over(w)) \
            .withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*pcols)))
    if _order_number(df, keys[0]) is None:  # text: numbers of a range sort by series and order
        rows = numbered(df, [*pcols, *[qcol(k) for k in keys]], "__tb_num")
        first = rows.groupBy(*pcols).agg(F.min("__tb_num").alias("__tb_first"), F.count(F.lit(1)).alias(size)) if parts else None
        rows = null_safe_join(rows, first, parts) if parts else rows.withColumn("__tb_first", F.lit(0)).withColumn(size, F.lit(n).cast("long"))
        return rows.select(*[qcol(c) for c in df.columns], (F.col("__tb_num") - F.col("__tb_first") + 1).alias(pos), qcol(size))
    base = tag_blocks(df, keys[0], max(2, -(-n // limit)))
    w = Window.partitionBy(*pcols, "__tb_blk").orderBy(*[qcol(k) for k in keys])
    local = base.withColumn("__tb_lrn", F.row_number().over(w))
    summ = local.groupBy(*pcols, "__tb_blk").agg(F.count(F.lit(1)).alias("__tb_rows"))
    ws = Window.partitionBy(*pcols).orderBy("__tb_blk")
    summ = summ.select(*pcols, "__tb_blk",
                       F.coalesce(F.sum("__tb_rows").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                                  F.lit(0)).alias("__tb_off"),
                       F.sum("__tb_rows").over(Window.partitionBy(*pcols)).alias(size))
    return null_safe_join(local, summ, parts + ["__tb_blk"], "left") \
        .select(*[qcol(c) for c in df.columns], (F.col("__tb_off") + F.col("__tb_lrn")).alias(pos), qcol(size))


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """Number all rows from 0 in an order, without a one-task window: a range sort,
    and the row counts of its partitions (one number each) as offsets."""
    sorted_rows = cut_lineage(df.orderBy(*order).withColumn("__tb_m", F.monotonically_increasing_id()))
    part = F.shiftright("__tb_m", 33)
    total, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in sorted_rows.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    at = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__tb_p long, __tb_o long")
    return sorted_rows.join(F.broadcast(at), part == F.col("__tb_p")) \
        .withColumn(name, F.col("__tb_o") + F.col("__tb_m").bitwiseAND(F.lit(2 ** 33 - 1))) \
        .drop("__tb_m", "__tb_p", "__tb_o")


def segmented_fill(df: DataFrame, cols, method: str, order_by, partition_by, blocks: int) -> DataFrame:
    """Two-level ordered fill.

    1. Blocks are value ranges of the first order column (approximate
       quantile boundaries, ``Bucketizer``): deterministic literals.
    2. Inside each (series, block) a window gives the local fill, local row
       number and local first/last non-null value and position.
    3. A per-(series, block) summary (rows, last and first non-null value and
       position) is scanned per series over its blocks (at most ``blocks``
       rows per series) to get what flows in from earlier / later blocks.
    4. One equi-join on (series, block) brings the carry back to the rows.
    """
    keys = _as_list(order_by)
    parts = _as_list(partition_by)
    base = tag_blocks(df, keys[0], blocks)
    pcols = [qcol(p) for p in parts]
    w = Window.partitionBy(*pcols, "__tb_blk").orderBy(*[qcol(k) for k in keys])
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    local = base.withColumn("__tb_lrn", F.row_number().over(w))
    for i, c in enumerate(cols):
        v = qcol(c)
        pos = F.when(v.isNotNull(), F.col("__tb_lrn"))
        local = local.withColumn(f"__tb_pv{i}", F.last(v, True).over(before)) \
            .withColumn(f"__tb_pp{i}", F.last(pos, True).over(before)) \
            .withColumn(f"__tb_nv{i}", F.first(v, True).over(after)) \
            .withColumn(f"__tb_np{i}", F.first(pos, True).over(after))
    # per (series, block) summary: rows, last / first non-null value and local position
    aggs = [F.count(F.lit(1)).alias("__tb_rows")]
    for i, c in enumerate(cols):
        v = qcol(c)
        aggs += [F.max_by(v, F.when(v.isNotNull(), F.col("__tb_lrn"))).alias(f"__tb_bl{i}"),
                 F.max(F.when(v.isNotNull(), F.col("__tb_lrn"))).alias(f"__tb_blp{i}"),
                 F.min_by(v, F.when(v.isNotNull(), F.col("__tb_lrn"))).alias(f"__tb_bf{i}"),
                 F.min(F.when(v.isNotNull(), F.col("__tb_lrn"))).alias(f"__tb_bfp{i}")]
    summ = local.groupBy(*pcols, "__tb_blk").agg(*aggs)
    ws = Window.partitionBy(*pcols).orderBy("__tb_blk")
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    nxt = ws.rowsBetween(1, Window.unboundedFollowing)
    off = F.coalesce(F.sum("__tb_rows").over(prev), F.lit(0))
    summ = summ.withColumn("__tb_off", off)
    carry = summ
    for i in range(len(cols)):
        gl = F.when(F.col(f"__tb_blp{i}").isNotNull(), F.col("__tb_off") + F.col(f"__tb_blp{i}"))
        gf = F.when(F.col(f"__tb_bfp{i}").isNotNull(), F.col("__tb_off") + F.col(f"__tb_bfp{i}"))
        carry = carry.withColumn(f"__tb_glp{i}", gl).withColumn(f"__tb_gfp{i}", gf)
    sel = [*[qcol(p) for p in parts], "__tb_blk", "__tb_off"]
    for i in range(len(cols)):
        sel += [F.last(f"__tb_bl{i}", True).over(prev).alias(f"__tb_cv{i}"),
                F.last(f"__tb_glp{i}", True).over(prev).alias(f"__tb_cp{i}"),
                F.first(f"__tb_bf{i}", True).over(nxt).alias(f"__tb_dv{i}"),
                F.first(f"__tb_gfp{i}", True).over(nxt).alias(f"__tb_dp{i}")]
    carry = carry.select(*sel)
    joined = null_safe_join(local, carry, parts + ["__tb_blk"], "left")
    grn = F.col("__tb_off") + F.col("__tb_lrn")
    out = []
    for name in df.columns:
        if name not in cols:
            out.append(qcol(name))
            continue
        i = cols.index(name)
        v = qcol(name)
        pv = F.coalesce(F.col(f"__tb_pv{i}"), F.col(f"__tb_cv{i}"))
        nv = F.coalesce(F.col(f"__tb_nv{i}"), F.col(f"__tb_dv{i}"))
        if method == "fill_forward":
            out.append(F.coalesce(v, pv).alias(name))
        elif method == "fill_backward":
            out.append(F.coalesce(v, nv).alias(name))
        else:
            pp = F.coalesce(F.col("__tb_off") + F.col(f"__tb_pp{i}"), F.col(f"__tb_cp{i}"))
            np_ = F.coalesce(F.col("__tb_off") + F.col(f"__tb_np{i}"), F.col(f"__tb_dp{i}"))
            lin = pv + (nv - pv) * (grn - pp) / (np_ - pp)
            out.append(F.coalesce(v.cast("double"), lin, pv.cast("double")).alias(name))
    return joined.select(*out)


# --------------------------------------------------------------------------
# Moving averages and lags (WIN-5..8)
# --------------------------------------------------------------------------


def lagged_values(df: DataFrame, value: str, lags, order_by, partition_by=(),
                  rows_per_block: int | None = None, prefix: str = "_lag",
                  n_rows: int | None = None) -> DataFrame:
    """Add ``{prefix}{i}`` = ``value`` i rows back in its series, for i in ``lags``.

    Small tables use ``lag`` windows. Large tables avoid one window per series:
    rows get their series position (:func:`series_positions`, block-split),
    every row sends its value to the positions it is a lag of (``explode`` of
    len(lags) copies), values are gathered by ``groupBy(series, position)`` and
    joined back on (series, position) - a hot series spreads over all tasks.
    """
    lags = sorted(set(int(i) for i in lags))
    keys, parts = _as_list(order_by), _as_list(partition_by)
    limit = ROWS_PER_BLOCK if rows_per_block is None else rows_per_block
    c = qcol(value)
    if (df.count() if n_rows is None else n_rows) <= limit:
        w = ordered_window(order_by, partition_by)
        return df.select("*", *[(c if i == 0 else F.lag(c, i).over(w)).alias(f"{prefix}{i}") for i in lags])
    pos = series_positions(df, keys, parts, rows_per_block, pos="__tb_pos", size="__tb_size", n_rows=n_rows).drop("__tb_size")
    series = [f"__tb_s{j}" for j in range(len(parts))]
    sent = pos.select(*[qcol(p).alias(s) for p, s in zip(parts, series)], c.alias("__tb_val"),
                      F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("__tb_pos") + i).alias("t"))
                                          for i in lags])).alias("__tb_e"))
    got = sent.groupBy(*series, F.col("__tb_e.t").alias("__tb_t")).agg(
        *[F.max(F.when(F.col("__tb_e.i") == i, F.col("__tb_val"))).alias(f"__tb_lag{i}") for i in lags])
    cond = [qcol(p).eqNullSafe(F.col(s)) for p, s in zip(parts, series)] + [F.col("__tb_pos") == F.col("__tb_t")]
    return pos.join(got, reduce(lambda a, b: a & b, cond), "left") \
        .select(*[qcol(x) for x in df.columns], *[F.col(f"__tb_lag{i}").alias(f"{prefix}{i}") for i in lags])


def sma(df: DataFrame, value: str, window: int, order_by, partition_by=(),
        name: str = "sma", rows_per_block: int | None = None) -> DataFrame:
    """WIN-5: simple moving average; NULL unless the last ``window`` values
    (this row included) are all present, as a pandas rolling mean."""
    lagged = lagged_values(df, value, range(window), order_by, partition_by, rows_per_block)
    cols = [F.col(f"_lag{i}") for i in range(window)]
    present = reduce(lambda a, b: a & b, [x.isNotNull() for x in cols])
    total = reduce(lambda a, b: a + b, [x.cast("double") for x in cols])
    return lagged.withColumn(name, F.when(present, total / window)).drop(*[f"_lag{i}" for i in range(window)])


def wma(df: DataFrame, value: str, weights, order_by, partition_by=(),
        name: str = "wma", rows_per_block: int | None = None) -> DataFrame:
    """WIN-6: weighted moving average with weights oldest → newest."""
    k = len(weights)
    lagged = lagged_values(df, value, range(k), order_by, partition_by, rows_per_block)
    terms = [F.lit(float(wt)) * F.col(f"_lag{k - 1 - i}") for i, wt in enumerate(weights)]
    return lagged.withColumn(name, reduce(lambda a, b: a + b, terms)).drop(*[f"_lag{i}" for i in range(k)])


def lag_features(df: DataFrame, value: str, n: int, order_by, partition_by=(),
                 prefix: str = "lag_", rows_per_block: int | None = None) -> DataFrame:
    """WIN-7: columns ``lag_1..lag_n``; rows with a missing value in any of them
    are dropped, as ``dropna`` does over the lag columns."""
    lagged = lagged_values(df, value, range(1, n + 1), order_by, partition_by, rows_per_block, prefix="__tb_out")
    lagged = lagged.withColumnsRenamed({f"__tb_out{i}": f"{prefix}{i}" for i in range(1, n + 1)})
    full = reduce(lambda a, b: a & b, [F.col(f"{prefix}{i}").isNotNull() for i in range(1, n + 1)])
    return lagged.filter(full)
