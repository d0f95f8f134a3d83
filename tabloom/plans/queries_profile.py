"""Registered queries: profiling aggregates (AGG-*) and data quality (DQ-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators import profile as pf
from tabloom.operators import quality as dq
from tabloom.operators import sketches as sk
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import register
from tabloom.session import scratch_path


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (stable value hashes against the oracle)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


# ------------------------------------------------------------------ AGG-1
def _describe_sql(table, cols):
    return union_sql([f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM {table}""" for c in cols])


@register("agg1_describe", _describe_sql("lineitem", LI_NUM))
def agg1(spark, d):
    return round_all(pf.describe(fx.load(spark, d, "lineitem"), LI_NUM))


@register("agg1_describe_distributed", _describe_sql("lineitem", LI_NUM))
def agg1d(spark, d):
    """Same table through the bucketed exact-quantile plan used above 5 M rows."""
    return round_all(pf.describe(fx.load(spark, d, "lineitem"), LI_NUM, mode="distributed"))


# ------------------------------------------------------------------ AGG-2 / 3
@register("agg2_null_counts", union_sql([
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM ({fx.ORDERS_MISSING_SQL})"""
    for c in ORDER_COLS]))
def agg2(spark, d):
    return pf.null_counts(fx.orders_missing(spark, d))


@register("agg3_unique_counts", union_sql([
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM orders"""
    for c in ORDER_COLS]))
def agg3(spark, d):
    return pf.unique_counts(fx.load(spark, d, "orders"))


# ------------------------------------------------------------------ AGG-4
CUST_COLS = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
             ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


def _inspect_sql():
    parts = []
    for c, t, num in CUST_COLS:
        x = f"CAST({c} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count,
  round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,
  round(max({x}), 6) AS max, '{t}' AS dtype FROM customer""")
    return union_sql(parts)


@register("agg4_inspect", _inspect_sql())
def agg4(spark, d):
    return round_all(pf.inspect(fx.load(spark, d, "customer")))


# ------------------------------------------------------------------ AGG-5
_OM_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
             "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@register("agg5_missing_summary", union_sql([
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE round((count(*) - count({c})) * 100.0 / count(*), 2) END AS missing_pct,
  '{_OM_TYPES[c]}' AS dtype FROM ({fx.ORDERS_MISSING_SQL})""" for c in ORDER_COLS]))
def agg5(spark, d):
    return pf.missing_summary(fx.orders_missing(spark, d))[0]


@register("agg5_missing_totals", f"""SELECT CAST(sum(m) AS BIGINT) AS total_missing,
  CAST(max(n) * 6 AS BIGINT) AS total_cells, round(sum(m) * 100.0 / (max(n) * 6), 2) AS total_missing_pct,
  CAST(count(*) FILTER (WHERE m > 0) AS BIGINT) AS columns_with_missing FROM (
  {union_sql([f"SELECT count(*) - count({c}) AS m, count(*) AS n FROM ({fx.ORDERS_MISSING_SQL})" for c in ORDER_COLS])})""")
def agg5t(spark, d):
    return pf.missing_summary(fx.orders_missing(spark, d))[1]


# ------------------------------------------------------------------ AGG-6..10
@register("agg6_group_stats", """SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, CAST(count(l_extendedprice) AS BIGINT) AS count
  FROM lineitem GROUP BY l_returnflag""")
def agg6(spark, d):
    return round_all(pf.group_stats(fx.load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("agg7_duplicate_count", f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS c FROM ({fx.ORDERS_DUPS_SQL}) GROUP BY {", ".join(ORDER_COLS)})""")
def agg7(spark, d):
    return pf.duplicate_count(fx.orders_dups(spark, d))


def _mode_sql(table, c):
    return f"""SELECT '{c}' AS "column", CAST(min({c}) AS VARCHAR) AS mode, CAST(max(n) AS BIGINT) AS count FROM (
  SELECT {c}, count(*) AS n, max(count(*)) OVER () AS m FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})
  WHERE n = m"""


@register("agg8_modes", union_sql([_mode_sql("customer", c) for c in ("c_mktsegment", "c_nationkey")]))
def agg8(spark, d):
    return pf.modes(fx.load(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@register("agg9_zero_share", f"""SELECT l_partkey, round(avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) * 100, 6)
  AS zero_pct FROM ({fx.DEMAND_PART_SQL}) GROUP BY l_partkey""")
def agg9(spark, d):
    return round_all(pf.zero_share(fx.demand_intermittent(spark, d), "demand", "l_partkey"))


def _cov_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    parts = []
    for i in range(3):
        for j in range(i, 3):
            parts.append(f"""SELECT CAST(count(*) AS BIGINT) AS n, {i} AS i, {j} AS j, '{cols[i]}' AS col_i,
  '{cols[j]}' AS col_j, round(covar_samp({cols[i]}, {cols[j]}), 4) AS cov, round(avg({cols[i]}), 6) AS mean_i,
  round(avg({cols[j]}), 6) AS mean_j FROM lineitem WHERE l_returnflag <> 'R'""")
    return union_sql(parts)


@register("agg10_covariance", _cov_sql())
def agg10(spark, d):
    out = pf.covariance_matrix(fx.load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                               where=F.col("l_returnflag") != "R")
    return round_all(out).withColumn("cov", F.round("cov", 4))


SKETCHED = ["o_totalprice", "o_custkey"]
_LN_G = "ln(1.01 / 0.99)"


def _sketch_sql(c):
    def at(p):
        v = f"arr[1 + CAST(floor({p} * (n - 1)) AS BIGINT)]"
        return f"least(greatest(2 * pow(1.01 / 0.99, ceil(ln({v}) / {_LN_G})) / (1.01 / 0.99 + 1), lo), hi)"
    return f"""SELECT '{c}' AS "column", n AS "count", CAST(0 AS BIGINT) AS missing, round(mu, 6) AS mean, round(sd, 6) AS std,
  CAST(lo AS DOUBLE) AS "min", round({at(0.25)}, 6) AS q25, round({at(0.5)}, 6) AS q50, round({at(0.75)}, 6) AS q75,
  CAST(hi AS DOUBLE) AS "max" FROM (SELECT CAST(count({c}) AS BIGINT) AS n, avg({c}) AS mu, stddev_samp({c}) AS sd, min({c}) AS lo,
  max({c}) AS hi, list({c} ORDER BY {c}) AS arr FROM orders)"""


def _stored_orders(spark, d):
    """Three loads of orders, each written by itself, merged from the stored sketches."""
    orders, path = fx.load(spark, d, "orders"), scratch_path(spark, "sketch")
    for part in range(3):
        sk.write_load(orders.filter(F.col("o_orderkey") % 3 == part), path, f"part{part}", SKETCHED + ["o_orderpriority"])
    return sk.describe_sketch(sk.read_loads(spark, path))


@register("agg1_sketch_describe", " UNION ALL ".join(_sketch_sql(c) for c in SKETCHED))
def agg1_sketch(spark, d):
    return round_all(_stored_orders(spark, d).filter(F.col("column").isin(SKETCHED)).drop("distinct"))


@register("agg3_sketch_distinct")
def agg3_sketch(spark, d):
    return _stored_orders(spark, d).select("column", "distinct")


@register("agg11_eda_trend", """SELECT date_trunc('month', ts) AS period, round(avg(value), 6) AS value,
  CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1""")
def agg11(spark, d):
    return round_all(pf.eda_summary(fx.load(spark, d, "events"), "ts", ["value"])["trend"])


def _eda(spark, d):
    return pf.eda_summary(fx.load(spark, d, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], group="l_returnflag")


@register("agg11_eda_group_trend", """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period, l_returnflag,
  round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
  CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1, 2""")
def agg11_group_trend(spark, d):
    return round_all(_eda(spark, d)["trend"])


@register("agg11_eda_comparison", union_sql(f"""SELECT l_returnflag, '{m}' AS measure, CAST(count(*) AS BIGINT) AS rows,
  CAST(count({m}) AS BIGINT) AS "count", round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std,
  CAST(min({m}) AS DOUBLE) AS "min", CAST(max({m}) AS DOUBLE) AS "max",
  round(sum({m}) / (SELECT sum({m}) FROM lineitem), 6) AS share,
  round(avg({m}) / (SELECT avg({m}) FROM lineitem), 6) AS lift FROM lineitem GROUP BY 1"""
  for m in ("l_quantity", "l_extendedprice")))
def agg11_comparison(spark, d):
    return round_all(_eda(spark, d)["comparison"])


@register("agg11_eda_relationships", """SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b,
  round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem""")
def agg11_relationships(spark, d):
    return round_all(_eda(spark, d)["relationships"])


@register("agg11_eda_anomalies", union_sql(f"""SELECT '{m}' AS "column", CAST(count(*) FILTER (
  WHERE {m} < q1 - 1.5 * (q3 - q1) OR {m} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS "count",
  round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper FROM lineitem,
  (SELECT quantile_cont(CAST({m} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({m} AS DOUBLE), 0.75) AS q3 FROM lineitem)"""
  for m in ("l_quantity", "l_extendedprice")))
def agg11_anomalies(spark, d):
    return round_all(_eda(spark, d)["anomalies"])


# ------------------------------------------------------------------ DQ
def dirty_orders(spark, d):
    """orders with NULL prices, a duplicated slice and price outliers."""
    o = fx.orders_dups(spark, d)
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)) \
        .when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"), "o_orderpriority",
                    F.regexp_replace(F.format_number("o_totalprice", 2), ",", "").alias("price_text"))


DIRTY_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 500 = 0 THEN o_totalprice * 50 ELSE o_totalprice END
  AS o_totalprice, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text
  FROM ({fx.ORDERS_DUPS_SQL})"""
DIRTY_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
DIRTY_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "price_text"]
DIRTY_STR = ["o_orderstatus", "o_orderpriority", "price_text"]
NUM_RE = dq.PATTERNS["numeric"]


def _issues_sql():
    t = f"({DIRTY_SQL})"
    miss = [f"""SELECT 'missing_values' AS type, '{c}' AS "column",
  CASE WHEN m / n > 0.5 THEN 'high' WHEN m / n > 0.1 THEN 'medium' ELSE 'low' END AS severity,
  CAST(m AS BIGINT) AS count, round(m / n, 6) AS rate, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper,
  'fill median' AS suggestion FROM (SELECT count(*) - count({c}) AS m, count(*) AS n FROM {t}) WHERE m > 0"""
            for c in DIRTY_ALL]
    dup = [f"""SELECT 'duplicate_rows', NULL, 'medium', CAST(s AS BIGINT), round(s / n, 6), NULL, NULL,
  'drop duplicates keep first' FROM (SELECT sum(c - 1) AS s, sum(c) AS n FROM (SELECT count(*) AS c FROM {t} GROUP BY {", ".join(DIRTY_ALL)}))
  WHERE s > 0"""]
    typ = [f"""SELECT 'data_type', '{c}', 'medium', CAST(k AS BIGINT), round(k / nn, 6), NULL, NULL, 'numeric' FROM (
  SELECT count({c}) AS nn, count(*) FILTER (WHERE regexp_matches({c}, '{NUM_RE}')) AS k FROM {t}) WHERE k / nn > 0.8"""
           for c in DIRTY_STR]
    out = [f"""SELECT 'outliers', '{c}', 'low', CAST(cnt AS BIGINT), round(cnt / n, 6), round(lo, 6), round(hi, 6), 'clip' FROM (
  SELECT count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS cnt, max(n) AS n, max(lo) AS lo, max(hi) AS hi FROM {t},
  (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM (SELECT quantile_cont({c}, 0.25) AS q1,
   quantile_cont({c}, 0.75) AS q3, count(*) AS n FROM {t}))) WHERE cnt > 0""" for c in DIRTY_NUM]
    return union_sql(miss + dup + typ + out)


ISSUES_SQL = _issues_sql()


def issues(spark, d):
    return dq.quality_issues(dirty_orders(spark, d))


@register("dq1_quality_issues", ISSUES_SQL)
def dq1(spark, d):
    return round_all(issues(spark, d))


@register("dq2_name_issues", """SELECT 'column_name' AS type, name AS "column", 'low' AS severity FROM (VALUES
  ('Order Key'), ('total$price'), ('  ''Order Status''  '),
  ('a_very_long_column_name_that_goes_on_and_on_beyond_fifty_chars')) v(name)""")
def dq2(spark, d):
    from tabloom.plans.queries_relational import bad_names
    t = bad_names(spark, d)
    return dq.quality_issues(t).filter("type = 'column_name'").select("type", "column", "severity")


@register("dq3_missing_issues", f"""SELECT '{'o_totalprice'}' AS "column", CAST(m AS BIGINT) AS count,
  round(m / n, 6) AS rate, CASE WHEN m / n > 0.5 THEN 'high' WHEN m / n > 0.1 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT count(*) - count(o_totalprice) AS m, count(*) AS n FROM ({fx.ORDERS_MISSING_SQL}))""")
def dq3(spark, d):
    return round_all(dq.missing_issue_table(fx.orders_missing(spark, d)))


@register("dq5_numeric_text", union_sql([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS non_null,
  CAST(count(*) FILTER (WHERE regexp_matches({c}, '{NUM_RE}')) AS BIGINT) AS numeric_like,
  round(count(*) FILTER (WHERE regexp_matches({c}, '{NUM_RE}')) / count({c}), 6) AS share,
  coalesce(count(*) FILTER (WHERE regexp_matches({c}, '{NUM_RE}')) / count({c}) > 0.8, false) AS should_be_numeric
  FROM ({fx.ORDERS_TEXT_SQL})""" for c in ("price_txt", "price_bad", "date_txt", "o_orderstatus", "o_orderpriority")]))
def dq5(spark, d):
    return round_all(dq.numeric_text_share(fx.orders_text(spark, d)))


@register("dq6_outlier_counts", union_sql([
    f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS count,
  round(max(lo), 6) AS lower, round(max(hi), 6) AS upper FROM ({fx.ORDERS_OUTLIERS_SQL}),
  (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1,
   quantile_cont({c}, 0.75) AS q3 FROM ({fx.ORDERS_OUTLIERS_SQL})))""" for c in ("o_totalprice", "o_custkey")]))
def dq6(spark, d):
    from tabloom.operators.stats import outlier_counts
    return round_all(outlier_counts(fx.orders_outliers(spark, d), ["o_totalprice", "o_custkey"]))


def _pattern_sql():
    parts = []
    cols = ("price_txt", "date_txt", "o_orderpriority")
    for c in cols:
        for p, rx in dq.PATTERNS.items():
            rx_sql = rx.replace("'", "''")
            parts.append(f"""SELECT '{c}' AS "column", '{p}' AS pattern,
  round(count(*) FILTER (WHERE regexp_matches({c}, '{rx_sql}')) / count({c}), 6) AS share FROM ({fx.ORDERS_TEXT_SQL})""")
    return union_sql(parts)


@register("dq7_pattern_profile", _pattern_sql())
def dq7(spark, d):
    return round_all(dq.pattern_profile(fx.orders_text(spark, d), ["price_txt", "date_txt", "o_orderpriority"]))


@register("dq8_quality_score", f"""SELECT CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 20
  WHEN 'medium' THEN 10 ELSE 5 END), 0)) AS DOUBLE) AS score FROM ({ISSUES_SQL})""")
def dq8(spark, d):
    return dq.quality_score(issues(spark, d))


@register("dq9_quality_report", f"""SELECT (SELECT CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 20
  WHEN 'medium' THEN 10 ELSE 5 END), 0)) AS DOUBLE) FROM ({ISSUES_SQL})) AS score,
  (SELECT CAST(count(*) AS BIGINT) FROM ({DIRTY_SQL})) AS rows, 6::BIGINT AS columns,
  (SELECT CAST(count(*) - count(o_totalprice) AS BIGINT) FROM ({DIRTY_SQL})) AS missing_cells,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM ({DIRTY_SQL}) GROUP BY {", ".join(DIRTY_ALL)})) AS duplicate_rows,
  (SELECT CAST(count(*) AS BIGINT) FROM ({ISSUES_SQL})) AS issues""")
def dq9(spark, d):
    return dq.quality_report(dirty_orders(spark, d))


@register("dq10_issue_digest", f"""SELECT type, CAST(count(*) AS BIGINT) AS issues,
  list("column" ORDER BY count DESC NULLS LAST, "column") FILTER (WHERE rk <= 5) AS top_columns FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY count DESC NULLS LAST, "column") AS rk FROM ({ISSUES_SQL}))
  GROUP BY type""")
def dq10(spark, d):
    return dq.summarize_issues(issues(spark, d))


def _field_sql():
    parts = []
    for c, t, _ in CUST_COLS:
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
  CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count,
  (SELECT list(CAST(v AS VARCHAR) ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM customer WHERE {c} IS NOT NULL
   ORDER BY v LIMIT 3)) AS samples FROM customer""")
    return union_sql(parts)


@register("dq11_field_profile", _field_sql())
def dq11(spark, d):
    return dq.field_profile(fx.load(spark, d, "customer"))
