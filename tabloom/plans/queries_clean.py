"""Registered queries: cleaning (CLN-*) and ordered fills / windows (WIN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import clean as cl
from tabloom.operators import windows as win
from tabloom.plans import fixtures as fx
from tabloom.plans.queries_profile import (DIRTY_SQL, ISSUES_SQL, dirty_orders,
                                           issues, round_all)
from tabloom.plans.registry import REGISTRY, register


def registered_sql(name):
    return REGISTRY[name][1]

OM = f"({fx.ORDERS_MISSING_SQL})"
EG = f"({fx.EVENTS_GAPS_SQL})"
DEM = f"({fx.DEMAND_SQL})"


# ------------------------------------------------------------------ CLN-1
@register("cln1_infer_types", f"""SELECT o_orderkey, TRY_CAST(trim(price_txt) AS DOUBLE) AS price_txt, price_bad,
  try_strptime(trim(date_txt), '%Y-%m-%d') AS date_txt, o_orderstatus, o_orderpriority FROM ({fx.ORDERS_TEXT_SQL})""")
def cln1(spark, d):
    return cl.infer_types(fx.orders_text(spark, d))[0]


@register("cln1_infer_report", f"""WITH t AS ({fx.ORDERS_TEXT_SQL})
  SELECT 'price_txt' AS "column", 'double' AS converted_to,
    round(count(*) FILTER (WHERE regexp_matches(trim(price_txt), '{cl.NUMERIC_RE}')) / count(price_txt), 6) AS match_ratio,
    CAST(count(*) - count(TRY_CAST(trim(price_txt) AS DOUBLE)) AS BIGINT) AS nulls_after FROM t
  UNION ALL SELECT 'date_txt', 'timestamp',
    round(count(*) FILTER (WHERE regexp_matches(trim(date_txt), '{cl.DATE_PREFIX_RE}')) / count(date_txt), 6),
    CAST(count(*) - count(try_strptime(trim(date_txt), '%Y-%m-%d')) AS BIGINT) FROM t
  UNION ALL SELECT c, 'category', round(nd / n, 6), 0::BIGINT FROM (
    SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS nd, count(*) AS n FROM t
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM t)""")
def cln1r(spark, d):
    return round_all(cl.infer_types(fx.orders_text(spark, d))[1])


# ------------------------------------------------------------------ CLN-2
MIS = f"({fx.PART_MISALIGNED_SQL})"
SPLIT = "string_split_regex(p_brand, '[,;\\t]')"


@register("cln2_fix_misaligned", f"""SELECT p_partkey,
  CASE WHEN ok THEN {SPLIT}[1] ELSE p_brand END AS p_brand,
  CASE WHEN ok AND len({SPLIT}) > 1 THEN {SPLIT}[2] ELSE p_type END AS p_type,
  CASE WHEN ok AND len({SPLIT}) > 2 THEN {SPLIT}[3] ELSE p_size END AS p_size
  FROM (SELECT *, coalesce(regexp_matches(p_brand, '[,;\\t]') AND len({SPLIT}) <= 3, false) AS ok FROM {MIS})""")
def cln2(spark, d):
    return cl.fix_misaligned(fx.part_misaligned(spark, d), ["p_brand", "p_type", "p_size"])[0]


@register("cln2_fixed_cells", f"""SELECT CAST(count(*) FILTER (WHERE regexp_matches(p_brand, '[,;\\t]')) AS BIGINT)
  AS fixed_cells FROM {MIS}""")
def cln2c(spark, d):
    return cl.fix_misaligned(fx.part_misaligned(spark, d), ["p_brand", "p_type", "p_size"])[1]


# ------------------------------------------------------------------ CLN-3..6
@register("cln3_drop_missing", f"SELECT * FROM {OM} WHERE o_totalprice IS NOT NULL")
def cln3(spark, d):
    return cl.fill(fx.orders_missing(spark, d), "o_totalprice", "drop")


@register("cln4_fill_mean", f"""SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {OM})), 6)
  AS o_totalprice FROM {OM}""")
def cln4(spark, d):
    return round_all(cl.fill(fx.orders_missing(spark, d), "o_totalprice", "fill_mean")
                     .select("o_orderkey", "o_totalprice"))


@register("cln5_fill_median", f"""SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {OM})), 6)
  AS o_totalprice FROM {OM}""")
def cln5(spark, d):
    return round_all(cl.fill(fx.orders_missing(spark, d), "o_totalprice", "fill_median")
                     .select("o_orderkey", "o_totalprice"))


def orders_missing_prio(spark, d):
    o = fx.load(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None))
                    .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


@register("cln6_fill_mode", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END
  AS o_orderpriority FROM orders),
  m AS (SELECT min(o_orderpriority) AS v FROM (SELECT o_orderpriority, count(*) AS n, max(count(*)) OVER () AS mx
   FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1) WHERE n = mx)
  SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM t""")
def cln6(spark, d):
    return cl.fill(orders_missing_prio(spark, d), "o_orderpriority", "fill_mode")


@register("cln6_fill_all_median", f"""SELECT o_orderkey, o_custkey, o_orderstatus,
  round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {OM})), 6) AS o_totalprice, o_orderdate,
  o_orderpriority FROM {OM}""")
def cln6_all(spark, d):
    return round_all(cl.fill(fx.orders_missing(spark, d), None, "fill_median"))


# ------------------------------------------------------------------ WIN-2..4 (CLN-7)
W_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@register("win2_fill_forward", f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER
  ({W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EG}""")
def win2(spark, d):
    return cl.fill(fx.events_gaps(spark, d), "value", "fill_forward", order_by=["ts", "event_id"],
                   partition_by="user_id").select("event_id", "user_id", "value")


@register("win3_fill_backward", f"""SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER
  ({W_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EG}""")
def win3(spark, d):
    return cl.fill(fx.events_gaps(spark, d), "value", "fill_backward", order_by=["ts", "event_id"],
                   partition_by="user_id").select("event_id", "user_id", "value")


@register("win4_interpolate", f"""WITH b AS (SELECT event_id, user_id, value,
  row_number() OVER ({W_USER}) AS rn FROM {EG}),
  c AS (SELECT *,
  last_value(value IGNORE NULLS) OVER ({W_USER.replace('ts, event_id', 'rn')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER ({W_USER.replace('ts, event_id', 'rn')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
  first_value(value IGNORE NULLS) OVER ({W_USER.replace('ts, event_id', 'rn')} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER ({W_USER.replace('ts, event_id', 'rn')} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM b)
  SELECT event_id, user_id, round(coalesce(value, pv + (nv - pv) * (rn - pp) / (np - pp), pv), 6) AS value FROM c""")
def win4(spark, d):
    return round_all(cl.fill(fx.events_gaps(spark, d), "value", "interpolate", order_by=["ts", "event_id"],
                             partition_by="user_id").select("event_id", "user_id", "value"))


# ------------------------------------------------------------------ CLN-9..13
@register("cln9_drop_duplicates", f"SELECT DISTINCT * FROM ({fx.ORDERS_DUPS_SQL})")
def cln9(spark, d):
    return cl.drop_duplicates(fx.orders_dups(spark, d))


@register("cln9_first_per_key", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, min(o_orderdate) AS o_orderdate,
  arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey""")
def cln9k(spark, d):
    return cl.drop_duplicates(fx.load(spark, d, "orders"), subset=["o_custkey"], order_by=["o_orderdate", "o_orderkey"])


@register("cln10_clip", f"""SELECT o_orderkey, least(greatest(o_totalprice, 1000.0), 400000.0) AS o_totalprice
  FROM ({fx.ORDERS_OUTLIERS_SQL})""")
def cln10(spark, d):
    return cl.clip(fx.orders_outliers(spark, d), "o_totalprice", 1000.0, 400000.0).select("o_orderkey", "o_totalprice")


@register("cln11_cast_column", f"SELECT o_orderkey, TRY_CAST(price_bad AS DOUBLE) AS price_bad FROM ({fx.ORDERS_TEXT_SQL})")
def cln11(spark, d):
    return cl.cast_column(fx.orders_text(spark, d), "price_bad", "numeric").select("o_orderkey", "price_bad")


@register("cln12_cleaning_plan", f"""SELECT coalesce("column", 'all') AS "column", type AS issue_type,
  CASE type WHEN 'missing_values' THEN 'fill_median' WHEN 'duplicate_rows' THEN 'drop_duplicates'
   WHEN 'data_type' THEN 'cast' WHEN 'column_name' THEN 'standardize_names' WHEN 'outliers' THEN 'clip' END AS action,
  CASE type WHEN 'missing_values' THEN 'high' WHEN 'column_name' THEN 'low' ELSE 'medium' END AS priority,
  type IN ('missing_values', 'duplicate_rows') AS auto_apply,
  CASE WHEN type = 'data_type' THEN coalesce(suggestion, 'string') END AS target_type, lower, upper
  FROM ({ISSUES_SQL})""")
def cln12(spark, d):
    return round_all(cl.cleaning_plan(issues(spark, d)))


@register("cln13_apply_plan", f"""SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
  round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM ({DIRTY_SQL}))), 6) AS o_totalprice,
  o_orderpriority, price_text FROM ({DIRTY_SQL})""")
def cln13(spark, d):
    df = dirty_orders(spark, d)
    plan = cl.cleaning_plan(dq_issues_for(df))
    return round_all(cl.apply_plan(df, plan)[0])


def dq_issues_for(df):
    from tabloom.operators.quality import quality_issues
    return quality_issues(df)


@register("cln13_apply_summary", f"""SELECT (SELECT count(*) FROM ({DIRTY_SQL}))::BIGINT AS rows_before, 6::BIGINT AS cols_before,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DIRTY_SQL})))::BIGINT AS rows_after, 6::BIGINT AS cols_after,
  ((SELECT count(*) FROM ({DIRTY_SQL})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DIRTY_SQL}))))::BIGINT AS rows_removed,
  0::BIGINT AS cols_removed, 2::BIGINT AS steps_applied""")
def cln13s(spark, d):
    df = dirty_orders(spark, d)
    return cl.apply_plan(df, cl.cleaning_plan(dq_issues_for(df)))[1]


# ------------------------------------------------------------------ WIN-1, 5..8
@register("win1_aggregated_mean", """SELECT l_orderkey, l_linenumber, l_suppkey,
  round(avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 6) AS supp_mean FROM lineitem""")
def win1(spark, d):
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return round_all(win.aggregated_feature(li, "supp_mean", "l_suppkey", "l_extendedprice", "mean")
                     .select("l_orderkey", "l_linenumber", "l_suppkey", "supp_mean"))


@register("win1_aggregated_median_nunique", """SELECT l_orderkey, l_linenumber, l.l_suppkey, m.med AS supp_median, m.nu AS supp_parts
  FROM lineitem l JOIN (SELECT l_suppkey, median(l_extendedprice) AS med, CAST(count(DISTINCT l_partkey) AS BIGINT) AS nu
  FROM lineitem GROUP BY 1) m ON l.l_suppkey = m.l_suppkey""")
def win1b(spark, d):
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    out = win.aggregated_feature(li, "supp_median", "l_suppkey", "l_extendedprice", "median")
    out = win.aggregated_feature(out, "supp_parts", "l_suppkey", "l_partkey", "nunique")
    return round_all(out.select("l_orderkey", "l_linenumber", "l_suppkey", "supp_median", "supp_parts"))


@register("win5_sma", f"""SELECT p_type, month, round(CASE WHEN count(demand) OVER w = 3 THEN avg(demand) OVER w END, 6) AS sma
  FROM {DEM} WINDOW w AS (PARTITION BY p_type ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def win5(spark, d):
    return round_all(win.sma(fx.demand_monthly(spark, d), "demand", 3, "month", "p_type").drop("demand"))


@register("win6_wma", f"""SELECT p_type, month, round(0.2 * lag(demand, 2) OVER w + 0.3 * lag(demand, 1) OVER w
  + 0.5 * demand, 6) AS wma FROM {DEM} WINDOW w AS (PARTITION BY p_type ORDER BY month)""")
def win6(spark, d):
    return round_all(win.wma(fx.demand_monthly(spark, d), "demand", [0.2, 0.3, 0.5], "month", "p_type").drop("demand"))


@register("win7_lag_features", f"""SELECT * FROM (SELECT p_type, month, demand, lag(demand, 1) OVER w AS lag_1,
  lag(demand, 2) OVER w AS lag_2, lag(demand, 3) OVER w AS lag_3 FROM {DEM}
  WINDOW w AS (PARTITION BY p_type ORDER BY month))
  WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL""")
def win7(spark, d):
    return win.lag_features(fx.demand_monthly(spark, d), "demand", 3, "month", "p_type")


@register("win8_average_rank", """SELECT l_quantity, CAST(count(*) AS BIGINT) AS n,
  (sum(count(*)) OVER (ORDER BY l_quantity) - count(*)) + (count(*) + 1) / 2.0 AS rank FROM lineitem GROUP BY l_quantity""")
def win8(spark, d):
    from tabloom.operators.stats import average_rank
    li = fx.load(spark, d, "lineitem").select("l_quantity")
    return average_rank(li, "l_quantity").groupBy("l_quantity", "rank").agg(F.count(F.lit(1)).alias("n"))


# Same results through the large-table plans (forced on the test tables so the
# oracle checks them): order-value blocks for ordered fills.
@register("win2_fill_forward_blocks", f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER
  ({W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EG}""")
def win2b(spark, d):
    return cl.fill(fx.events_gaps(spark, d), "value", "fill_forward", order_by=["ts", "event_id"],
                   partition_by="user_id", rows_per_block=997).select("event_id", "user_id", "value")


@register("win3_fill_backward_blocks", registered_sql("win3_fill_backward"))
def win3b(spark, d):
    """The large plan by a text order column: time and id as one text."""
    e = fx.events_gaps(spark, d).withColumn("at", F.concat(F.col("ts").cast("string"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return cl.fill(e, "value", "fill_backward", order_by=["at"], partition_by="user_id", rows_per_block=997) \
        .select("event_id", "user_id", "value")


@register("win6_wma_blocks", f"""SELECT event_id, round(0.2 * lag(value, 2) OVER w + 0.3 * lag(value, 1) OVER w + 0.5 * value, 6) AS wma
  FROM {EG} WINDOW w AS ({W_USER})""")
def win6b(spark, d):
    out = win.wma(fx.events_gaps(spark, d), "value", [0.2, 0.3, 0.5], ["ts", "event_id"], "user_id", rows_per_block=997)
    return round_all(out.select("event_id", "wma"))


@register("win4_interpolate_blocks", registered_sql("win4_interpolate"))
def win4b(spark, d):
    return round_all(cl.fill(fx.events_gaps(spark, d), "value", "interpolate", order_by=["ts", "event_id"],
                             partition_by="user_id", rows_per_block=997).select("event_id", "user_id", "value"))


@register("win1_aggregated_median_buckets", """SELECT l_orderkey, l_linenumber, l.l_suppkey, round(m.med, 6) AS supp_median
  FROM lineitem l JOIN (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1) m
  ON l.l_suppkey = m.l_suppkey""")
def win1m(spark, d):
    """Group medians through the bucketed plan used when a group exceeds one task."""
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    out = win.aggregated_feature(li, "supp_median", "l_suppkey", "l_extendedprice", "median", group_limit=300)
    return round_all(out.select("l_orderkey", "l_linenumber", "l_suppkey", "supp_median"))


@register("win5_sma_blocks", f"""SELECT event_id, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 6) AS sma
  FROM {EG} WINDOW w AS ({W_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def win5b(spark, d):
    """Moving average through the position + shift-join plan used for large series."""
    out = win.sma(fx.events_gaps(spark, d), "value", 3, ["ts", "event_id"], "user_id", rows_per_block=997)
    return round_all(out.select("event_id", "sma"))


@register("win7_lag_features_blocks", f"""SELECT * FROM (SELECT event_id, lag(value, 1) OVER w AS lag_1,
  lag(value, 2) OVER w AS lag_2 FROM {EG} WINDOW w AS ({W_USER}))
  WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL""")
def win7b(spark, d):
    out = win.lag_features(fx.events_gaps(spark, d), "value", 2, ["ts", "event_id"], "user_id", rows_per_block=997)
    return out.select("event_id", "lag_1", "lag_2")


@register("cln4_fill_report", f"""SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
  CAST(count(*) - count(o_totalprice) AS BIGINT) AS missing_before, 0::BIGINT AS missing_after,
  CAST(count(*) - count(o_totalprice) AS BIGINT) AS cells_filled FROM {OM}""")
def cln4r(spark, d):
    before = fx.orders_missing(spark, d)
    return cl.fill_report(before, cl.fill(before, "o_totalprice", "fill_mean"))
