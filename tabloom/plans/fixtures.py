"""Table loaders and derived fixtures.

Each derived fixture exists twice: as a Spark builder and as the SQL text the
DuckDB oracle uses (``*_SQL``), so registered queries and their oracle read the
same rows. Fixtures only inject the dirt the operators are about (NULLs,
duplicates, text numbers...) into whole tables; nothing is subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- missing numbers
def orders_missing(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None))
                        .otherwise(F.col("o_totalprice")))


ORDERS_MISSING_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders"""


# ---------------------------------------------------------------- gaps in events
def events_gaps(spark, d) -> DataFrame:
    e = load(spark, d, "events").drop("props")
    return e.withColumn("value", F.when((F.col("event_id") % 5 == 0) | (F.col("event_id") < 3),
                                        F.lit(None)).otherwise(F.col("value")))


EVENTS_GAPS_SQL = """SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 5 = 0 OR event_id < 3 THEN NULL ELSE value END AS value
  FROM events"""


# ---------------------------------------------------------------- duplicates
def orders_dups(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    return o.unionByName(o.filter(F.col("o_orderkey") % 10 == 0))


ORDERS_DUPS_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0"


# ---------------------------------------------------------------- dirty text
def orders_text(spark, d) -> DataFrame:
    """Price as text with 'n/a' every 20th key, bad price every 5th, dates as text."""
    o = load(spark, d, "orders")
    price = F.format_number(F.col("o_totalprice"), 2)
    price = F.regexp_replace(price, ",", "")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 20 == 0, F.lit("n/a")).otherwise(price).alias("price_txt"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(price).alias("price_bad"),
        F.when(F.col("o_orderkey") % 20 == 0, F.lit("unknown"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_txt"),
        "o_orderstatus", "o_orderpriority")


ORDERS_TEXT_SQL = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_txt,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_bad,
  CASE WHEN o_orderkey % 20 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_txt,
  o_orderstatus, o_orderpriority FROM orders"""


# ---------------------------------------------------------------- misaligned cells
def part_misaligned(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    bad = F.col("p_partkey") % 13 == 0
    return p.select(
        "p_partkey",
        F.when(bad, F.concat_ws(",", "p_brand", "p_type")).otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(bad, F.lit(None)).otherwise(F.col("p_type")).alias("p_type"),
        F.when(bad, F.lit(None)).otherwise(F.col("p_size").cast("string")).alias("p_size"))


PART_MISALIGNED_SQL = """SELECT p_partkey,
  CASE WHEN p_partkey % 13 = 0 THEN p_brand || ',' || p_type ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS p_size
  FROM part"""


# ---------------------------------------------------------------- outliers
def orders_outliers(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0,
                                               F.col("o_totalprice") * 50)
                        .otherwise(F.col("o_totalprice")))


ORDERS_OUTLIERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders"""


# ---------------------------------------------------------------- demand series
def demand_monthly(spark, d) -> DataFrame:
    """Monthly demand per part type.

    lineitem is pre-aggregated to (part, month) before the join so the join
    shuffles one row per part-month instead of one per line item.
    """
    li = load(spark, d, "lineitem")
    per_part = li.groupBy("l_partkey", F.date_trunc("month", "l_shipdate").alias("month")) \
        .agg(F.sum("l_quantity").alias("q"))
    p = load(spark, d, "part").select("p_partkey", "p_type")
    return per_part.join(p, per_part.l_partkey == p.p_partkey) \
        .groupBy("p_type", "month").agg(F.sum("q").alias("demand"))


DEMAND_SQL = """SELECT p_type, date_trunc('month', l_shipdate) AS month,
  sum(l_quantity) AS demand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def demand_intermittent(spark, d) -> DataFrame:
    """Monthly demand per part, months without sales filled with 0.

    The calendar (first to last shipment month overall) is two scalars. Line items
    are dealt by part once; a part's sales become one map of months (a part has at
    most one entry per month), looked up for every month of the calendar, so the
    filled rows are never shuffled or joined. A NULL part has no sales of its own.
    """
    month = F.date_trunc("month", "l_shipdate")
    li = load(spark, d, "lineitem")
    lo, hi = li.agg(F.min(month), F.max(month)).first()  # two scalars, one column read
    months = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("INTERVAL 1 MONTH"))
    per = li.select("l_partkey", month.cast("date").alias("m"), "l_quantity").repartition("l_partkey") \
        .groupBy("l_partkey", "m").agg(F.sum("l_quantity").alias("q"))
    sold = F.when(F.col("m").isNotNull() & F.col("l_partkey").isNotNull(), F.struct("m", "q"))
    sales = per.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(sold)).alias("sales"))
    filled = F.transform(months, lambda m: F.struct(m.cast("timestamp_ntz").alias("month"),
                                                    F.coalesce(F.try_element_at("sales", m), F.lit(0.0)).alias("demand")))
    return sales.select("l_partkey", F.inline(filled))


DEMAND_PART_SQL = """WITH per AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS month,
    sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
  cal AS (SELECT unnest(generate_series((SELECT min(month) FROM per), (SELECT max(month) FROM per),
    INTERVAL 1 MONTH)) AS month),
  grid AS (SELECT p.l_partkey, cal.month FROM (SELECT DISTINCT l_partkey FROM per) p, cal)
  SELECT grid.l_partkey, grid.month, coalesce(per.q, 0.0) AS demand
  FROM grid LEFT JOIN per USING (l_partkey, month)"""


# ---------------------------------------------------------------- fault table
def fault_table(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", (F.col("l_returnflag") == "R").alias("fail"))


FAULT_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag = 'R' AS fail FROM lineitem"""
