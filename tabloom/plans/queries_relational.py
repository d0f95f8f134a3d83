"""Registered queries: projections, joins, set operations, sort/limit, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.expressions import r
from tabloom.operators import relational as rel
from tabloom.operators import sampling as smp
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import REGISTRY, register
from tabloom.session import scratch_path
from tabloom.sources.catalog import Catalog
from tabloom.sources.paged import read_page, write_paged

H = "((({k}) + 42) * 2654435761) % 4294967296"


def _o(spark, d):
    return fx.load(spark, d, "orders")


# ------------------------------------------------------------------ PRJ
@register("prj1_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def prj1(spark, d):
    return rel.project(_o(spark, d), include=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"],
                       exclude=["o_orderstatus"])


@register("prj2_query", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
  WHERE l_quantity > 30 AND l_returnflag IN ('R', 'A')""")
def prj2(spark, d):
    return rel.query(fx.load(spark, d, "lineitem"), "l_quantity > 30 & l_returnflag in ['R', 'A']",
                     columns=["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])


@register("prj2_query_report", """SELECT CAST(count(*) AS BIGINT) AS rows_in,
  CAST(count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag IN ('R','A')) AS BIGINT) AS rows_selected,
  CAST(count(*) - count(*) FILTER (WHERE l_quantity > 30 AND l_returnflag IN ('R','A')) AS BIGINT) AS rows_filtered
  FROM lineitem""")
def prj2r(spark, d):
    return rel.query_report(fx.load(spark, d, "lineitem"), "l_quantity > 30 & l_returnflag in ['R', 'A']")


@register("prj3_create_column", """SELECT o_orderkey,
  round(o_totalprice / 1000 + length(o_orderpriority), 6) AS price_score FROM orders""")
def prj3(spark, d):
    o = rel.create_column(_o(spark, d), "price_score", "o_totalprice / 1000 + length(o_orderpriority)")
    return o.select("o_orderkey", r(F.col("price_score")).alias("price_score"))


@register("prj4_cross_dataset_column", """SELECT c_custkey,
  round(c_acctbal / (n_regionkey + 1), 6) AS bal_per_region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def prj4(spark, d):
    nat = fx.load(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    out = rel.create_column(fx.load(spark, d, "customer"), "bal_per_region",
                            "df.c_acctbal / (nat.n_regionkey + 1)", sources={"nat": nat}, on="c_nationkey")
    return out.select("c_custkey", r(F.col("bal_per_region")).alias("bal_per_region"))


@register("prj5_apply_mapping", """SELECT p_partkey AS part_id, p_name AS part_name, p_brand, p_type,
  p_size, p_retailprice FROM part""")
def prj5(spark, d):
    return rel.apply_mapping(fx.load(spark, d, "part"),
                             {"p_partkey": "part_id", "p_name": "part_name", "absent": "x"})


BAD_NAMES = ("Order Key", "total$price", "  'Order Status'  ",
             "a_very_long_column_name_that_goes_on_and_on_beyond_fifty_chars")


def bad_names(spark, d):
    o = _o(spark, d)
    return o.select(F.col("o_orderkey").alias(BAD_NAMES[0]), F.col("o_totalprice").alias(BAD_NAMES[1]),
                    F.col("o_orderstatus").alias(BAD_NAMES[2]), F.col("o_orderpriority").alias(BAD_NAMES[3]))


@register("prj6_standardize_columns", """SELECT o_orderkey AS order_key, o_totalprice AS total_price,
  o_orderstatus AS order_status,
  o_orderpriority AS a_very_long_column_name_that_goes_on_and_on_beyond_fifty_chars FROM orders""")
def prj6(spark, d):
    return rel.standardize_columns(bad_names(spark, d))


PRJ7 = """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders,
  round(avg(o_totalprice), 6) AS avg_price FROM orders GROUP BY o_orderpriority"""


@register("prj7_sql", PRJ7)
def prj7(spark, d):
    cat = Catalog(spark)
    cat.create(_o(spark, d), "orders")
    return cat.sql(PRJ7.replace("FROM orders", "FROM " + cat.view_name("orders")))


# ------------------------------------------------------------------ JN


def cust_nullkeys(spark, d):
    c = fx.load(spark, d, "customer")
    return c.withColumn("c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.lit(None))
                        .otherwise(F.col("c_custkey")))


def orders_nullkeys(spark, d):
    o = _o(spark, d).select("o_orderkey", "o_custkey", "o_totalprice")
    return o.withColumn("o_custkey", F.when(F.col("o_custkey") % 11 == 0, F.lit(None))
                        .otherwise(F.col("o_custkey")))


CN = "(SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
ON = "(SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders)"
JCOLS = "o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _jn(how):
    def q(spark, d):
        return rel.join(orders_nullkeys(spark, d), cust_nullkeys(spark, d), how,
                        left_on="o_custkey", right_on="c_custkey")
    return q


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    register(f"jn_{_how}", f"SELECT {JCOLS} FROM {ON} o {_sql} {CN} c ON o.o_custkey = c.c_custkey")(_jn(_how))


def _supp_nation(spark, d):
    s = fx.load(spark, d, "supplier").withColumnRenamed("s_nationkey", "nationkey") \
        .withColumnRenamed("s_name", "name")
    n = fx.load(spark, d, "nation").withColumnRenamed("n_nationkey", "nationkey") \
        .withColumnRenamed("n_name", "name")
    return s, n


@register("jn_same_key_suffixes", """SELECT s_suppkey, s.s_name AS name_x, s_nationkey AS nationkey, s_acctbal,
  n.n_name AS name_y, n_regionkey FROM supplier s JOIN nation n ON s_nationkey = n_nationkey""")
def jn_suffix(spark, d):
    s, n = _supp_nation(spark, d)
    return rel.join(s, n, "inner", on="nationkey")


@register("jn_outer_merged_key", """SELECT coalesce(n.n_nationkey, c.c_nationkey) AS nationkey, n_name,
  CAST(c.n AS BIGINT) AS n_customers FROM (SELECT CASE WHEN n_regionkey = 0 THEN n_nationkey + 100 ELSE n_nationkey END
  AS n_nationkey, n_name FROM nation) n
  FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON n.n_nationkey = c.c_nationkey""")
def jn_outer_merged(spark, d):
    """Whole tables; the nations of one region get other keys, so both sides have
    rows without a match."""
    key = F.when(F.col("n_regionkey") == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))
    n = fx.load(spark, d, "nation").select(key.alias("nationkey"), "n_name")
    c = fx.load(spark, d, "customer").groupBy(
        F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return rel.join(n, c, "outer", on="nationkey")


@register("jn_report", f"""SELECT (SELECT count(*) FROM {ON}) AS left_rows, 3::BIGINT AS left_cols,
  (SELECT count(*) FROM {CN}) AS right_rows, 5::BIGINT AS right_cols,
  (SELECT count(*) FROM {ON} o JOIN {CN} c ON o.o_custkey = c.c_custkey) AS result_rows,
  8::BIGINT AS result_cols, 0::BIGINT AS common_cols, 3::BIGINT AS left_only_cols, 5::BIGINT AS right_only_cols""")
def jn_report(spark, d):
    lft, rgt = orders_nullkeys(spark, d), cust_nullkeys(spark, d)
    res = rel.join(lft, rgt, "inner", left_on="o_custkey", right_on="c_custkey")
    return rel.join_report(lft, rgt, res)


# ------------------------------------------------------------------ SET
@register("set1_union", f"SELECT * FROM orders UNION ALL {fx.ORDERS_DUPS_SQL}")
def set1(spark, d):
    return rel.combine([_o(spark, d), fx.orders_dups(spark, d)], "union")


@register("set2_union_fill_missing", """SELECT c_custkey, c_name, c_nationkey, NULL::DOUBLE AS c_acctbal,
  NULL::VARCHAR AS c_mktsegment FROM customer UNION ALL
  SELECT c_custkey, NULL, NULL, c_acctbal, c_mktsegment FROM customer""")
def set2(spark, d):
    c = fx.load(spark, d, "customer")
    return rel.combine([c.select("c_custkey", "c_name", "c_nationkey"),
                        c.select("c_custkey", "c_acctbal", "c_mktsegment")], "union", match_columns=False)


@register("set3_intersection", f"SELECT * FROM orders INTERSECT ({fx.ORDERS_MISSING_SQL}) INTERSECT ({fx.ORDERS_DUPS_SQL})")
def set3(spark, d):
    return rel.combine([_o(spark, d), fx.orders_missing(spark, d), fx.orders_dups(spark, d)], "intersection")


@register("set4_difference", f"SELECT * FROM ({fx.ORDERS_DUPS_SQL}) EXCEPT ({fx.ORDERS_MISSING_SQL})")
def set4(spark, d):
    return rel.combine([fx.orders_dups(spark, d), fx.orders_missing(spark, d)], "difference")


@register("set5_report", f"""SELECT 2::BIGINT AS n_inputs,
  ((SELECT count(*) FROM orders) + (SELECT count(*) FROM ({fx.ORDERS_DUPS_SQL})))::BIGINT AS total_rows_in,
  (SELECT count(*) FROM (SELECT * FROM orders INTERSECT ({fx.ORDERS_DUPS_SQL})))::BIGINT AS rows_out,
  6::BIGINT AS common_cols""")
def set5(spark, d):
    dfs = [_o(spark, d), fx.orders_dups(spark, d)]
    return rel.combine_report(dfs, rel.combine(dfs, "intersection"))


# ------------------------------------------------------------------ SRT
@register("srt1_head", """SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def srt1(spark, d):
    return rel.head(_o(spark, d).select("o_orderkey", "o_totalprice"), 10,
                    [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@register("srt2_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def srt2(spark, d):
    return rel.page(_o(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", skip=100, limit=50)


DEEP_COLS = "l_orderkey, l_linenumber, l_extendedprice"


@register("src6_deep_page", f"""SELECT {DEEP_COLS}, pos FROM (SELECT {DEEP_COLS},
  CAST(row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS BIGINT) AS pos FROM lineitem)
  WHERE pos BETWEEN 5000 AND 5199""")
def src6_deep(spark, d):
    """A page of a sorted, indexed copy of the whole table."""
    items = fx.load(spark, d, "lineitem").select(*DEEP_COLS.split(", "))
    path = write_paged(items, scratch_path(spark, "paged"), ["l_extendedprice", "l_orderkey", "l_linenumber"])
    return read_page(spark, path, skip=5000, limit=200, position="pos")


@register("srt3_top_abs", """SELECT o_orderkey, round(o_totalprice - 150000, 6) AS dev FROM orders
  ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey LIMIT 3""")
def srt3(spark, d):
    o = _o(spark, d).select("o_orderkey", r(F.col("o_totalprice") - 150000).alias("dev"))
    return rel.top_abs(o, "dev", 3, tie_breaker="o_orderkey")


@register("srt4_rank_desc", """SELECT n_name, CAST(count(*) AS BIGINT) AS customers,
  row_number() OVER (ORDER BY count(*) DESC, n_name) AS rank
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def srt4(spark, d):
    c = fx.load(spark, d, "customer").join(fx.load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scores = c.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    return rel.rank_desc(scores, "customers", "n_name").withColumn("rank", F.col("rank").cast("long"))


@register("srt5_last_per_group", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id,
  max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
  FROM events GROUP BY user_id""")
def srt5(spark, d):
    e = fx.load(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return rel.last_per_group(e, ["ts", "event_id"], "user_id")


# ------------------------------------------------------------------ SMP
@register("smp1_sample_n", f"SELECT * FROM orders ORDER BY {H.format(k='o_orderkey')} LIMIT 100")
def smp1(spark, d):
    return smp.sample(_o(spark, d), n=100, key="o_orderkey")


@register("smp2_sample_frac", f"SELECT * FROM orders ORDER BY {H.format(k='o_orderkey')} LIMIT (SELECT round_even(count(*) * 0.5, 0) FROM orders)")
def smp2(spark, d):
    return smp.sample(_o(spark, d), frac=0.5, key="o_orderkey", topk_limit=0)


@register("smp3_stratified", f"""SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format(k='o_orderkey')}) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS cnt FROM orders) WHERE rn <= round_even(cnt * 0.1, 0)""")
def smp3(spark, d):
    return smp.sample(_o(spark, d), frac=0.1, key="o_orderkey", stratify_by="o_orderpriority") \
        .select("o_orderkey", "o_orderpriority")


@register("smp5_train_test_split", f"""SELECT o_orderkey, rn <= ceil(0.2 * cnt) AS is_test FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {H.format(k='o_orderkey')}) AS rn,
  count(*) OVER () AS cnt FROM orders)""")
def smp5(spark, d):
    return smp.train_test_split(_o(spark, d), 0.2, key="o_orderkey").select("o_orderkey", "is_test")


@register("smp6_time_split", f"""WITH d AS ({fx.DEMAND_SQL}) SELECT p_type, month,
  row_number() OVER (PARTITION BY p_type ORDER BY month) > floor(count(*) OVER (PARTITION BY p_type) * 0.8) AS is_test
  FROM d""")
def smp6(spark, d):
    return smp.time_split(fx.demand_monthly(spark, d), "month", 0.2, "p_type").select("p_type", "month", "is_test")


@register("smp7_kfold", f"""SELECT CAST(({H.format(k='o_orderkey')}) % 5 AS INTEGER) AS fold,
  CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def smp7(spark, d):
    return smp.kfold(_o(spark, d), 5, key="o_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ PIP
WORKFLOW_STEPS = [
    {"id": "s1", "op": "query", "inputs": {"df": "orders_in"}, "output": "big",
     "args": {"predicate": "o_totalprice > 100000 & o_orderstatus in ['F', 'O']"}},
    {"id": "s2", "op": "aggregated_feature", "inputs": {"df": "big"}, "output": "feat",
     "args": {"name": "cust_mean", "by": "o_custkey", "target": "o_totalprice", "agg": "mean"}},
    {"id": "s3", "op": "project", "inputs": {"df": "feat"}, "output": "final",
     "args": {"include": ["o_orderkey", "o_custkey", "cust_mean"]}},
    {"id": "s4", "op": "not_an_operator", "inputs": {"df": "final"}, "ok": False},
]


@register("pip2_replay_workflow", """SELECT o_orderkey, o_custkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6)
  AS cust_mean FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')""")
def pip2(spark, d):
    from tabloom.plans import workflow as wf
    from tabloom.plans.queries_profile import round_all
    spec = wf.record(WORKFLOW_STEPS, "orders analysis", datasets=["orders_in"])
    cat = Catalog(spark)
    cat.create(_o(spark, d), "orders_table")
    out = wf.replay(spec, {"orders_in": "orders_table"}, cat)
    return round_all(out["final"])


MODEL_STEPS = [
    {"id": "m1", "op": "drop_duplicates", "inputs": {"df": "parts_in"}, "output": "clean", "args": {"subset": ["p_partkey"]}},
    {"id": "m2", "op": "interaction", "inputs": {"df": "clean"}, "output": "feat",
     "args": {"name": "x", "columns": ["p_size", "p_partkey"], "op": "add"}},
    {"id": "m3", "op": "fit_predict", "inputs": {"df": "feat"}, "output": "predicted",
     "args": {"features": ["x"], "target": "p_retailprice", "model_type": "linear_regression", "key": "p_partkey"}},
    {"id": "m4", "op": "regression_metrics", "inputs": {"pred": "predicted"}, "output": "metrics",
     "args": {"label": "p_retailprice", "prediction": "predictions"}},
]


@register("pip2_replay_model", f"""WITH f AS (SELECT p_retailprice AS y, CAST(p_size + p_partkey AS DOUBLE) AS x,
  row_number() OVER (ORDER BY {H.format(k='p_partkey')}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM part),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f WHERE NOT is_test),
e AS (SELECT y, a + b * x - y AS e FROM f, m WHERE is_test)
SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
  round(1 - sum(e * e) / (var_pop(y) * count(y)), 4) AS r2, CAST(count(*) AS BIGINT) AS n FROM e""")
def pip2m(spark, d):
    """Clean, make a feature, fit, predict and judge, replayed over another table name."""
    from tabloom.plans import workflow as wf
    from tabloom.plans.queries_profile import round_all
    spec = wf.record(MODEL_STEPS, "price model", datasets=["parts_in"])
    cat = Catalog(spark)
    cat.create(fx.load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "part_table")
    out = wf.replay(spec, {"parts_in": "part_table"}, cat)["metrics"]
    if not hasattr(out, "columns"):
        raise RuntimeError(out.error)
    return round_all(out, 4)


# ------------------------------------------------------------------ SRC / SNK
def _scratch(spark, tag):
    """A fresh folder under the shared checkpoint directory (never a local tmp)."""
    import uuid
    from tabloom.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("src1_csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src1(spark, d):
    from tabloom.sources import files
    path = _scratch(spark, "csv")
    o = _o(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o.write.option("header", "true").option("sep", "\t").csv(path)
    return files.read_csv(spark, path, sep="\t")


@register("src2_csv_dialect", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src2(spark, d):
    from tabloom.sources import files
    path = _scratch(spark, "csv")
    files.write_csv(fx.load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.read_csv_dialect(spark, path)


@register("snk2_parquet_export_import", "SELECT * FROM part")
def snk2(spark, d):
    from tabloom.sources import files
    path = files.export_table(fx.load(spark, d, "part"), _scratch(spark, "export"))
    return files.import_table(spark, path)


_SHAPE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


SHAPES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS id, CAST(count(*) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS BIGINT)"
    f" AS columns FROM {t}" for t in _SHAPE_TABLES)


@register("src7_shapes", SHAPES_SQL)
def src7(spark, d):
    cat = Catalog(spark)
    for t in _SHAPE_TABLES:
        cat.create(fx.load(spark, d, t), t)
    return cat.shapes()


@register("src8_overview_preview", """SELECT o_orderkey AS "Order", o_totalprice AS "Total price", o_orderstatus
  FROM orders ORDER BY o_orderkey LIMIT 5""")
def src8(spark, d):
    from tabloom.sources.catalog import overview
    cat = Catalog(spark)
    cat.create(_o(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), "orders")
    labelled = cat.set_labels("orders", {"o_orderkey": "Order", "o_totalprice": "Total price"})
    _, preview = overview(labelled, 5, order_by="o_orderkey")
    return preview


# Large-table plans forced on the test tables (checked by the same oracle SQL).
@register("smp3_stratified_histogram", f"""SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format(k='o_orderkey')}) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS cnt FROM orders) WHERE rn <= round_even(cnt * 0.1, 0)""")
def smp3h(spark, d):
    return smp.sample(_o(spark, d), frac=0.1, key="o_orderkey", stratify_by="o_orderpriority", window_limit=0) \
        .select("o_orderkey", "o_orderpriority")


@register("smp6_time_split_blocks", f"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
  > floor(count(*) OVER (PARTITION BY user_id) * 0.8) AS is_test FROM events""")
def smp6b(spark, d):
    e = fx.load(spark, d, "events").select("event_id", "user_id", "ts")
    return smp.time_split(e, ["ts", "event_id"], 0.2, "user_id", rows_per_block=997).select("event_id", "is_test")


@register("smp5_train_test_split_histogram", REGISTRY["smp5_train_test_split"][1])
def smp5h(spark, d):
    return smp.train_test_split(_o(spark, d), 0.2, key="o_orderkey", topk_limit=0).select("o_orderkey", "is_test")
