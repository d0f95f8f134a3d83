"""Registered queries: statistics (STA-*), features (FE-*), fault diagnosis (FLT-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators import fault as flt
from tabloom.operators import features as fe
from tabloom.operators import stats as st
from tabloom.operators.knn_information import mutual_info_knn
from tabloom.plans import fixtures as fx
from tabloom.plans.queries_profile import round_all, union_sql
from tabloom.plans.registry import register

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FT = f"({fx.FAULT_SQL})"


# ------------------------------------------------------------------ STA-1/2
@register("sta1_pearson", """SELECT 'pearson' AS method, round(r, 6) AS r, CAST(n AS BIGINT) AS n,
  round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT corr(l_quantity, l_extendedprice) AS r,
  count(*) AS n FROM lineitem)""")
def sta1(spark, d):
    c = st.correlation(fx.load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "pearson")
    return c.select("method", F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"))


@register("sta2_spearman", """WITH rk AS (SELECT
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
  SELECT 'spearman' AS method, round(corr(a, b), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM rk""")
def sta2(spark, d):
    c = st.correlation(fx.load(spark, d, "lineitem"), "l_quantity", "l_discount", "spearman")
    return c.select("method", F.round("r", 6).alias("r"), "n")


# ------------------------------------------------------------------ STA-3/4/5
OO = f"({fx.ORDERS_OUTLIERS_SQL})"


@register("sta3_zscore_outliers", f"""SELECT o_orderkey, o_totalprice FROM {OO}, (SELECT avg(o_totalprice) AS m,
  stddev_samp(o_totalprice) AS s FROM {OO}) WHERE abs(o_totalprice - m) > 3 * s""")
def sta3(spark, d):
    return st.outliers(fx.orders_outliers(spark, d), "o_totalprice", "zscore").select("o_orderkey", "o_totalprice")


@register("sta4_iqr_outliers", f"""SELECT o_orderkey, o_totalprice FROM {OO}, (SELECT quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM {OO})
  WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)""")
def sta4(spark, d):
    return st.outliers(fx.orders_outliers(spark, d), "o_totalprice", "iqr").select("o_orderkey", "o_totalprice")


def events_two_times(spark, d):
    e = fx.load(spark, d, "events").select("event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("ts_next", F.lead("ts").over(w))


LAG_SQL = """(SELECT event_id, (epoch_us(ts_next) - epoch_us(ts)) / 1e6 AS lag_seconds FROM (SELECT event_id, ts,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts_next FROM events))"""


@register("sta5_lag_summary", f"""SELECT CAST(count(lag_seconds) AS BIGINT) AS count, round(avg(lag_seconds), 4) AS mean,
  round(stddev_samp(lag_seconds), 4) AS std, round(min(lag_seconds), 4) AS min,
  round(quantile_cont(lag_seconds, 0.25), 4) AS p25, round(quantile_cont(lag_seconds, 0.5), 4) AS p50,
  round(quantile_cont(lag_seconds, 0.75), 4) AS p75, round(max(lag_seconds), 4) AS max FROM {LAG_SQL}""")
def sta5(spark, d):
    _, summary = st.lag_analysis(events_two_times(spark, d), "ts", "ts_next")
    return summary.select("count", *[F.round(c, 4).alias(c) for c in summary.columns if c != "count"])


@register("sta5_lag_outliers", f"""SELECT event_id, round(lag_seconds, 4) AS lag_seconds FROM {LAG_SQL},
  (SELECT avg(lag_seconds) AS m, stddev_samp(lag_seconds) AS s FROM {LAG_SQL})
  WHERE lag_seconds < m - 3 * s OR lag_seconds > m + 3 * s""")
def sta5o(spark, d):
    lagged, _ = st.lag_analysis(events_two_times(spark, d), "ts", "ts_next")
    return st.lag_outliers(lagged).select("event_id", F.round("lag_seconds", 4).alias("lag_seconds"))


# ------------------------------------------------------------------ STA-6..9
def _ttest_sql():
    parts = []
    for f in FEATS:
        parts.append(f"""SELECT '{f}' AS feature, CAST(n1 AS BIGINT) AS n_fault, CAST(n0 AS BIGINT) AS n_normal,
  round(m1, 6) AS mean_fault, round(m0, 6) AS mean_normal,
  round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 4) AS t,
  CAST(n1 + n0 - 2 AS DOUBLE) AS dof FROM (SELECT
  count({f}) FILTER (WHERE fail) AS n1, avg({f}) FILTER (WHERE fail) AS m1, var_samp({f}) FILTER (WHERE fail) AS v1,
  count({f}) FILTER (WHERE NOT fail) AS n0, avg({f}) FILTER (WHERE NOT fail) AS m0,
  var_samp({f}) FILTER (WHERE NOT fail) AS v0 FROM {FT})""")
    return union_sql(parts)


@register("sta6_t_test", _ttest_sql())
def sta6(spark, d):
    t = st.t_test_by_label(fx.fault_table(spark, d), F.col("fail"), FEATS)
    return round_all(t.drop("p_value")).withColumn("t", F.round("t", 4))


@register("sta7_f_regression", union_sql([f"""SELECT '{f}' AS feature,
  round(corr({f}, l_extendedprice) ^ 2 / (1 - corr({f}, l_extendedprice) ^ 2) * (count(*) - 2), 2) AS score,
  CAST(count(*) AS BIGINT) AS n FROM lineitem""" for f in ("l_quantity", "l_discount", "l_tax")]))
def sta7(spark, d):
    s = st.f_regression(fx.load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return s.select("feature", F.round("score", 2).alias("score"), "n")


def _chi2_sql():
    parts = []
    for f in FEATS:
        parts.append(f"""SELECT '{f}' AS feature, round(sum((obs - e) ^ 2 / e), 4) AS score FROM (
  SELECT obs, cnt * 1.0 / sum(cnt) OVER () * sum(obs) OVER () AS e FROM (
  SELECT l_returnflag, count(*) AS cnt, sum({f}) AS obs FROM lineitem GROUP BY 1))""")
    return union_sql(parts)


@register("sta8_chi2", _chi2_sql())
def sta8(spark, d):
    s = st.chi2_scores(fx.load(spark, d, "lineitem"), FEATS, "l_returnflag")
    return s.select("feature", F.round("score", 4).alias("score"))


@register("sta9_mutual_info")
def sta9(spark, d):
    return round_all(st.mutual_info(fx.load(spark, d, "lineitem"), FEATS, "l_returnflag"))


def _cents(spark, d):
    """Events with the value in whole cents, so that equal distances are equal numbers."""
    return fx.load(spark, d, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).alias("cents"))


@register("sta9_mutual_info_knn", """
WITH c AS (SELECT event_type AS y, round(value * 100) AS x FROM events),
s AS (SELECT y, count(*) AS n FROM c GROUP BY y HAVING count(*) > 1),
r AS (SELECT c.y, x, n, least(3, n - 1) AS k, [x, lag(x, 1) OVER w, lag(x, 2) OVER w, lag(x, 3) OVER w] AS lo,
    [x, lead(x, 1) OVER w, lead(x, 2) OVER w, lead(x, 3) OVER w] AS hi
  FROM c JOIN s ON c.y = s.y WINDOW w AS (PARTITION BY c.y ORDER BY x)),
d AS (SELECT y, x, n, k, list_min(list_transform(range(0, k + 1), lambda a: CASE WHEN lo[a + 1] IS NULL OR hi[k - a + 1] IS NULL
    THEN NULL ELSE greatest(x - lo[a + 1], hi[k - a + 1] - x) END)) AS d FROM r),
u AS (SELECT x, d, n, k, count(*) AS w FROM d GROUP BY ALL),
v AS (SELECT x, count(*) AS w FROM d GROUP BY x),
m AS (SELECT u.x, u.d, u.n, u.k, u.w, sum(v.w) AS m FROM u JOIN v
  ON v.x BETWEEN u.x - u.d AND u.x + u.d AND (abs(v.x - u.x) < u.d OR v.x = u.x) GROUP BY ALL),
h AS (SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) - 1.0 / i AS h FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM c))) AS i))
SELECT 'cents' AS feature, round(greatest(0, (SELECT h FROM h WHERE i = (SELECT count(*) FROM d))
  + sum(w * (hk.h - hn.h - hm.h)) / sum(w)), 6) AS score
FROM m JOIN h hk ON hk.i = m.k JOIN h hn ON hn.i = m.n JOIN h hm ON hm.i = m.m""")
def sta9_knn(spark, d):
    return round_all(mutual_info_knn(_cents(spark, d), ["cents"], "event_type", noise=False))


@register("sta9_mutual_info_knn_continuous")
def sta9_knn_continuous(spark, d):
    """Neighbours in the plane of each feature and the price; ties broken by a hash of the row."""
    return mutual_info_knn(fx.load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", classification=False)


# ------------------------------------------------------------------ FE-1..9
def _fe(op, cols, sql):
    def q(spark, d):
        li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATS)
        out = fe.interaction(li, "feat", cols, op)
        return round_all(out.select("l_orderkey", "l_linenumber", "feat"))
    register(f"fe_{op}", f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS feat FROM lineitem")(q)


_fe("multiply", ["l_quantity", "l_extendedprice", "l_discount"], "l_quantity * l_extendedprice * l_discount")
_fe("add", ["l_quantity", "l_tax", "l_discount"], "l_quantity + l_tax + l_discount")
_fe("subtract", ["l_extendedprice", "l_quantity"], "l_extendedprice - l_quantity")
_fe("divide", ["l_extendedprice", "l_discount"], "CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END")
_fe("log_multiply", ["l_quantity", "l_discount"], "ln(greatest(l_quantity, 1e-10)) * ln(greatest(l_discount, 1e-10))")


@register("fe6_standardized", """SELECT l_orderkey, l_linenumber, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS feat
  FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS x FROM lineitem)""")
def fe6(spark, d):
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = fe.interaction(li, "feat", ["l_quantity", "l_extendedprice"], "multiply", scale=True)
    return round_all(out.select("l_orderkey", "l_linenumber", "feat"))


@register("fe7_label_encode", """SELECT c_custkey, c_mktsegment,
  CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment_code FROM customer""")
def fe7(spark, d):
    out, _ = fe.label_encode(fx.load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return out


@register("fe8_minmax_scale", f"""SELECT p_type, month, round(CASE WHEN max(demand) OVER w = min(demand) OVER w THEN 0.0
  ELSE (demand - min(demand) OVER w) / (max(demand) OVER w - min(demand) OVER w) END, 6) AS demand_scaled
  FROM ({fx.DEMAND_SQL}) WINDOW w AS (PARTITION BY p_type)""")
def fe8(spark, d):
    out = fe.minmax_scale(fx.demand_monthly(spark, d), "demand", "p_type")
    return round_all(out.select("p_type", "month", "demand_scaled"))


@register("fe9_time_features", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST((quarter(o_orderdate) - 1) * 3 + 1 AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter
  FROM orders""")
def fe9(spark, d):
    o = fx.load(spark, d, "orders")
    from tabloom.operators.forecast.metrics import quarter_label
    q = o.select("o_orderkey", quarter_label(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("period"))
    return fe.time_features(q, "period", by="o_orderkey").select("o_orderkey", "year", "month", "quarter")


@register("fe9_time_features_ts", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(quarter(ts) AS INTEGER) AS quarter, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER)
  AS time_index FROM events""")
def fe9t(spark, d):
    e = fx.load(spark, d, "events").select("event_id", "user_id", "ts")
    return fe.time_features(e, "ts", order_by=["ts", "event_id"], by="user_id") \
        .select("event_id", "year", "month", "quarter", "time_index")


# ------------------------------------------------------------------ FLT
def fault_text(spark, d):
    li = fx.load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *FEATS,
                     F.when(F.col("l_returnflag") == "R", "true").otherwise("false").alias("fail"))


@register("flt1_label_flag", """SELECT l_returnflag = 'R' AS fail, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def flt1(spark, d):
    t = fault_text(spark, d)
    return t.select(flt.label_flag(t, "fail").alias("fail")).groupBy("fail").agg(F.count(F.lit(1)).alias("n"))


def _fvn_sql():
    parts = []
    for f in FEATS:
        parts.append(f"""SELECT '{f}' AS feature, round(m0, 6) AS mean_normal, round(m1, 6) AS mean_fault,
  round(m1 - m0, 6) AS difference, round(CASE WHEN m0 <> 0 THEN (m1 - m0) / abs(m0) * 100 ELSE 0 END, 6) AS diff_pct
  FROM (SELECT avg({f}) FILTER (WHERE fail) AS m1, avg({f}) FILTER (WHERE NOT fail) AS m0 FROM {FT})""")
    return union_sql(parts)


FVN_SQL = _fvn_sql()


def _fvn(spark, d):
    t = fx.fault_table(spark, d).drop("l_orderkey", "l_linenumber")
    return flt.fault_vs_normal(t, "fail", FEATS)


@register("flt2_fault_vs_normal", FVN_SQL)
def flt2(spark, d):
    comp, _, _ = _fvn(spark, d)
    return round_all(comp.select("feature", "mean_normal", "mean_fault", "difference", "diff_pct"))


@register("flt2_top3", f"SELECT feature, diff_pct FROM ({FVN_SQL}) ORDER BY abs(diff_pct) DESC, feature LIMIT 3")
def flt2t(spark, d):
    _, top, _ = _fvn(spark, d)
    return round_all(top.select("feature", "diff_pct"))


@register("flt2_summary", f"""SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) FILTER (WHERE fail) AS BIGINT)
  AS fault_samples, CAST(count(*) FILTER (WHERE NOT fail) AS BIGINT) AS normal_samples,
  round(count(*) FILTER (WHERE fail) / count(*), 6) AS fault_rate FROM {FT}""")
def flt2s(spark, d):
    _, _, s = _fvn(spark, d)
    return round_all(s)


@register("flt3_health_score", f"""WITH n AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vxx,
  var_samp(l_discount) AS vyy, covar_samp(l_quantity, l_discount) AS vxy FROM {FT} WHERE NOT fail),
  s AS (SELECT l_orderkey, l_linenumber, sqrt(greatest((vyy * (l_quantity - mx) ^ 2 - 2 * vxy * (l_quantity - mx) * (l_discount - my)
   + vxx * (l_discount - my) ^ 2) / (vxx * vyy - vxy * vxy), 0)) AS dist FROM {FT}, n)
  SELECT l_orderkey, l_linenumber, round(dist, 4) AS mahalanobis_distance,
  round(greatest(0, least(100, 100 - dist * 10)), 4) AS health_score,
  CASE WHEN greatest(0, least(100, 100 - dist * 10)) >= 80 THEN 'low'
       WHEN greatest(0, least(100, 100 - dist * 10)) >= 60 THEN 'medium' ELSE 'high' END AS risk_level FROM s""")
def flt3(spark, d):
    t = fx.fault_table(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "fail")
    h = flt.health_score(t, "fail", ["l_quantity", "l_discount"])
    return h.select("l_orderkey", "l_linenumber", F.round("mahalanobis_distance", 4).alias("mahalanobis_distance"),
                    F.round("health_score", 4).alias("health_score"), "risk_level")


CLUSTER_SQL = "CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END"


def _profile_sql():
    normal = ", ".join(f"avg({f}) FILTER (WHERE l_returnflag <> 'R') AS n_{f}" for f in FEATS)
    per = ", ".join(f"avg({f}) AS c_{f}" for f in FEATS)
    long = union_sql([f"SELECT cluster, '{f}' AS feature, c_{f} AS value, n_{f} AS normal FROM per, nm WHERE n_{f} <> 0"
                      for f in FEATS])
    return f"""WITH nm AS (SELECT {normal} FROM lineitem),
  per AS (SELECT {CLUSTER_SQL} AS cluster, count(*) AS count, {per} FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  lg AS ({long}),
  sig AS (SELECT cluster, feature, abs((value - normal) / abs(normal) * 100) AS diff_pct,
    CASE WHEN value - normal > 0 THEN 'high' ELSE 'low' END AS status FROM lg
    WHERE abs((value - normal) / abs(normal) * 100) > 20),
  rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY diff_pct DESC, feature) AS r FROM sig),
  top AS (SELECT cluster, list(feature || '(' || status || ')' ORDER BY r) FILTER (WHERE r <= 3) AS top_features,
    list(feature || ' ' || status ORDER BY r) FILTER (WHERE r <= 2) AS names,
    avg(diff_pct) FILTER (WHERE r <= 3) AS avg_dev FROM rk GROUP BY cluster)
  SELECT per.cluster, CAST(per.count AS BIGINT) AS count, round(per.count * 100.0 / sum(per.count) OVER (), 6) AS pct,
    coalesce(top.top_features, []::VARCHAR[]) AS top_features,
    CASE WHEN len(top.names) > 0 THEN array_to_string(top.names, '+') || ' fault'
      ELSE 'pattern ' || CAST(per.cluster + 1 AS VARCHAR) || ' fault' END AS name,
    CASE WHEN avg_dev IS NULL THEN 'medium' WHEN avg_dev > 50 THEN 'high' WHEN avg_dev > 30 THEN 'medium'
      ELSE 'low' END AS severity
  FROM per LEFT JOIN top ON per.cluster = top.cluster"""


@register("flt4_pattern_profile", _profile_sql())
def flt4p(spark, d):
    li = fx.load(spark, d, "lineitem")
    normal = li.filter("l_returnflag <> 'R'").agg(*[F.avg(f).alias(f) for f in FEATS]).first().asDict()
    assigned = li.filter("l_returnflag = 'R'").withColumn("cluster", F.expr(CLUSTER_SQL))
    return round_all(flt.cluster_profile(assigned, normal))


@register("flt4_fault_patterns")
def flt4(spark, d):
    t = fx.fault_table(spark, d).drop("l_orderkey", "l_linenumber")
    return round_all(flt.fault_patterns(t, "fail", 3, FEATS, n_init=3))


DT_COLS = ["l_quantity", "l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_extendedprice"]


@register("sta10_detect_task", union_sql([f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS distinct,
  CASE WHEN {"true" if c in ("l_returnflag", "l_linestatus") else "false"} OR count(DISTINCT {c}) < 10
  THEN 'classification' ELSE 'regression' END AS task FROM lineitem""" for c in DT_COLS]))
def sta10(spark, d):
    return st.detect_tasks(fx.load(spark, d, "lineitem"), DT_COLS)


@register("sta2_spearman_buckets", """WITH rk AS (SELECT
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
  SELECT 'spearman' AS method, round(corr(a, b), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM rk""")
def sta2b(spark, d):
    """Ranks through the bucketed plan used for columns with many distinct values."""
    c = st.correlation(fx.load(spark, d, "lineitem"), "l_extendedprice", "l_discount", "spearman",
                       small_distinct=0)
    return c.select("method", F.round("r", 6).alias("r"), "n")
