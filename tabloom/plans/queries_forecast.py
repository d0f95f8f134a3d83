"""Registered forecasting queries (FCT-*, WIN-5..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.expressions import r
from tabloom.operators.forecast import moving
from tabloom.operators.forecast.metrics import forecast_metrics
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import register
from tabloom.session import scratch_path
from tabloom.streaming.state import run_available, smooth_stream

DEMAND = f"WITH d AS ({fx.DEMAND_SQL})"


def _metric_cols(prefix=""):
    return [r(F.col(c)).alias(c) for c in ("mape", "mae", "mse", "rmse", "r2")] + \
        [F.col("n").cast("long").alias("n")]


def flagship(spark, d):
    """Demand per part type -> SMA(3) one-step forecast -> metrics -> best 3."""
    dem = fx.demand_monthly(spark, d)
    fc = moving.sma_forecast(dem, "demand", "month", ["p_type"], window_size=3)
    m = forecast_metrics(fc, by=["p_type"])
    return m.orderBy("mape", "p_type").limit(3).select("p_type", *_metric_cols())


_METRICS_SQL = """round(avg(abs((predicted - actual) / CASE WHEN actual = 0 THEN 1e-10 ELSE actual END)), 6) AS mape,
  round(avg(abs(predicted - actual)), 6) AS mae,
  round(avg((predicted - actual) * (predicted - actual)), 6) AS mse,
  round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
  round(CASE WHEN var_pop(actual) * count(actual) = 0 THEN 0.0
        ELSE 1 - sum((predicted - actual) * (predicted - actual)) / (var_pop(actual) * count(actual)) END, 6) AS r2,
  CAST(count(*) AS BIGINT) AS n"""

FLAGSHIP_SQL = DEMAND + """,
f AS (SELECT p_type, month, demand AS actual,
  CASE WHEN count(demand) OVER w = 3 THEN avg(demand) OVER w END AS predicted
  FROM d WINDOW w AS (PARTITION BY p_type ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT p_type, """ + _METRICS_SQL + """
FROM f WHERE predicted IS NOT NULL GROUP BY p_type ORDER BY mape, p_type LIMIT 3"""

register("fct1_sma_top3", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------- FCT-1 / FCT-2
from tabloom.operators.forecast import arima as ar  # noqa: E402
from tabloom.operators.forecast import intermittent as im  # noqa: E402
from tabloom.operators.forecast import network as nn  # noqa: E402
from tabloom.operators.forecast import regressors as rg  # noqa: E402
from tabloom.operators.forecast import smoothing as sm  # noqa: E402
from tabloom.operators.forecast.metrics import (choose_best, forecast_summary,  # noqa: E402
                                                future_periods)
from tabloom.plans.queries_profile import round_all  # noqa: E402

SMA_FC_SQL = DEMAND + """,
f AS (SELECT p_type, month, demand AS actual,
  CASE WHEN count(demand) OVER w = 3 THEN avg(demand) OVER w END AS predicted,
  row_number() OVER (PARTITION BY p_type ORDER BY month) > floor(count(*) OVER (PARTITION BY p_type) * 0.8) AS is_test
  FROM d WINDOW w AS (PARTITION BY p_type ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


@register("fct1_sma_forecast", SMA_FC_SQL + """
SELECT p_type, month, actual, round(predicted, 6) AS predicted, is_test FROM f""")
def fct1f(spark, d):
    return round_all(moving.sma_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3))


@register("fct1_sma_metrics", SMA_FC_SQL + """
SELECT p_type, """ + _METRICS_SQL + """ FROM f WHERE predicted IS NOT NULL GROUP BY p_type""")
def fct1m(spark, d):
    m = moving.sma_metrics(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3)
    return m.select("p_type", *_metric_cols())


def _wma_sql():
    parts = []
    for i, w in enumerate(moving.DEFAULT_WEIGHTS):
        pred = f"{w[0]} * lag(demand, 3) OVER w + {w[1]} * lag(demand, 2) OVER w + {w[2]} * lag(demand, 1) OVER w"
        parts.append(f"SELECT p_type, month, demand AS actual, {i} AS candidate, {pred} AS predicted "
                     f"FROM d WINDOW w AS (PARTITION BY p_type ORDER BY month)")
    return DEMAND + ", s AS (" + " UNION ALL ".join(parts) + """),
m AS (SELECT p_type, candidate, """ + _METRICS_SQL + """ FROM s WHERE predicted IS NOT NULL GROUP BY ALL)
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY mape, candidate) AS rk FROM m)
WHERE rk = 1"""


@register("fct2_wma_search", _wma_sql())
def fct2(spark, d):
    m = moving.wma_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3)
    return m.select("p_type", F.col("candidate").cast("integer").alias("candidate"), *_metric_cols())


# ---------------------------------------------------------------- FCT-3
SES_GRID = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
SES_SQL = DEMAND + f""",
f AS (SELECT p_type, month, demand AS value, row_number() OVER (PARTITION BY p_type ORDER BY month) AS pos,
  floor(count(*) OVER (PARTITION BY p_type) * 0.8) AS n_train FROM d),
tr AS (SELECT p_type, list(value ORDER BY month) FILTER (WHERE pos <= n_train) AS arr FROM f GROUP BY p_type),
c AS (SELECT p_type, alpha, list_reduce(arr[2:], lambda acc, x: acc * (1 - alpha) + x * alpha, arr[1]) AS level
  FROM tr, (SELECT unnest({SES_GRID}::DOUBLE[]) AS alpha)),
m AS (SELECT f.p_type, c.alpha,
  round(avg(CASE WHEN value <> 0 THEN abs((level - value) / value) END), 6) AS mape,
  round(avg(abs(level - value)), 6) AS mae, round(avg((level - value) ^ 2), 6) AS mse,
  round(sqrt(avg((level - value) ^ 2)), 6) AS rmse,
  round(CASE WHEN var_pop(value) * count(value) = 0 THEN 0.0
    ELSE 1 - sum((level - value) ^ 2) / (var_pop(value) * count(value)) END, 6) AS r2,
  CAST(count(*) AS BIGINT) AS n, round(max(level), 6) AS level
  FROM f JOIN c ON f.p_type = c.p_type WHERE pos > n_train GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY mape, alpha) = 1 AS best FROM m"""


@register("fct3_ses_search", SES_SQL)
def fct3(spark, d):
    return round_all(sm.ses_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], select_on="test"))


def _no_lists(df):
    """The scalar columns of a search result."""
    return df.drop("actual", "predicted", "future")


@register("fct4_5_double_triple_smoothing")
def fct45(spark, d):
    return round_all(_no_lists(sm.smoothing_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"])))


@register("fct4_double_smoothing", DEMAND + """,
s AS (SELECT p_type, list(demand::DOUBLE ORDER BY month) AS y, count(*) AS n,
  CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) AS k FROM d GROUP BY p_type),
g AS (SELECT round(0.1 * i, 1) AS v FROM (SELECT unnest(range(1, 10)) AS i)),
f AS (SELECT p_type, y, n, k, a.v AS alpha, b.v AS beta, list_reduce(list_slice(y, 2, k),
    lambda acc, x: {'l': a.v * x + (1 - a.v) * (acc.l + acc.b),
      'b': b.v * ((a.v * x + (1 - a.v) * (acc.l + acc.b)) - acc.l) + (1 - b.v) * acc.b},
    {'l': y[1], 'b': y[2] - y[1]}) AS st
  FROM s, g a, g b WHERE k >= 2 AND n > k),
e AS (SELECT p_type, alpha, beta, n - k AS n_test, y[k + h] AS a, st.l + st.b * h AS p
  FROM (SELECT *, unnest(range(1, n - k + 1)) AS h FROM f)),
m AS (SELECT p_type, alpha, beta, n_test, avg(CASE WHEN a <> 0 THEN abs((p - a) / a) END) AS mape,
  avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse FROM e GROUP BY ALL)
SELECT p_type, alpha, beta, n_test, round(mape, 6) AS mape, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(mape, 10), alpha, beta) AS rk FROM m) WHERE rk = 1""")
def fct4(spark, d):
    out = sm.smoothing_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], methods=("double",))
    return round_all(out.filter("warning IS NULL").select("p_type", "alpha", "beta", "n_test", "mape", "mae", "rmse"))


@register("fct3_ses_stream", """WITH f AS (SELECT event_type, ts, value FROM events
  WHERE value IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT event_type, list(value ORDER BY ts, value) AS arr FROM f
  WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM f) GROUP BY event_type)
SELECT event_type, CAST(len(arr) AS BIGINT) AS n,
  round(list_reduce(arr[2:], lambda acc, x: acc * 0.8 + x * 0.2, arr[1]), 6) AS level FROM s""")
def fct3_stream(spark, d):
    """The whole table as a stream: every series' level at the last watermark."""
    events = fx.load(spark, d, "events")
    # A pattern, as a stream takes a plain path for a folder and the table may be one file.
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    out = scratch_path(spark, "smooth")
    run_available(smooth_stream(stream, "value", "ts", "event_type", 0.2, "1 hour"), f"{out}/rows", f"{out}/state")
    last = spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.max(F.struct("n", "level")).alias("last"))
    return last.select("event_type", "last.n", r(F.col("last.level")).alias("level"))


@register("fct3_ses_blocks", SES_SQL)
def fct3_blocks(spark, d):
    """The plan for long series, forced on the small table."""
    return round_all(sm.ses_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], select_on="test", plan="blocks", block=16))


#: The total demand as one series without keys, and double smoothing of it.
TOTAL = DEMAND + """,
s AS (SELECT list(demand::DOUBLE ORDER BY month) AS y, count(*) AS n, CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) AS k
  FROM (SELECT month, sum(demand) AS demand FROM d GROUP BY month)),
g AS (SELECT round(0.1 * i, 1) AS v FROM (SELECT unnest(range(1, 10)) AS i))"""


def _total(spark, d):
    return fx.demand_monthly(spark, d).groupBy("month").agg(F.sum("demand").alias("demand"))


@register("fct4_one_series_blocks", TOTAL + """,
f AS (SELECT y, n, k, a.v AS alpha, b.v AS beta, list_reduce(list_slice(y, 2, k),
    lambda acc, x: {'l': a.v * x + (1 - a.v) * (acc.l + acc.b),
      'b': b.v * ((a.v * x + (1 - a.v) * (acc.l + acc.b)) - acc.l) + (1 - b.v) * acc.b},
    {'l': y[1], 'b': y[2] - y[1]}) AS st
  FROM s, g a, g b WHERE k >= 2 AND n > k),
e AS (SELECT alpha, beta, n - k AS n_test, y[k + h] AS a, st.l + st.b * h AS p
  FROM (SELECT *, unnest(range(1, n - k + 1)) AS h FROM f)),
m AS (SELECT alpha, beta, n_test, avg(CASE WHEN a <> 0 THEN abs((p - a) / a) END) AS mape,
  avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse FROM e GROUP BY ALL)
SELECT alpha, beta, n_test, round(mape, 6) AS mape, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM m
ORDER BY round(mape, 10), alpha, beta LIMIT 1""")
def fct4_total(spark, d):
    out = sm.smoothing_search(_total(spark, d), "demand", "month", methods=("double",), block=16)
    return round_all(out.select("alpha", "beta", "n_test", "mape", "mae", "rmse"))


@register("fct3_ses_estimated", DEMAND + """,
s AS (SELECT p_type, list(demand::DOUBLE ORDER BY month) AS y, count(*) AS n,
  CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) AS k FROM d GROUP BY p_type),
g AS (SELECT round(0.1 * i, 1) AS v FROM (SELECT unnest(range(1, 10)) AS i)),
f AS (SELECT p_type, y, n, k, a.v AS alpha, list_reduce(list_slice(y, 1, k),
    lambda acc, x: {'s': acc.s + a.v * (x - acc.s), 'r': acc.r * (1 - a.v), 'g': acc.g + acc.r * (x - acc.s),
      'w': acc.w + acc.r * acc.r}, {'s': 0.0::DOUBLE, 'r': 1.0::DOUBLE, 'g': 0.0::DOUBLE, 'w': 0.0::DOUBLE}) AS st
  FROM s, g a WHERE k >= 1 AND n > k),
e AS (SELECT p_type, alpha, st.s + st.r * st.g / st.w AS level, unnest(list_slice(y, k + 1, n)) AS a FROM f)
SELECT p_type, alpha, round(level, 6) AS level, round(avg(CASE WHEN a <> 0 THEN abs((level - a) / a) END), 6) AS mape,
  round(avg(abs(level - a)), 6) AS mae, count(*) AS n FROM e GROUP BY p_type, alpha, level""")
def fct3_estimated(spark, d):
    """Start levels with the least squared one-step error."""
    out = sm.ses_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], select_on="test", initial="estimated")
    return round_all(out.select("p_type", "alpha", "level", "mape", "mae", "n"))


@register("fct5_triple_smoothing", DEMAND + """,
s AS (SELECT p_type, list(demand::DOUBLE ORDER BY month) AS y, count(*) AS n,
  CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) AS k FROM d GROUP BY p_type),
g AS (SELECT round(0.1 * i, 1) AS v FROM (SELECT unnest(range(1, 10)) AS i)),
b AS (SELECT *, list_avg(list_slice(y, 1, m)) AS l0, list_avg(list_slice(y, m + 1, 2 * m)) AS l1
  FROM s, (SELECT unnest(range(2, 7)) AS m) WHERE k >= 2 * m AND n > k),
f AS (SELECT p_type, y, n, k, m, al.v AS alpha, be.v AS beta, ga.v AS gamma, list_reduce(list_slice(y, m + 1, k),
    lambda acc, x: {
      'l': al.v * (x - acc.q[1]) + (1 - al.v) * (acc.l + acc.b),
      'b': be.v * ((al.v * (x - acc.q[1]) + (1 - al.v) * (acc.l + acc.b)) - acc.l) + (1 - be.v) * acc.b,
      'q': list_append(list_slice(acc.q, 2, m),
             ga.v * (x - (al.v * (x - acc.q[1]) + (1 - al.v) * (acc.l + acc.b))) + (1 - ga.v) * acc.q[1])},
    {'l': l0, 'b': (l1 - l0) / m, 'q': list_transform(list_slice(y, 1, m), lambda v: v - l0)}) AS st
  FROM b, g al, g be, g ga),
e AS (SELECT p_type, m, alpha, beta, gamma, n - k AS n_test, y[k + h] AS a, st.l + st.b * h + st.q[(h - 1) % m + 1] AS p
  FROM (SELECT *, unnest(range(1, n - k + 1)) AS h FROM f)),
r AS (SELECT p_type, m, alpha, beta, gamma, n_test, avg(CASE WHEN a <> 0 THEN abs((p - a) / a) END) AS mape,
  avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse FROM e GROUP BY ALL)
SELECT p_type, alpha, beta, gamma, m::INTEGER AS season_period, n_test, round(mape, 6) AS mape, round(mae, 6) AS mae,
  round(rmse, 6) AS rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY round(mape, 10), m, alpha, beta, gamma) AS rk FROM r) WHERE rk = 1""")
def fct5(spark, d):
    out = sm.smoothing_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], methods=("triple",))
    return round_all(out.filter("warning IS NULL").select("p_type", "alpha", "beta", "gamma", "season_period", "n_test", "mape", "mae", "rmse"))


@register("fct5_estimated_start")
def fct5_estimated(spark, d):
    """Double and triple smoothing with estimated start states, by the block plan."""
    return round_all(_no_lists(sm.smoothing_search(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], initial="estimated",
                                                   plan="blocks")))


@register("fct6_best_smoothing")
def fct6(spark, d):
    dem = fx.demand_monthly(spark, d)
    ses = sm.ses_search(dem, "demand", "month", ["p_type"], select_on="test")
    rest = sm.smoothing_search(dem, "demand", "month", ["p_type"])
    return round_all(sm.best_smoothing(ses, rest, ["p_type"]))


@register("fct6_forecast_rows")
def fct6r(spark, d):
    """Actual, predicted and three future values of single, double and triple smoothing."""
    dem = fx.demand_monthly(spark, d)
    ses = sm.ses_search(dem, "demand", "month", ["p_type"], select_on="test")
    rest = sm.smoothing_search(dem, "demand", "month", ["p_type"], extra_periods=3)
    return round_all(sm.smoothing_forecasts(ses, rest, ["p_type"], 3))


# ---------------------------------------------------------------- FCT-7..10
def _croston_sql(method, alpha, beta):
    if method == "tsb":
        p0, f0 = "1.0 / (1 + i0)", "a0 / (1 + i0)"
        step = f"""{{'a': CASE WHEN x > 0 THEN {alpha} * x + (1 - {alpha}) * acc.a ELSE acc.a END,
          'p': CASE WHEN x > 0 THEN {beta} + (1 - {beta}) * acc.p ELSE (1 - {beta}) * acc.p END,
          'q': acc.q,
          'f': (CASE WHEN x > 0 THEN {beta} + (1 - {beta}) * acc.p ELSE (1 - {beta}) * acc.p END)
               * (CASE WHEN x > 0 THEN {alpha} * x + (1 - {alpha}) * acc.a ELSE acc.a END),"""
    else:
        k = f"(1 - {alpha} / 2) * " if method == "sba" else ""
        p0, f0 = "1.0 + i0", "a0 / (1.0 + i0)"
        step = f"""{{'a': CASE WHEN x > 0 THEN {alpha} * x + (1 - {alpha}) * acc.a ELSE acc.a END,
          'p': CASE WHEN x > 0 THEN {alpha} * acc.q + (1 - {alpha}) * acc.p ELSE acc.p END,
          'q': CASE WHEN x > 0 THEN 1.0 ELSE acc.q + 1 END,
          'f': CASE WHEN x > 0 THEN {k}(({alpha} * x + (1 - {alpha}) * acc.a) / ({alpha} * acc.q + (1 - {alpha}) * acc.p))
               ELSE acc.f END,"""
    step += """
          'se': acc.se + CASE WHEN x <> 0 THEN abs((acc.f - x) / x) ELSE 0.0 END,
          'nz': acc.nz + CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END}"""
    beta_sql = f"{beta}::DOUBLE" if method == "tsb" else "NULL::DOUBLE"
    return f"""WITH dp AS ({fx.DEMAND_PART_SQL}),
s AS (SELECT l_partkey, list(demand ORDER BY month) AS arr, avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) * 100 AS zero_pct
  FROM dp GROUP BY l_partkey),
i AS (SELECT *, list_position(list_transform(arr, lambda v: v > 0), true) - 1 AS i0,
  list_filter(arr, lambda v: v > 0)[1] AS a0 FROM s),
r AS (SELECT l_partkey, zero_pct, list_reduce(arr, lambda acc, x: {step},
  {{'a': a0::DOUBLE, 'p': ({p0})::DOUBLE, 'q': 1.0::DOUBLE, 'f': ({f0})::DOUBLE, 'se': 0.0::DOUBLE,
    'nz': 0.0::DOUBLE}}) AS st FROM i)
SELECT l_partkey, '{method}' AS method, {alpha}::DOUBLE AS alpha, {beta_sql} AS beta,
  round(st.se / st.nz, 6) AS mape, round(st.f, 6) AS forecast, CAST(st.nz AS BIGINT) AS nonzero_periods,
  round(zero_pct, 6) AS zero_pct FROM r"""


def _croston_q(method, alpha, beta):
    def q(spark, d):
        return round_all(im.croston(fx.demand_intermittent(spark, d), "demand", "month", ["l_partkey"],
                                    method, alpha, beta))
    return q


register("fct7_croston", _croston_sql("croston", 0.3, 0.2))(_croston_q("croston", 0.3, 0.2))
register("fct8_sba", _croston_sql("sba", 0.3, 0.2))(_croston_q("sba", 0.3, 0.2))
register("fct9_tsb", _croston_sql("tsb", 0.3, 0.2))(_croston_q("tsb", 0.3, 0.2))


def _search_sql():
    """Every candidate of the three methods folded over the series, best by MAPE."""
    grid = "(SELECT round(0.1 * i, 1) AS v FROM (SELECT unnest(range(1, 10)) AS i))"
    parts = []
    for i, method in enumerate(("croston", "sba", "tsb")):
        one = _croston_sql(method, "a.v", "b.v")
        head, rest = one.split("\nr AS (", 1)
        fold = rest.split(") SELECT")[0] if ") SELECT" in rest else rest.split(")\nSELECT")[0]
        cands = f"{grid} a, {grid} b" if method == "tsb" else f"{grid} a"
        fold = fold.replace("SELECT l_partkey, zero_pct,", "SELECT l_partkey, zero_pct, a.v AS alpha, "
                            + ("b.v AS beta," if method == "tsb" else "NULL::DOUBLE AS beta,"), 1)
        fold = fold.rsplit(" FROM i", 1)[0] + f" FROM i, {cands}"
        parts.append(f"""SELECT {i} AS o, '{method}' AS method, l_partkey, zero_pct, alpha, beta, st.se / st.nz AS mape,
  st.f AS forecast FROM ({fold}) WHERE st.nz > 0""")
    return head.rstrip().rstrip(",") + f""",
c AS ({" UNION ALL ".join(parts)}),
m AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, o ORDER BY round(mape, 10), alpha, beta) AS rk FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(mape, 10), o) = 1 AS is_best FROM m WHERE rk = 1)
SELECT l_partkey, method, round(mape, 6) AS mape, round(zero_pct, 6) AS zero_pct, is_best FROM b"""


@register("fct10_croston_search", _search_sql())
def fct10(spark, d):
    out = im.croston_search(fx.demand_intermittent(spark, d), "demand", "month", ["l_partkey"])
    return round_all(out.filter("mape IS NOT NULL").select("l_partkey", "method", "mape", "zero_pct", "is_best"))


@register("fct10_croston_forecasts")
def fct10f(spark, d):
    """All series, the all-zero ones with their warning, and three future periods."""
    return im.croston_search(fx.demand_intermittent(spark, d), "demand", "month", ["l_partkey"], extra_periods=3)


# ---------------------------------------------------------------- FCT-11
def _fct11_sql(zero):
    mape = ("avg(abs((p - a) / CASE WHEN a = 0 THEN 1e-10 ELSE a END))" if zero == "epsilon"
            else "avg(CASE WHEN a <> 0 THEN abs((p - a) / a) END)")
    return f"""SELECT l_returnflag, round({mape}, 6) AS mape, round(avg(abs(p - a)), 6) AS mae,
  round(avg((p - a) ^ 2), 3) AS mse, round(sqrt(avg((p - a) ^ 2)), 6) AS rmse,
  round(CASE WHEN var_pop(a) * count(a) = 0 THEN 0.0 ELSE 1 - sum((p - a) ^ 2) / (var_pop(a) * count(a)) END, 6) AS r2,
  CAST(count(*) AS BIGINT) AS n FROM (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem)
  GROUP BY l_returnflag"""


def _fct11(zero):
    def q(spark, d):
        li = fx.load(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("actual"),
                                                  (F.col("l_quantity") * 2000).alias("predicted"))
        out = forecast_metrics(li, by=["l_returnflag"], zero=zero).withColumn("mse", F.round("mse", 3))  # about 1e9
        return round_all(out)
    return q


register("fct11_metrics_epsilon", _fct11_sql("epsilon"))(_fct11("epsilon"))
register("fct11_metrics_skip", _fct11_sql("skip"))(_fct11("skip"))


# ---------------------------------------------------------------- FCT-12
@register("fct12_arima")
def fct12(spark, d):
    return ar.arima(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], (2, 1, 1))


@register("fct12a_residual_diagnostics", SMA_FC_SQL + """,
e AS (SELECT p_type, month, actual - predicted AS e, (actual - predicted) - lag(actual - predicted) OVER
  (PARTITION BY p_type ORDER BY month) AS de FROM f WHERE predicted IS NOT NULL)
SELECT p_type, round(sum(de * de) / sum(e * e), 6) AS durbin_watson, round(avg(e), 6) AS resid_mean,
  round(stddev_samp(e), 6) AS resid_std FROM e GROUP BY p_type""")
def fct12a(spark, d):
    fc = moving.sma_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3) \
        .filter("predicted IS NOT NULL").withColumn("resid", F.col("actual") - F.col("predicted"))
    return round_all(ar.residual_diagnostics_sql_form(fc, "resid", "month", ["p_type"]))


# ---------------------------------------------------------------- FCT-13..15
@register("fct13_random_forest")
def fct13(spark, d):
    """The whole search space: 5..100 trees, depth 5..30."""
    cands, fc, imp = rg.tree_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"],
                                      "random_forest", extra_periods=3)
    return round_all(cands)


@register("fct14_boosted_trees")
def fct14(spark, d):
    """Part of the search space (depths 3 and 5, one learning rate, up to 50 rounds):
    the whole of it (fits of 300 rounds) takes many minutes on one machine."""
    cands, fc, imp = rg.tree_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], "boosted_trees",
                                      grid={"maxIter": [10, 25, 50], "maxDepth": [3, 5], "stepSize": [0.1]})
    return round_all(cands)


@register("fct15_lag_network")
def fct15(spark, d):
    return round_all(_no_lists(nn.lag_network(fx.demand_monthly(spark, d), "demand", "month", ["p_type"])))


# ---------------------------------------------------------------- FCT-16..18
@register("fct16_future_periods", DEMAND + """
SELECT p_type, CAST(step AS INTEGER) AS step, CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS month
FROM (SELECT p_type, max(month) AS last_month FROM d GROUP BY p_type), (SELECT unnest(range(1, 4)) AS step)""")
def fct16(spark, d):
    last = fx.demand_monthly(spark, d).groupBy("p_type").agg(F.max("month").alias("month"))
    return future_periods(last, "month", 3, "month", by=["p_type"])


@register("fct17_forecast_summary", SMA_FC_SQL + """
SELECT p_type, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train_count,
  CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test_count, min(month) FILTER (WHERE NOT is_test) AS train_start,
  max(month) FILTER (WHERE NOT is_test) AS train_end, min(month) FILTER (WHERE is_test) AS test_start,
  max(month) FILTER (WHERE is_test) AS test_end,
  list(actual ORDER BY month) FILTER (WHERE is_test) AS actual_values,
  list(round(predicted, 6) ORDER BY month) FILTER (WHERE is_test) AS predicted_values FROM f GROUP BY p_type""")
def fct17(spark, d):
    fc = round_all(moving.sma_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3))
    return forecast_summary(fc, by=["p_type"], time_column="month")


@register("fct18_backtest_choice", SMA_FC_SQL + """,
w AS (SELECT p_type, month, demand AS actual, 0.2 * lag(demand, 3) OVER x + 0.3 * lag(demand, 2) OVER x
  + 0.5 * lag(demand, 1) OVER x AS predicted FROM d WINDOW x AS (PARTITION BY p_type ORDER BY month)),
m AS (SELECT p_type, 'sma' AS method, """ + _METRICS_SQL + """ FROM f WHERE predicted IS NOT NULL GROUP BY p_type
  UNION ALL SELECT p_type, 'wma' AS method, """ + _METRICS_SQL + """ FROM w WHERE predicted IS NOT NULL GROUP BY p_type)
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY mape, method) AS rk FROM m)
WHERE rk = 1""")
def fct18(spark, d):
    dem = fx.demand_monthly(spark, d)
    sma_m = forecast_metrics(moving.sma_forecast(dem, "demand", "month", ["p_type"], 3), by=["p_type"]) \
        .withColumn("method", F.lit("sma"))
    wma_m = forecast_metrics(moving.wma_forecast(dem, "demand", [0.2, 0.3, 0.5], "month", ["p_type"]),
                             by=["p_type"]).withColumn("method", F.lit("wma"))
    best = choose_best([sma_m, wma_m], by=["p_type"])
    return best.select("p_type", "method", *_metric_cols())


@register("fct1_sma_forecast_blocks", SMA_FC_SQL + """
SELECT p_type, month, actual, round(predicted, 6) AS predicted, is_test FROM f""")
def fct1fb(spark, d):
    """Same forecast through block-split positions and the shift-join lags."""
    return round_all(moving.sma_forecast(fx.demand_monthly(spark, d), "demand", "month", ["p_type"], 3,
                                         rows_per_block=97))
