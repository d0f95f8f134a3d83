"""Registered queries: models, ensembles, tuning, importance and selection.

Fitted models cannot be reproduced in SQL, so model queries are rows-only;
everything computed from a fixed prediction rule (metrics, votes, CV summaries,
selection rules) has a DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.expressions import portable_hash
from tabloom.operators import ensemble as ens
from tabloom.operators import importance as imp
from tabloom.operators import ml
from tabloom.operators import stats as st
from tabloom.operators import tuning as tu
from tabloom.plans import fixtures as fx
from tabloom.plans.queries_profile import round_all, union_sql
from tabloom.plans.registry import register

LIN_FEATS = ["l_quantity", "l_discount", "l_tax"]


def linear_data(spark, d):
    """y = 3·quantity − 2·discount + small hash noise (whole lineitem)."""
    li = fx.load(spark, d, "lineitem")
    noise = (portable_hash(F.col("l_orderkey") * 10 + F.col("l_linenumber")) / F.lit(4294967296.0) - 0.5) * 0.1
    return li.select("l_orderkey", "l_linenumber", *LIN_FEATS, "l_returnflag",
                     (3 * F.col("l_quantity") - 2 * F.col("l_discount") + noise).alias("y"))


def _metrics_row(fm):
    return round_all(ml.evaluate(fm))


# ------------------------------------------------------------------ ML-1..8
@register("ml1_linear_regression_slope", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def ml1s(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(fx.load(spark, d, "lineitem"))
    m = LinearRegression(solver="normal", labelCol="l_extendedprice").fit(li)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))],
                                 "slope double, intercept double")


def _fit_query(model_type, target="y", params=None):
    def q(spark, d):
        data = linear_data(spark, d)
        fm = ml.fit_model(data, LIN_FEATS, target if model_type not in ml.MODEL_TASKS or
                          ml.task_of(model_type) == "regression" else "l_returnflag", model_type, params,
                          key=None)
        return _metrics_row(fm)
    return q


for _mt, _p in (("linear_regression", None), ("decision_tree_regressor", None), ("random_forest_regressor", None),
                ("gradient_boosting_regressor", None), ("xgboost_regressor", None), ("xgboost_classifier", None),
                ("logistic_regression", None), ("random_forest_classifier", None), ("decision_tree_classifier", None),
                ("gradient_boosting_classifier", None), ("svm", None), ("svr", None),
                ("ridge", {"alpha": 1.0}), ("lasso", {"alpha": 0.01})):
    register(f"ml_fit_{_mt}")(_fit_query(_mt, params=_p))


register("ml_fit_svm_rbf")(_fit_query("svm", params={"kernel": "rbf"}))
register("ml_fit_svr_poly")(_fit_query("svr", params={"kernel": "poly"}))


@register("ml12_save_load_predict")
def ml12(spark, d):
    from tabloom.plans.queries_relational import _scratch
    data = linear_data(spark, d)
    fm = ml.fit_model(data, LIN_FEATS, "y", "linear_regression")
    path = ml.save_model(fm, _scratch(spark, "model"))
    back = ml.load_model(path)
    return round_all(ml.regression_metrics(back.model.transform(data), "y", "prediction"))


@register("ml13_registry")
def ml13(spark, d):
    from tabloom.plans.queries_relational import _scratch
    data = linear_data(spark, d)
    root = _scratch(spark, "registry")
    reg = ml.ModelRegistry(spark, root + "/log")
    for i, mt in enumerate(["linear_regression", "ridge"]):
        fm = ml.fit_model(data, LIN_FEATS, "y", mt)
        r2 = ml.evaluate(fm).first()["r2"]
        reg.register(f"m{i}", mt, fm, root + f"/m{i}", {"r2": r2})
    reg.delete("m0")
    return reg.list().select("model_id", "name", "model_type", "task", "metrics")


@register("ml14_check_compat")
def ml14(spark, d):
    data = linear_data(spark, d)
    fm = ml.fit_model(data, LIN_FEATS, "y", "linear_regression")
    other = fx.load(spark, d, "lineitem").select("l_quantity", F.col("l_discount").cast("string").alias("l_discount"))
    return ml.check_compat(other, fm)


@register("ml11_predict")
def ml11(spark, d):
    data = linear_data(spark, d)
    fm = ml.fit_model(data, LIN_FEATS, "l_returnflag", "logistic_regression")
    return ml.predict(fm, data.drop("l_returnflag"), keep=["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ ML-9 / ML-10
@register("ml9_regression_metrics", """SELECT round(avg((p - a) ^ 2), 4) AS mse, round(sqrt(avg((p - a) ^ 2)), 6) AS rmse,
  round(avg(abs(p - a)), 6) AS mae, round(1 - sum((p - a) ^ 2) / (var_pop(a) * count(a)), 6) AS r2,
  CAST(count(*) AS BIGINT) AS n FROM (SELECT l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem)""")
def ml9(spark, d):
    li = fx.load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("a"),
                                              (F.col("l_quantity") * 2000).alias("p"))
    return round_all(ml.regression_metrics(li, "a", "p")).withColumn("mse", F.round("mse", 4))


EV_PRED = """(SELECT CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS label,
  CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS prediction FROM events)"""


def events_pred(spark, d):
    e = fx.load(spark, d, "events")
    return e.select(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("label"),
                    F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("prediction"))


@register("ml10_classification_metrics", f"""WITH cm AS (SELECT label, prediction, count(*) AS n FROM {EV_PRED} GROUP BY ALL),
  s AS (SELECT label AS cls, sum(n) AS support FROM cm GROUP BY 1),
  p AS (SELECT prediction AS cls, sum(n) AS pred_n FROM cm GROUP BY 1),
  t AS (SELECT label AS cls, n AS tp FROM cm WHERE label = prediction),
  per AS (SELECT coalesce(s.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(pred_n, 0) AS pred_n,
    coalesce(tp, 0) AS tp FROM s FULL JOIN p ON s.cls = p.cls LEFT JOIN t ON coalesce(s.cls, p.cls) = t.cls),
  m AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0 END AS pr,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per)
  SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
    round(sum(rc * support) / sum(support), 6) AS recall,
    round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support) / sum(support), 6) AS f1,
    CAST(sum(support) AS BIGINT) AS n FROM m""")
def ml10(spark, d):
    return round_all(ml.classification_metrics(events_pred(spark, d)))


@register("ml10_confusion_matrix", f"""SELECT label AS actual, prediction AS predicted, CAST(count(*) AS BIGINT) AS count
  FROM {EV_PRED} GROUP BY ALL""")
def ml10c(spark, d):
    return ml.confusion(events_pred(spark, d))


# ------------------------------------------------------------------ ML-15 voting on rule predictions
def vote_table(spark, d):
    e = fx.load(spark, d, "events")
    return e.select("event_id",
                    F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("_m0"),
                    F.when(F.col("value") > 30, 1.0).otherwise(0.0).alias("_m1"),
                    F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0).alias("_m2"),
                    F.array(1 - F.least(F.col("value") / 100, F.lit(1.0)),
                            F.least(F.col("value") / 100, F.lit(1.0))).alias("_m0_prob"),
                    F.array(1 - F.least(F.col("value") / 80, F.lit(1.0)),
                            F.least(F.col("value") / 80, F.lit(1.0))).alias("_m1_prob"))


HARD_SQL = """(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS m0, (CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS m1,
  (CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 ELSE 0.0 END) AS m2"""


@register("ml15_hard_voting", f"""SELECT event_id, CASE WHEN s1 > s0 THEN 1.0 ELSE 0.0 END AS prediction FROM (
  SELECT event_id, CAST(m0 = 0 AS DOUBLE) * 1.0 + CAST(m1 = 0 AS DOUBLE) * 2.0 + CAST(m2 = 0 AS DOUBLE) * 1.5 AS s0,
    CAST(m0 = 1 AS DOUBLE) * 1.0 + CAST(m1 = 1 AS DOUBLE) * 2.0 + CAST(m2 = 1 AS DOUBLE) * 1.5 AS s1 FROM (SELECT event_id, {HARD_SQL} FROM events))""")
def ml15h(spark, d):
    t = vote_table(spark, d)
    return t.select("event_id", ens.hard_vote(["_m0", "_m1", "_m2"], [1.0, 2.0, 1.5], 2).alias("prediction"))


@register("ml15_soft_voting", """SELECT event_id, round(p1, 10) AS p1,
  CASE WHEN p1 > 1 - p1 THEN 1.0 ELSE 0.0 END AS prediction FROM (
  SELECT event_id, (least(value / 100, 1.0) * 1.0 + least(value / 80, 1.0) * 3.0) / 4.0 AS p1 FROM events)""")
def ml15s(spark, d):
    t = vote_table(spark, d)
    prob = ens.soft_vote(["_m0_prob", "_m1_prob"], [1.0, 3.0])
    return t.select("event_id", F.round(prob[1], 10).alias("p1"), ens.argmax(prob).alias("prediction"))


@register("ml15_regression_voting", """SELECT l_orderkey, l_linenumber,
  round((l_quantity * 2000 * 1.0 + l_extendedprice * 0.9 * 3.0) / 4.0, 6) AS prediction FROM lineitem""")
def ml15r(spark, d):
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                              (F.col("l_quantity") * 2000).alias("_m0"),
                                              (F.col("l_extendedprice") * 0.9).alias("_m1"))
    return li.select("l_orderkey", "l_linenumber",
                     F.round(ens.weighted_mean(["_m0", "_m1"], [1.0, 3.0]), 6).alias("prediction"))


@register("ml15_voting_models")
def ml15m(spark, d):
    data = linear_data(spark, d)
    a = ml.fit_model(data, LIN_FEATS, "l_returnflag", "logistic_regression")
    b = ml.fit_model(data, LIN_FEATS, "l_returnflag", "decision_tree_classifier", {"max_depth": 4})
    v = ens.voting([a, b], [1.0, 2.0], "soft")
    return round_all(ml.classification_metrics(v.transform(a.test)))


@register("ml16_stacking")
def ml16(spark, d):
    data = linear_data(spark, d)
    m = ens.stacking(data, LIN_FEATS, "y", ["linear_regression", "decision_tree_regressor"], "linear_regression")
    return round_all(ml.regression_metrics(m.transform(data), "y", "prediction"))


@register("ml17_blending")
def ml17(spark, d):
    data = linear_data(spark, d)
    m = ens.blending(data, LIN_FEATS, "y", ["linear_regression", "decision_tree_regressor"], "linear_regression")
    return round_all(ml.regression_metrics(m.transform(data), "y", "prediction"))


# ------------------------------------------------------------------ ML-18..23
@register("ml18_grid_search")
def ml18(spark, d):
    """The whole grid of ridge regression."""
    res, summary, _ = tu.tune(linear_data(spark, d), LIN_FEATS, "y", "ridge")
    return round_all(summary)


@register("ml19_random_search")
def ml19(spark, d):
    res, summary, _ = tu.tune(linear_data(spark, d), LIN_FEATS, "y", "decision_tree", method="random")
    return round_all(summary)


def rule_cv_results(spark, d):
    """CV table of a one-parameter rule family (prediction = quantity · k),
    scored by R² per hash fold: a grid search whose fits are closed-form.
    All candidates are scored in one aggregate (one scan), then unpivoted."""
    ks = [1000, 1500, 2000, 2500]
    li = fx.load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("fold", F.pmod(portable_hash("l_orderkey"), F.lit(5)))
    y = F.col("l_extendedprice")
    ss_tot = F.var_pop(y) * F.count(F.lit(1))
    aggs = [(1 - F.sum((F.col("l_quantity") * k - y) ** 2) / ss_tot).alias(f"s{ci}") for ci, k in enumerate(ks)]
    per_fold = li.groupBy("fold").agg(*aggs)
    rows = [F.struct(F.lit(ci).cast("long").alias("candidate"), F.lit(f'{{"k": {k}}}').alias("params"),
                     F.col(f"s{ci}").alias("test_score")) for ci, k in enumerate(ks)]
    return per_fold.select(F.col("fold").cast("long").alias("fold"), F.explode(F.array(*rows)).alias("_r")) \
        .select("_r.candidate", "_r.params", "fold", "_r.test_score",
                F.lit(None).cast("double").alias("train_score"))


RULE_CV_SQL = union_sql([f"""SELECT {ci}::BIGINT AS candidate, '{{"k": {k}}}' AS params, fold,
  1 - sum((l_quantity * {k} - l_extendedprice) ^ 2) / (var_pop(l_extendedprice) * count(*)) AS test_score
  FROM (SELECT *, ((l_orderkey + 42) * 2654435761) % 4294967296 % 5 AS fold FROM lineitem) GROUP BY fold"""
                         for ci, k in enumerate([1000, 1500, 2000, 2500])])


@register("ml21_param_importance", f"""WITH r AS ({RULE_CV_SQL}),
  c AS (SELECT candidate, params, avg(test_score) AS s FROM r GROUP BY ALL),
  v AS (SELECT 'k' AS param, CAST(json_extract(params, '$.k') AS VARCHAR) AS value, avg(s) AS m FROM c GROUP BY ALL),
  sp AS (SELECT param, max(m) - min(m) AS spread FROM v GROUP BY param)
  SELECT param, round(spread, 6) AS spread, round(CASE WHEN max(spread) OVER () > 0 THEN spread / max(spread) OVER ()
    ELSE 0 END, 6) AS importance FROM sp""")
def ml21(spark, d):
    return round_all(tu.param_importance(rule_cv_results(spark, d)))


@register("ml22_cv_summary", f"""WITH r AS ({RULE_CV_SQL}),
  g AS (SELECT candidate, params, avg(test_score) AS m, stddev_pop(test_score) AS sd, count(*) AS n FROM r
    GROUP BY candidate, params)
  SELECT candidate, params, round(m, 6) AS mean_test_score, round(sd, 6) AS std_test_score,
    NULL::DOUBLE AS mean_train_score, NULL::DOUBLE AS std_train_score, CAST(n AS BIGINT) AS folds,
    row_number() OVER (ORDER BY m DESC, candidate) AS rank FROM g""")
def ml22(spark, d):
    return round_all(tu.cv_summary(rule_cv_results(spark, d))).withColumn("rank", F.col("rank").cast("long"))


@register("ml23_learning_curve")
def ml23(spark, d):
    return round_all(tu.learning_curve(linear_data(spark, d), LIN_FEATS, "y", "linear_regression"))


# ------------------------------------------------------------------ FSC / FSL
@register("fsc1_rf_importance")
def fsc1(spark, d):
    return round_all(imp.rf_importance(linear_data(spark, d), LIN_FEATS, "y", "regression"))


@register("fsc2_permutation_importance")
def fsc2(spark, d):
    return round_all(imp.permutation_importance(linear_data(spark, d), LIN_FEATS, "y", "regression",
                                                model_type="linear_regression"))


@register("fsc3_linear_importance")
def fsc3(spark, d):
    return round_all(imp.linear_importance(linear_data(spark, d), LIN_FEATS, "y", "regression"))


@register("fsc4_boosted_importance")
def fsc4(spark, d):
    return round_all(imp.boosted_importance(linear_data(spark, d), LIN_FEATS, "y", "regression"))


F_SCORES_SQL = union_sql([f"""SELECT '{f}' AS feature,
  corr({f}, l_extendedprice) ^ 2 / (1 - corr({f}, l_extendedprice) ^ 2) * (count(*) - 2) AS score FROM lineitem"""
                          for f in ("l_quantity", "l_discount", "l_tax")])


@register("fsc5_importance_percent", f"""SELECT feature, round(score, 2) AS importance,
  round(score / sum(score) OVER () * 100, 6) AS percent, row_number() OVER (ORDER BY score DESC, feature) AS rank
  FROM ({F_SCORES_SQL})""")
def fsc5(spark, d):
    s = st.f_regression(fx.load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    t = imp.with_percent(s.select("feature", F.col("score").alias("importance")))
    return t.select("feature", F.round("importance", 2).alias("importance"), F.round("percent", 6).alias("percent"),
                    F.col("rank").cast("long").alias("rank"))


@register("fsl5_k_best", f"""SELECT feature, round(score, 2) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank,
  row_number() OVER (ORDER BY score DESC, feature) <= 2 AS selected FROM ({F_SCORES_SQL})""")
def fsl5(spark, d):
    s = imp.select_features(fx.load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                            "l_extendedprice", "f_regression", k=2)
    return s.select("feature", F.round("score", 2).alias("score"), F.col("rank").cast("long").alias("rank"), "selected")


@register("fsl1_rf_select")
def fsl1(spark, d):
    return round_all(imp.select_features(linear_data(spark, d), LIN_FEATS, "y", "rf_importance", task="regression"))


@register("fsl2_lasso_select")
def fsl2(spark, d):
    return round_all(imp.select_features(linear_data(spark, d), LIN_FEATS, "y", "lasso", task="regression"))


@register("fsl3_rfe")
def fsl3(spark, d):
    return round_all(imp.select_features(linear_data(spark, d), LIN_FEATS, "y", "rfe", task="regression",
                                         n_features=2))


@register("fsl4_rfecv")
def fsl4(spark, d):
    return round_all(imp.select_features(linear_data(spark, d), LIN_FEATS, "y", "rfecv", task="regression", cv=2,
                                         n_trees=10))
