"""Checked queries: forecasting (FC1-FC14, MET1-MET3, SNK4) on the hourly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import forecast as fc
from demandspark.operators import arima, models, scale, seasonal
from demandspark.plans.common import round_doubles
from demandspark.plans.registry import query, r4
from demandspark.session import scratch_path
from demandspark.sources import fixtures as fx

W = "PARTITION BY city ORDER BY local_time, row_id"


def forecast_panel(spark, sf):
    """Hourly panel with the reference's temporal features."""
    h = fx.with_calendar(fx.hourly_panel(spark, sf))
    return h.withColumns({"is_weekend": S.is_weekend("day_of_week"), "is_peak_hour": S.is_peak_hour("hour")})


_FP_SQL = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL).rstrip() + """,
fp AS (SELECT row_id, city, local_time, demand, temperature, humidity, windSpeed,
         CAST(hour(local_time) AS INTEGER) AS hour, CAST(isodow(local_time) - 1 AS INTEGER) AS day_of_week,
         CAST(month(local_time) AS INTEGER) AS month,
         CASE WHEN isodow(local_time) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour(local_time) IN (17, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour FROM hourly_panel),
f AS (SELECT *, """ + ", ".join(f"lag(demand, {n}) OVER ({W}) AS demand_lag_{n}" for n in fc.LAGS) + ", " + ", ".join(
    f"CASE WHEN count(demand) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
    f"THEN avg(demand) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS demand_rolling_{n}"
    for n in fc.ROLLING) + """ FROM fp),
c AS (SELECT * FROM f WHERE """ + " AND ".join(
    f"{c} IS NOT NULL" for c in ("temperature", "humidity", "windSpeed",
                                 *[f"demand_lag_{n}" for n in fc.LAGS],
                                 *[f"demand_rolling_{n}" for n in fc.ROLLING])) + f"""),
t AS (SELECT *, lead(demand, 24) OVER ({W}) AS target_demand FROM c),
feats AS (SELECT * FROM t WHERE target_demand IS NOT NULL),
split AS (SELECT *, row_number() OVER (ORDER BY local_time, row_id) - 1 AS position,
                 count(*) OVER () AS n FROM feats),
test AS (SELECT * FROM split WHERE position >= CAST(floor(n * 0.8) AS BIGINT))
"""

_FEATS_OUT = ["target_demand", *[f"demand_lag_{n}" for n in fc.LAGS], *[f"demand_rolling_{n}" for n in fc.ROLLING]]


@query("fc1_prepare_features", _FP_SQL + "SELECT row_id, city, " + ", ".join(
    f"{r4(c)} AS {c}" for c in _FEATS_OUT) + " FROM feats")
def fc1_prepare_features(spark, sf):
    f = fc.prepare_features(forecast_panel(spark, sf), chunk_rows=400)
    return round_doubles(f.select("row_id", "city", *_FEATS_OUT))


@query("fc1_prepare_features_one_city", _FP_SQL + "SELECT row_id, " + r4("target_demand")
       + " AS target_demand FROM feats WHERE city = 'view'")
def fc1_prepare_features_one_city(spark, sf):
    f = fc.prepare_features(forecast_panel(spark, sf), city="View")
    return round_doubles(f.select("row_id", fc.TARGET))


@query("fc2_time_split", _FP_SQL + """SELECT row_id, CAST(position AS BIGINT) AS position,
  position < CAST(floor(n * 0.8) AS BIGINT) AS is_train FROM split""")
def fc2_time_split(spark, sf):
    s = fc.time_split(fc.prepare_features(forecast_panel(spark, sf)))
    return s.select("row_id", "position", "is_train")


@query("fc3_time_series_folds", _FP_SQL + """, tr AS (SELECT row_id, position FROM split
  WHERE position < CAST(floor(n * 0.8) AS BIGINT)), sz AS (SELECT count(*) AS m, count(*) // 4 AS s FROM tr),
folds AS (SELECT i AS fold FROM range(3) r(i))
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN position < m - (3 - fold) * s THEN 'train' ELSE 'test' END AS role, row_id
FROM tr, sz, folds WHERE position < m - (3 - fold) * s + s""")
def fc3_time_series_folds(spark, sf):
    s = fc.time_split(fc.prepare_features(forecast_panel(spark, sf)))
    train = s.filter("is_train")
    return fc.time_series_folds(train).select(F.col("fold").cast("int").alias("fold"), "role", "row_id")


def _metric_sql(pred, actual="target_demand", name="baseline", src="test"):
    return (f"SELECT '{name}' AS model, {r4(f'avg(abs({actual} - {pred}))')} AS mae, "
            f"{r4(f'sqrt(avg(({actual} - {pred}) * ({actual} - {pred})))')} AS rmse, "
            f"{r4(f'avg(abs({actual} - {pred}) / greatest(abs({actual}), 2.220446049250313e-16)) * 100')} AS mape "
            f"FROM {src} GROUP BY 1")


def _test(spark, sf):
    s = fc.time_split(fc.prepare_features(forecast_panel(spark, sf)))
    return s.filter(~F.col("is_train"))


@query("fc5_baseline_lag24", _FP_SQL + _metric_sql("demand_lag_24"))
def fc5_baseline_lag24(spark, sf):
    return round_doubles(fc.metrics(fc.baseline_lag24(_test(spark, sf))))


@query("fc6_seasonal_naive", _FP_SQL + _metric_sql("demand", name="seasonal_naive"))
def fc6_seasonal_naive(spark, sf):
    return round_doubles(fc.metrics(fc.seasonal_naive(_test(spark, sf))))


_PRED = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL, fx.SQL_PREDICTIONS)


def _pred_long(spark, sf):
    p = fx.predictions_panel(spark, sf)
    return (p.select("row_id", F.lit("model_a").alias("model"), F.col("demand").alias("actual"),
                     F.col("pred_a").alias("prediction"))
            .unionByName(p.select("row_id", F.lit("model_b").alias("model"), F.col("demand").alias("actual"),
                                  F.col("pred_b").alias("prediction"))))


@query("met1_metrics", _PRED + _metric_sql("pred_a", "demand", "model_a", "predictions") + "\nUNION ALL "
       + _metric_sql("pred_b", "demand", "model_b", "predictions"))
def met1_metrics(spark, sf):
    return round_doubles(fc.metrics(_pred_long(spark, sf)))


@query("met2_endpoint_mape", _PRED + f"""
SELECT 'model_a' AS model, {r4('avg(abs((demand - pred_a) / nullif(demand, 0))) * 100')} AS mape FROM predictions
UNION ALL SELECT 'model_b', {r4('avg(abs((demand - pred_b) / nullif(demand, 0))) * 100')} FROM predictions""")
def met2_endpoint_mape(spark, sf):
    return round_doubles(fc.endpoint_mape(_pred_long(spark, sf)))


@query("met3_comparison_table", _PRED + _metric_sql("pred_a", "demand", "model_a", "predictions") + "\nUNION ALL "
       + _metric_sql("pred_b", "demand", "model_b", "predictions") + "\nUNION ALL "
       + _metric_sql("(pred_a + pred_b) / 2", "demand", "ensemble_average", "predictions"))
def met3_comparison_table(spark, sf):
    long = _pred_long(spark, sf)
    avg = models.ensemble_average([long.filter("model = 'model_a'"), long.filter("model = 'model_b'")])
    return round_doubles(fc.comparison_table([fc.metrics(long), fc.metrics(avg)]))


@query("fc12_ensemble_average", _PRED + f"""
SELECT row_id, 'ensemble_average' AS model, {r4('demand')} AS actual, {r4('(pred_a + pred_b) / 2')} AS prediction
FROM predictions""")
def fc12_ensemble_average(spark, sf):
    long = _pred_long(spark, sf)
    avg = models.ensemble_average([long.filter("model = 'model_a'"), long.filter("model = 'model_b'")])
    return round_doubles(avg)


def _train_test_scaled(spark, sf):
    s = fc.time_split(fc.prepare_features(forecast_panel(spark, sf)))
    feats = fc.feature_columns(s)
    sc = scale.fit_scaler(s.filter("is_train"), feats)
    z = sc.transform(s, suffix="_s")
    return z.filter("is_train"), z.filter(~F.col("is_train")), [f"{c}_s" for c in feats]


@query("fc7_linear")
def fc7_linear(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    return models.predict(models.pipeline("linear", feats).fit(train), test, "linear")


@query("fc8_random_forest")
def fc8_random_forest(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    params = {"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 2}
    return models.predict(models.pipeline("random_forest", feats, params).fit(train), test, "random_forest")


@query("fc9_gradient_boosting")
def fc9_gradient_boosting(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    params = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3}
    return models.predict(models.pipeline("gradient_boosting", feats, params).fit(train), test,
                          "gradient_boosting")


@query("fc10_boosted_subsampled")
def fc10_boosted_subsampled(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    params = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 0.8}
    return models.predict(models.pipeline("boosted_subsampled", feats, params).fit(train), test,
                          "boosted_subsampled")


@query("fc4_grid_search")
def fc4_grid_search(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    model, best = models.grid_search("gradient_boosting", train, feats, models.GBT_GRID)
    return fc.metrics(models.predict(model, test, "gradient_boosting")).withColumn("best_params", F.lit(str(best)))


@query("fc11_seasonal_ar")
def fc11_seasonal_ar(spark, sf):
    series = fx.hourly_panel(spark, sf).select("row_id", "city", "local_time", "demand")
    return seasonal.seasonal_ar_predictions(series)


@query("fc11_seasonal_arima")
def fc11_seasonal_arima(spark, sf):
    """Seasonal ARIMA by exact likelihood, all cities fitted together."""
    return arima.predictions(fx.hourly_panel(spark, sf).select("row_id", "city", "local_time", "demand"))


@query("fc13_ensemble_stack")
def fc13_ensemble_stack(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    lin = models.pipeline("linear", feats).fit(train)
    gbt = models.pipeline("gradient_boosting", feats, {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3}).fit(train)
    tr = [models.predict(lin, train, "linear"), models.predict(gbt, train, "gbt")]
    te = [models.predict(lin, test, "linear"), models.predict(gbt, test, "gbt")]
    return models.ensemble_stack(tr, te)


@query("fc14_run_forecast")
def fc14_run_forecast(spark, sf):
    run = models.run_forecast(forecast_panel(spark, sf), city="view")
    return run.metrics.join(run.status, "model", "left")


@query("snk4_save_load_model")
def snk4_save_load_model(spark, sf):
    train, test, feats = _train_test_scaled(spark, sf)
    path = models.save_model(models.pipeline("linear", feats).fit(train), scratch_path(spark, "linear_model"))
    return models.predict(models.load_model(path), test, "linear")
