"""Checked properties of the operators whose results SQL cannot restate (random or iterative fits).

Each query runs its operator over the whole table and returns counts and
rounded quantities; the oracle derives the expected values from the tables.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from demandspark.operators import arima, cluster, forecast as fc, iforest, kmeans_batch, models, reshape, scale, seasonal, ward
from demandspark.plans import api, q_cluster
from demandspark.plans.common import round_doubles
from demandspark.plans.q_cluster import cluster_input
from demandspark.plans.q_forecast import _FP_SQL, _train_test_scaled, forecast_panel
from demandspark.plans.registry import query, r4
from demandspark.session import scratch_path
from demandspark.sources import fixtures as fx

DP = fx.with_ctes(fx.SQL_DEMAND_PANEL)


@query("smp1_sample_size", DP + """SELECT CAST(least(1000, count(*)) AS BIGINT) AS rows,
  CAST(least(1000, count(DISTINCT row_id)) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS strangers FROM demand_panel""")
def smp1_sample_size(spark, sf):
    p = fx.demand_panel(spark, sf)
    picked = reshape.sample_exact(p, 1000, seed=42)
    known = picked.join(p.select("row_id", "city", "demand"), ["row_id", "city", "demand"], "left_semi").count()
    return picked.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("ids"),
                      (F.count(F.lit(1)) - F.lit(known)).alias("strangers"))


@query("ano3_scores", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS out_of_range,
  count(*) > 0 AS some_flagged, TRUE AS at_most_share FROM demand_panel
  WHERE demand IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND windSpeed IS NOT NULL""")
def ano3_scores(spark, sf):
    """Every complete row is scored between 0 and 1, and at most the contamination share is flagged."""
    p = fx.demand_panel(spark, sf)
    flagged = iforest.forest_anomalies(p, contamination=0.01, seed=42).count()
    scores = iforest.score(p, iforest.fit(p, seed=42))
    return scores.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if((F.col("score") <= 0) | (F.col("score") > 1)).alias("out_of_range"),
                      F.lit(flagged > 0).alias("some_flagged"),
                      (F.lit(flagged) <= F.ceil(F.count(F.lit(1)) * 0.01)).alias("at_most_share"))


@query("ml3_pca_is_orthonormal", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, 1.0 AS norm1, 1.0 AS norm2, 0.0 AS dot,
  0.0 AS mean1, 0.0 AS mean2, 0.0 AS covariance FROM demand_panel""")
def ml3_pca_is_orthonormal(spark, sf):
    """Unit, orthogonal loadings and centred, uncorrelated scores for every row."""
    data, cols = cluster_input(spark, sf)
    res = scale.pca(data, [f"{c}_z" for c in cols], k=2)
    load = res.loadings.agg(F.sum(F.col("pc1") ** 2).alias("norm1"), F.sum(F.col("pc2") ** 2).alias("norm2"),
                            F.sum(F.col("pc1") * F.col("pc2")).alias("dot"))
    rows = res.scores.agg(F.count("pc1").alias("rows"), F.avg("pc1").alias("mean1"), F.avg("pc2").alias("mean2"),
                          F.covar_pop("pc1", "pc2").alias("covariance"))
    return _rounded(rows.join(load))


def _rounded(df):
    """Four decimals, without a negative zero."""
    return df.select(*[(F.round(F.col(n), 4) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
                       for n, t in df.dtypes])


@query("ml5_projected_centres", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(least(6, count(*)) AS BIGINT)
  AS centres, 0.0 AS largest_gap FROM demand_panel""")
def ml5_projected_centres(spark, sf):
    """A projected centre is the mean of its members' projected scores (the centres are means of members)."""
    data, cols = cluster_input(spark, sf)
    res = scale.pca(data, [f"{c}_z" for c in cols], k=2)
    fit = cluster.kmeans(data, 6, n_init=1, tol=0.0)
    members = cluster.assign(fit, res.scores, "cluster").groupBy("cluster").agg(
        F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.count(F.lit(1)).alias("n"))
    gap = F.greatest(F.abs(F.col("pc1") - F.col("m1")), F.abs(F.col("pc2") - F.col("m2")))
    out = scale.project(res, cluster.centres(fit, spark)).join(members, "cluster")
    return _rounded(out.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("centres"), F.max(gap).alias("largest_gap")))


@query("ml4_frame_properties", DP + f"""SELECT CAST(count(*) AS BIGINT) AS rows, {r4('sum(demand)')} AS demand,
  CAST(least(6, count(*)) AS BIGINT) AS centres, CAST(0 AS BIGINT) AS unlabelled, 0.0 AS mean1, 0.0 AS mean2 FROM demand_panel""")
def ml4_frame_properties(spark, sf):
    """Every row with its source columns, a label and centred scores, and the six projected centres."""
    frame = q_cluster.ml4_ml5_pca_frame_and_centres(spark, sf)
    own = ~F.col("is_centre")
    out = frame.agg(F.count_if(own).alias("rows"), F.sum(F.when(own, F.col("demand"))).alias("demand"),
                    F.count_if("is_centre").alias("centres"), F.count_if(F.col("kmeans_cluster").isNull()).alias("unlabelled"),
                    F.avg(F.when(own, F.col("pc1"))).alias("mean1"), F.avg(F.when(own, F.col("pc2"))).alias("mean2"))
    return round_doubles(out.select("rows", "demand", "centres", "unlabelled")).crossJoin(_rounded(out.select("mean1", "mean2")))


@query("clu11_comparison_properties", DP + """SELECT * FROM (VALUES ('DBSCAN', TRUE, TRUE), ('Hierarchical', TRUE, TRUE),
  ('K-Means', TRUE, TRUE)) v(algorithm, clusters_in_range, score_in_range) WHERE (SELECT count(*) FROM demand_panel) > 0""")
def clu11_comparison_properties(spark, sf):
    """One row a method, with its number of clusters and an exact silhouette in range (none with fewer than two clusters)."""
    out = q_cluster.clu11_compare_algorithms(spark, sf)
    least = {"K-Means": 2, "Hierarchical": 2, "DBSCAN": 0}
    lowest = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    return out.select("algorithm", (F.col("clusters") >= lowest[F.col("algorithm")]).alias("clusters_in_range"),
                      F.coalesce(F.col("silhouette").between(-1, 1), F.col("clusters") < 2).alias("score_in_range"))


@query("clu2_sweep_properties", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(least(14, count(*)) AS INTEGER) AS last_k,
  CAST(0 AS BIGINT) AS bad_scores, TRUE AS ssd_falls FROM demand_panel""")
def clu2_sweep_properties(spark, sf):
    """Scores lie between -1 and 1, and the best fit of a larger K is never far worse."""
    data, _ = cluster_input(spark, sf)
    found = cluster.kmeans_sweep(data, range(2, 15), n_init=2, seed=42).orderBy("k").collect()   # 13 rows
    falls = all(b["ssd"] <= a["ssd"] * 1.02 for a, b in zip(found, found[1:]))
    bad = sum(not -1 <= r["silhouette"] <= 1 for r in found)
    return data.agg(F.count(F.lit(1)).alias("rows"), F.lit(found[-1]["k"]).alias("last_k"),
                    F.lit(bad).cast("long").alias("bad_scores"), F.lit(falls).alias("ssd_falls"))


@query("clu7_tree_labels", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(least(5, count(*)) AS BIGINT) AS clusters,
  CAST(0 AS BIGINT) AS out_of_range FROM demand_panel""")
def clu7_tree_labels(spark, sf):
    data, _ = cluster_input(spark, sf)
    label = F.col("hierarchical_cluster")
    return cluster.hierarchical(data, k=5).agg(
        F.count(label).alias("rows"), F.count_distinct(label).alias("clusters"),
        F.count_if((label < 1) | (label > 5)).alias("out_of_range"))


@query("clu7_ward_heights", DP + """SELECT CAST(least(5, count(DISTINCT (demand, temperature, humidity, windSpeed, local_time)))
  AS BIGINT) AS clusters, TRUE AS heights_rise, 1.0 AS explained FROM demand_panel""")
def clu7_ward_heights(spark, sf):
    """The merges' costs and the squares inside the features add up to the squares of all rows, and merges only get dearer."""
    data, cols = cluster_input(spark, sf)
    model = ward.fit(data)
    costs = [m.cost for m in model.merges]
    total = data.agg(sum((F.var_pop(f"{c}_z") * F.count(f"{c}_z") for c in cols), F.lit(0.0)).alias("t")).first()["t"]
    return _rounded(model.label(data, 5, "features", "c").agg(
        F.count_distinct("c").alias("clusters"), F.lit(costs == sorted(costs)).alias("heights_rise"),
        F.lit((sum(costs) + model.within) / total).alias("explained")))


@query("clu10_silhouette_agrees", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, 0.0 AS difference FROM demand_panel""")
def clu10_silhouette_agrees(spark, sf):
    """MLlib's silhouette equals the closed form from the cluster sums."""
    data, _ = cluster_input(spark, sf)
    raw = kmeans_batch.fit_many(data, [(6, 42)])[0]
    fit = cluster.KMeansFit(6, raw["centres"], raw["cost"], 42)
    gap = cluster.silhouette_fast(cluster.assign(fit, data)) - kmeans_batch.silhouette_many(data, [raw])[0]
    return _rounded(data.agg(F.count(F.lit(1)).alias("rows")).withColumn("difference", F.lit(abs(gap))))


_TEST_ROWS = _FP_SQL + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad FROM test"


@query("fc7_normal_equations", _FP_SQL + """SELECT CAST(count(*) AS BIGINT) AS rows, 0.0 AS mean_residual, 0.0 AS largest
FROM split WHERE position < CAST(floor(n * 0.8) AS BIGINT)""")
def fc7_normal_equations(spark, sf):
    """Least squares leaves residuals that are orthogonal to every feature."""
    train, _, feats = _train_test_scaled(spark, sf)
    out = models.pipeline("linear", feats).fit(train).transform(train)
    r = F.col(fc.TARGET) - F.col("prediction")
    moments = F.greatest(*[F.abs(F.avg(r * F.col(c))) for c in feats]) if len(feats) > 1 else F.abs(F.avg(r))
    return _rounded(out.agg(F.count(F.lit(1)).alias("rows"), F.abs(F.avg(r)).alias("mean_residual"), moments.alias("largest")))


@query("fc8_forest_within_range", _TEST_ROWS)
def fc8_forest_within_range(spark, sf):
    """A forest averages training targets: no prediction leaves their range."""
    train, test, feats = _train_test_scaled(spark, sf)
    lo, hi = train.agg(F.min(fc.TARGET), F.max(fc.TARGET)).first()
    params = {"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 1}
    out = models.predict(models.pipeline("random_forest", feats, params).fit(train), test, "random_forest")
    return out.agg(F.count("prediction").alias("rows"),
                   F.count_if((F.col("prediction") < lo - 1e-9) | (F.col("prediction") > hi + 1e-9)).alias("bad"))


def _boosting(spark, sf, kind, params):
    """Rows predicted, and whether boosting fits its training rows worse than their mean does."""
    train, test, feats = _train_test_scaled(spark, sf)
    model = models.pipeline(kind, feats, params).fit(train)
    mse, var = model.transform(train).agg(F.avg((F.col(fc.TARGET) - F.col("prediction")) ** 2), F.var_pop(fc.TARGET)).first()
    return models.predict(model, test, kind).agg(F.count("prediction").alias("rows"),
                                                 F.lit(int(mse > var)).cast("long").alias("bad"))


@query("fc9_boosting_fits", _TEST_ROWS)
def fc9_boosting_fits(spark, sf):
    return _boosting(spark, sf, "gradient_boosting", {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3})


@query("fc10_subsampled_boosting_fits", _TEST_ROWS)
def fc10_subsampled_boosting_fits(spark, sf):
    return _boosting(spark, sf, "boosted_subsampled", {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 0.8})


@query("fc10_leaf_sums", _FP_SQL + """SELECT CAST(count(*) AS BIGINT) AS rows, 0.0 AS largest_gap
FROM split WHERE position < CAST(floor(n * 0.8) AS BIGINT)""")
def fc10_leaf_sums(spark, sf):
    """In every leaf of the last round, the residuals before it sum to the leaf's value times (rows + penalty)."""
    train, _, feats = _train_test_scaled(spark, sf)
    params = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 1.0}
    model = models.pipeline("boosted_subsampled", feats, params).fit(train)
    before = replace(model, trees=model.trees[:-1])
    last = replace(model, trees=model.trees[-1:], base=0.0, step=1.0)
    rows = last.transform(before.transform(train).withColumn("residual", F.col(fc.TARGET) - F.col("prediction")))
    leaves = rows.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("sum"))
    gap = F.abs(F.col("sum") - F.col("prediction") * (F.col("n") + model.params["regLambda"]))
    return _rounded(leaves.agg(F.sum("n").alias("rows"), F.max(gap).alias("largest_gap")))


@query("fc14_every_model_ok", _FP_SQL + """, c14 AS (
  SELECT row_number() OVER (ORDER BY local_time, row_id) - 1 AS p, count(*) OVER () AS m FROM feats WHERE city = 'view'),
n14 AS (SELECT CAST(count(*) AS BIGINT) AS n FROM c14 WHERE p >= CAST(floor(m * 0.8) AS BIGINT)),
s14 AS (SELECT CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS n FROM hourly_panel WHERE city = 'view')
SELECT model, n AS rows, TRUE AS ok FROM n14, (VALUES ('baseline'), ('linear'), ('random_forest'), ('gradient_boosting'),
  ('boosted_subsampled'), ('ensemble_average'), ('ensemble_stack')) v(model)
UNION ALL SELECT 'seasonal_ar', n, TRUE FROM s14""")
def fc14_every_model_ok(spark, sf):
    """The whole run with full grids: every model ends well and predicts every test row."""
    run = models.run_forecast(forecast_panel(spark, sf), city="view")
    rows = run.predictions.groupBy("model").agg(F.count("prediction").alias("rows"))
    return rows.join(run.status, "model", "left").select("model", "rows", F.coalesce(F.col("status") == "ok", F.lit(True)).alias("ok"))


@query("fc11_rows_by_city", fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL) + """
SELECT city, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS rows,
       CAST(CASE WHEN floor(count(*) * 0.8) >= 25 THEN count(*) - floor(count(*) * 0.8) ELSE 0 END AS BIGINT) AS predicted
FROM hourly_panel GROUP BY city""")
def fc11_rows_by_city(spark, sf):
    series = fx.hourly_panel(spark, sf).select("row_id", "city", "local_time", "demand")
    out = seasonal.seasonal_ar_predictions(series)
    return out.join(series.select("row_id", "city"), "row_id").groupBy("city").agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("predicted"))


_SPAN = "PARTITION BY city ORDER BY local_time, row_id"


@query("fc11_arima_likelihood", fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL).rstrip() + f""",
d AS (SELECT city, row_number() OVER ({_SPAN}) - 1 AS pos, count(*) OVER (PARTITION BY city) AS n,
        demand - lag(demand, 1) OVER ({_SPAN}) - lag(demand, 24) OVER ({_SPAN}) + lag(demand, 25) OVER ({_SPAN}) AS w
      FROM hourly_panel WHERE demand IS NOT NULL),
f AS (SELECT city, count(w) AS m, sum(w * w) AS s FROM d WHERE pos < floor(n * 0.8) GROUP BY city HAVING count(w) >= 8),
t AS (SELECT city, CAST(count(*) FILTER (WHERE pos >= floor(n * 0.8)) AS BIGINT) AS rows FROM d GROUP BY city)
SELECT t.city, rows, CASE WHEN m IS NULL THEN CAST(0 AS BIGINT) ELSE rows END AS predicted,
       {r4('-0.5 * m * (ln(2 * pi()) + 1 + ln(s / m))')} AS noise_loglik,
       m IS NOT NULL AS fitted_is_likelier FROM t LEFT JOIN f ON f.city = t.city""")
def fc11_arima_likelihood(spark, sf):
    """Test rows forecast by city, the likelihood of plain noise, and that the fit is at least as likely."""
    frame = arima.differenced(fx.hourly_panel(spark, sf).select("row_id", "city", "local_time", "demand"))
    packed = arima.chunks(frame)
    models_ = arima.fit(packed)
    noise = arima.evaluate(packed, {c: np.zeros((1, 4)) for c in models_})
    rows = [(c, float(arima.log_likelihood(noise[c][1][0], noise[c][2][0], noise[c][0]))) for c in models_]
    known = spark.createDataFrame([(c, x, bool(models_[c]["loglik"] >= x - 1e-6)) for c, x in rows],
                                  "city string, noise_loglik double, likelier boolean")
    out = arima.forecast(frame, models_).join(frame.select("row_id", "city"), "row_id")
    counts = out.groupBy("city").agg(F.count(F.lit(1)).alias("rows"), F.count("prediction").alias("predicted"))
    every = frame.select("city").distinct().join(counts, "city", "left").na.fill(0, ["rows", "predicted"])
    return round_doubles(every.join(known, "city", "left").select(
        "city", "rows", "predicted", "noise_loglik", F.coalesce("likelier", F.lit(False)).alias("fitted_is_likelier")))


@query("fc13_stack_of_out_of_fold", _TEST_ROWS)
def fc13_stack_of_out_of_fold(spark, sf):
    """The out-of-fold option of stacking: every test row gets a prediction."""
    train, test, feats = _train_test_scaled(spark, sf)
    params = {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3}
    tr = [models.out_of_fold("linear", train, feats), models.out_of_fold("gradient_boosting", train, feats, params)]
    te = [models.predict(models.pipeline("linear", feats).fit(train), test, "linear"),
          models.predict(models.pipeline("gradient_boosting", feats, params).fit(train), test, "gradient_boosting")]
    out = models.ensemble_stack(tr, te)
    return out.agg(F.count("prediction").alias("rows"), F.count_if(F.isnan("prediction")).alias("bad"))


_START, _END = "2024-01-20 00:00:00", "2024-02-01 00:00:00"


@query("api2_forecast_rows", _FP_SQL + f"""SELECT row_id, {r4('target_demand')} AS actual_demand, TRUE AS forecast FROM t
WHERE city = 'view' AND local_time BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'""")
def api2_forecast_rows(spark, sf):
    """Every complete row of the range is forecast, the newest ones without a known outcome."""
    out = api.forecast(forecast_panel(spark, sf), "view", _START, _END)
    return round_doubles(out.select("row_id", "actual_demand", F.col("forecast_demand").isNotNull().alias("forecast")))


@query("snk4_reloaded_run", _FP_SQL + f"""SELECT CAST(count(*) AS BIGINT) AS rows, 0.0 AS largest_gap FROM t
WHERE city = 'view' AND local_time BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'""")
def snk4_reloaded_run(spark, sf):
    """A saved model and its scaler, read again, forecast as the fit they were saved from."""
    panel = forecast_panel(spark, sf)
    path = scratch_path(spark, "saved-run")
    api.train(panel, "view", "linear", save_dir=path)
    fresh, again = (api.forecast(panel, "view", _START, _END, "linear", saved).select("row_id", "forecast_demand")
                    for saved in (None, path))
    both = fresh.join(again.withColumnRenamed("forecast_demand", "again"), "row_id")
    return _rounded(both.agg(F.count(F.lit(1)).alias("rows"),
                             F.coalesce(F.max(F.abs(F.col("forecast_demand") - F.col("again"))), F.lit(0.0)).alias("largest_gap")))


@query("api3_cluster_rows", DP + """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(least(5, count(*)) AS BIGINT) AS clusters,
  0.0 AS mean1, 0.0 AS mean2 FROM demand_panel WHERE city = 'click' AND demand IS NOT NULL AND temperature IS NOT NULL""")
def api3_cluster_rows(spark, sf):
    out = api.cluster_city(fx.demand_panel(spark, sf), "click", k=5)
    return _rounded(out.agg(F.count("cluster").alias("rows"), F.count_distinct("cluster").alias("clusters"),
                            F.avg("pc1").alias("mean1"), F.avg("pc2").alias("mean2")))
