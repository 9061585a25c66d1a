"""Model operators against numpy on small fixtures."""
import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from demandspark.operators import cluster, iforest, models, scale, seasonal
from demandspark.operators import forecast as fc


def _regression_frame(spark, n=300, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2.0 + x @ np.array([1.5, -0.7, 0.2]) + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["row_id"] = np.arange(n)
    pdf[fc.TARGET] = y
    return pdf, spark.createDataFrame(pdf)


def test_linear_matches_lstsq(spark):
    pdf, df = _regression_frame(spark)
    model = models.pipeline("linear", ["a", "b", "c"]).fit(df)
    lr = model.stages[-1]
    X = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]].to_numpy()])
    coef = np.linalg.lstsq(X, pdf[fc.TARGET].to_numpy(), rcond=None)[0]
    np.testing.assert_allclose([lr.intercept, *lr.coefficients.toArray()], coef, atol=1e-8)


def test_stacking_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(7)
    n = 200
    p0, p1 = rng.normal(10, 2, n), rng.normal(10, 2, n)
    actual = 0.6 * p0 + 0.3 * p1 + rng.normal(0, 0.5, n)
    mk = lambda p: spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "actual": actual,
                                                       "prediction": p}))
    got = models.ensemble_stack([mk(p0), mk(p1)], [mk(p0), mk(p1)], alpha=1.0).toPandas().sort_values("row_id")
    X = np.column_stack([p0, p1])
    Xc, yc = X - X.mean(axis=0), actual - actual.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(2), Xc.T @ yc)
    b = actual.mean() - X.mean(axis=0) @ w
    np.testing.assert_allclose(got["prediction"].to_numpy(), X @ w + b, rtol=1e-4)


def test_pca_matches_eigh_up_to_sign(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    z = scale.standardize(spark.createDataFrame(pdf), list("abcd"))
    res = scale.pca(z, list("abcd"), k=2)
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    vals, vecs = np.linalg.eigh(np.cov(xs, rowvar=False))
    order = np.argsort(vals)[::-1][:2]
    load = res.loadings.toPandas().set_index("feature").loc[list("abcd")].to_numpy()
    for j, o in enumerate(order):
        assert np.allclose(np.abs(load[:, j]), np.abs(vecs[:, o]), atol=1e-6)
        assert load[np.abs(load[:, j]).argmax(), j] > 0
    np.testing.assert_allclose(res.explained_pct, vals[order] / vals.sum() * 100, rtol=1e-6)


def test_standardize_uses_population_std_and_constant_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    got = scale.standardize(df, ["x", "k"]).collect()
    assert [r.x for r in got] == [-1.0, 1.0] and [r.k for r in got] == [0.0, 0.0]


def test_kmeans_labels_are_nearest_centres(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.2, (50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = scale.assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    fit = cluster.kmeans(df, 3, n_init=3)
    cent = np.array(fit.centres)
    lab = np.array([r.label for r in cluster.assign(fit, df).select("label").collect()])
    assert (lab == np.argmin(((x[:, None, :] - cent[None]) ** 2).sum(axis=2), axis=1)).all()


def test_isolation_forest_flags_the_outliers(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (1000, 4))
    x[:10] += 12.0
    pdf = pd.DataFrame(x, columns=list(iforest.FEATURES))
    pdf["row_id"] = np.arange(1000)
    df = spark.createDataFrame(pdf)
    scores = iforest.score(df, iforest.fit(df)).toPandas()
    assert scores["score"].between(0, 1).all()
    flagged = {r.row_id for r in iforest.forest_anomalies(df).collect()}
    assert set(range(10)) <= flagged and len(flagged) <= 12


def test_seasonal_ar_forecasts_a_seasonal_series(spark):
    n = 24 * 20
    t = np.arange(n)
    y = 100 + 10 * np.sin(2 * np.pi * t / 24) + 0.05 * t
    pdf = pd.DataFrame({"row_id": t, "city": "x", "local_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, "h"),
                        "demand": y})
    got = seasonal.seasonal_ar_predictions(spark.createDataFrame(pdf)).toPandas()
    assert len(got) == n - int(n * 0.8)
    assert np.abs(got["prediction"] - got["actual"]).max() < 1e-6


def test_metrics(spark):
    df = spark.createDataFrame([("m", 10.0, 8.0), ("m", 0.0, 1.0)], "model string, actual double, prediction double")
    r = fc.metrics(df).first()
    assert r.mae == 1.5 and abs(r.rmse - np.sqrt(2.5)) < 1e-12
    assert abs(r.mape - (20.0 + 1 / 2.220446049250313e-16 * 100) / 2) / r.mape < 1e-9


def test_batched_kmeans_silhouette_matches_mllib_and_sweep_keeps_best_start(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.5, (80, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 0), (0, 0, 4))])
    df = scale.assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])), ["a", "b", "c"])
    from demandspark.operators import kmeans_batch
    raw = kmeans_batch.fit_many(df, [(4, s) for s in range(5)] + [(2, 7)])
    best4 = min((r for r in raw if r["k"] == 4), key=lambda r: r["cost"])
    ours = kmeans_batch.silhouette_many(df, [best4])[0]
    fit = cluster.KMeansFit(4, best4["centres"], best4["cost"], best4["seed"])
    mllib = cluster.silhouette_fast(cluster.assign(fit, df))
    assert abs(ours - mllib) < 1e-9
    sweep = {r.k: r.ssd for r in cluster.kmeans_sweep(df, [2, 4], n_init=5, seed=0).collect()}
    assert sweep[4] == pytest.approx(best4["cost"], rel=1e-9) and sweep[2] > sweep[4]


def test_boosted_grid_search_matches_one_fit_per_candidate(spark):
    pdf, df = _regression_frame(spark, n=160)
    train = df.withColumn("position", F.col("row_id")).repartition(1)
    grid = {"maxIter": [2, 6], "stepSize": [0.1, 0.5], "maxDepth": [2]}
    model, best = models.grid_search("gradient_boosting", train, ["a", "b", "c"], grid)
    folds = fc.time_series_folds(train, 3)
    errors = []
    for params in models.grid(grid):
        each = []
        for i in range(3):
            fitted = models.pipeline("gradient_boosting", ["a", "b", "c"], params).fit(
                folds.filter((F.col("fold") == i) & (F.col("role") == "train")))
            out = fitted.transform(folds.filter((F.col("fold") == i) & (F.col("role") == "test")))
            each.append(out.agg(F.avg((F.col(fc.TARGET) - F.col("prediction")) ** 2)).first()[0])
        errors.append(sum(each) / 3)
    assert best == models.grid(grid)[int(np.argmin(errors))]
    assert len(model.trees) == best["maxIter"]


def test_forest_grid_search_and_out_of_fold_stack(spark):
    pdf, df = _regression_frame(spark, n=120)
    train = df.withColumn("position", F.col("row_id"))
    model, best = models.grid_search("random_forest", train, ["a", "b", "c"],
                                     {"numTrees": [3], "maxDepth": [1, None], "minSplit": [2]})
    assert best["maxDepth"] is None and len(model.trees) == 3
    oof = [models.out_of_fold("linear", train, ["a", "b", "c"]),
           models.out_of_fold("random_forest", train, ["a", "b", "c"], best)]
    assert oof[0].count() == oof[1].count() == 90     # three of four blocks
    stacked = models.ensemble_stack(oof, oof)
    assert stacked.filter("prediction is null").count() == 0
