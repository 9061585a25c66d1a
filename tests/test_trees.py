"""The batched tree engine against brute force, and its distributed passes against local growth."""
import numpy as np
import pandas as pd
import pytest

from demandspark.operators import trees


def frame(n=240, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)          # ties within features
    y = 3 * (x[:, 0] > 0.2) + x[:, 1] * (x[:, 0] < 0) + rng.normal(0, 0.3, n)
    return x, y


def brute_tree(x, y, w, growth, depth=0):
    """Nested (feature, threshold, left, right, value) by trying every split of every feature."""
    g, h, lam = (w * y).sum(), w.sum(), growth.penalty
    value = g / (h + lam)
    best = (1e-9, None)
    if depth < growth.max_depth and len(y) >= growth.min_split:
        for j in range(x.shape[1]):
            for t in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= t
                if min(left.sum(), (~left).sum()) < growth.min_rows or min(w[left].sum(), w[~left].sum()) < growth.min_weight:
                    continue
                gl, hl = (w * y)[left].sum(), w[left].sum()
                gain = (gl ** 2 / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g ** 2 / (h + lam)) / 2 - growth.gamma
                if gain > best[0] + 1e-12:
                    best = (gain, (j, t))
    if best[1] is None:
        return None, None, None, None, value
    j, t = best[1]
    left = x[:, j] <= t
    return j, t, brute_tree(x[left], y[left], w[left], growth, depth + 1), \
        brute_tree(x[~left], y[~left], w[~left], growth, depth + 1), value


def brute_predict(tree, row):
    while tree[0] is not None:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[4]


GROWTHS = [trees.Growth(3), trees.Growth(min_split=10), trees.Growth(4, min_rows=5), trees.Growth(5, penalty=1.0, min_weight=1.0),
           trees.Growth(6, penalty=2.0, gamma=0.4)]


@pytest.mark.parametrize("growth", GROWTHS)
def test_growth_matches_brute_force(growth):
    x, y = frame()
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float)
    cuts = [np.unique(c) for c in x.T]
    bins = trees.bin_rows(x, cuts)
    got = trees.grow(bins, w, y, growth).predict(bins)
    want = brute_tree(x, y, w, growth)
    np.testing.assert_allclose(got, [brute_predict(want, r) for r in x], atol=1e-9)


def spark_frame(spark, n=240, seed=0):
    x, y = frame(n, 3, seed)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"], pdf["position"] = y, np.arange(n)
    return x, y, spark.createDataFrame(pdf).repartition(3)


REQUESTS = [trees.Request("random_forest", {"numTrees": 4, "maxDepth": 5, "minSplit": 4}),
            trees.Request("random_forest", {"numTrees": 2, "maxDepth": 2, "minSplit": 4}),
            trees.Request("random_forest", {"numTrees": 2, "maxDepth": None, "minSplit": 2}, 100),
            trees.Request("gradient_boosting", {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}),
            trees.Request("gradient_boosting", {"maxIter": 2, "maxDepth": 3, "stepSize": 0.3}, 150),
            trees.Request("boosted_subsampled", {"maxIter": 3, "maxDepth": 4, "stepSize": 0.5, "subsamplingRate": 0.7})]


def test_level_passes_equal_local_growth(spark):
    """Histograms summed over tasks split as one task does that holds all rows."""
    x, _, df = spark_frame(spark)
    local = trees.fit_many(df, ["a", "b", "c"], REQUESTS, "y")
    spread = trees.fit_many(df, ["a", "b", "c"], REQUESTS, "y", small_rows=12)
    for one, other in zip(local, spread):
        bins = trees.bin_rows(x, one.cuts)
        np.testing.assert_allclose(one.predict_bins(bins), other.predict_bins(bins), atol=1e-9)


def test_shared_candidates_equal_their_own_fits(spark, monkeypatch):
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    x, _, df = spark_frame(spark)
    together = trees.fit_many(df, ["a", "b", "c"], REQUESTS, "y")
    for request, model in zip(REQUESTS, together):
        alone = trees.fit_many(df, ["a", "b", "c"], [request], "y")[0]
        bins = trees.bin_rows(x, model.cuts)
        np.testing.assert_allclose(model.predict_bins(bins), alone.predict_bins(bins), atol=1e-9)
        # and a limit is the fit on the rows before it
        if request.limit is not None and request.kind == "gradient_boosting":
            cut = trees.fit_many(df.filter(df.position < request.limit), ["a", "b", "c"],
                                 [trees.Request(request.kind, request.params)], "y")[0]
            assert len(cut.trees) == len(alone.trees) and abs(cut.base - alone.base) < 1e-12


def test_second_order_boosting_matches_brute_force(spark):
    """Gains, leaves and rounds of the regularised objective, with every row and no subsample."""
    x, y, df = spark_frame(spark, 150)
    params = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.4, "regLambda": 1.5, "gamma": 0.05, "minChildWeight": 2.0}
    model = trees.fit_many(df, ["a", "b", "c"], [trees.Request("boosted_subsampled", params)], "y")[0]
    f = np.full(len(y), y.mean())
    growth = trees.Growth(3, penalty=1.5, gamma=0.05, min_weight=2.0)
    for _ in range(5):
        t = brute_tree(x, y - f, np.ones(len(y)), growth)
        f = f + 0.4 * np.array([brute_predict(t, r) for r in x])
    np.testing.assert_allclose(model.predict_bins(trees.bin_rows(x, model.cuts)), f, atol=1e-9)
    got = model.transform(df).orderBy("position").toPandas()
    np.testing.assert_allclose(got["prediction"], f, atol=1e-9)


def test_draws_do_not_depend_on_partitions(spark):
    x, _, df = spark_frame(spark)
    a, b = (trees.fit_many(df.repartition(k), ["a", "b", "c"], REQUESTS[:1], "y")[0] for k in (1, 7))
    bins = trees.bin_rows(x, a.cuts)
    np.testing.assert_allclose(a.predict_bins(bins), b.predict_bins(bins), atol=1e-12)
    w = trees.weights(np.arange(100_000), 5, None)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(trees.weights(np.arange(100_000), 5, 0.8).mean() - 0.8) < 0.01


def test_json_round_trip_and_missing_values(spark):
    x, _, df = spark_frame(spark)
    model = trees.fit_many(df, ["a", "b", "c"], REQUESTS[3:4], "y")[0]
    again = trees.TreeModel.from_json(model.to_json())
    bins = trees.bin_rows(x, model.cuts)
    np.testing.assert_array_equal(model.predict_bins(bins), again.predict_bins(bins))
    odd = spark.createDataFrame([(None, 1.0, 2.0), (float("nan"), 0.0, 0.0)], "a double, b double, c double")
    assert model.transform(odd).filter("prediction is null or isnan(prediction)").count() == 0


def test_no_rows_and_null_targets(spark):
    none = spark.createDataFrame([], "a double, y double, position long")
    for m in trees.fit_many(none, ["a"], [REQUESTS[0], REQUESTS[3]], "y"):
        assert m.transform(spark.createDataFrame([(1.0,)], "a double")).first()["prediction"] == 0.0
    some = spark.createDataFrame([(1.0, 2.0, 0), (2.0, None, 1), (3.0, float("nan"), 2)], "a double, y double, position long")
    assert trees.fit_many(some, ["a"], [REQUESTS[3]], "y")[0].base == 2.0
