"""The chunked Kalman filter against the dense multivariate normal."""
import numpy as np
import pandas as pd
import pytest

from demandspark.operators import arima

PARAMS = np.array([[0.6, 0.3, -0.4, -0.5], [-0.2, 0.7, 0.5, 0.4], [0.0, 0.0, 0.0, 0.0]])


def covariances(p, n):
    """Autocovariances 0..n-1 from the moving-average expansion, by the recursion of the two polynomials."""
    ar, ma = arima.coefficients(p[None])
    psi = np.zeros(6000)
    for j in range(len(psi)):
        psi[j] = ma[0, j] if j < arima.STATES else 0.0
        for lag in (1, 24, 25):
            if j >= lag:
                psi[j] += ar[0, lag - 1] * psi[j - lag]
    return np.array([psi[:len(psi) - h] @ psi[h:] for h in range(n)])


def dense(p, w):
    g = covariances(p, len(w))
    c = g[np.abs(np.subtract.outer(np.arange(len(w)), np.arange(len(w))))]
    _, logdet = np.linalg.slogdet(c)
    quad = w @ np.linalg.solve(c, w)
    s2 = quad / len(w)
    return -0.5 * (len(w) * np.log(2 * np.pi * s2) + logdet + quad / s2), s2


def series(cities, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, c in enumerate(cities):
        e = rng.normal(size=n + 200)
        w = np.zeros(n + 200)
        for t in range(30, n + 200):
            w[t] = 0.5 * w[t - 1] + e[t] - 0.4 * e[t - 24]
        y = np.zeros(n + 200)
        for t in range(25, n + 200):
            y[t] = w[t] + y[t - 1] + y[t - 24] - y[t - 25]
        rows += [(1000 * i + t, c, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), y[200 + t]) for t in range(n)]
    return pd.DataFrame(rows, columns=["row_id", "city", "local_time", "demand"])


@pytest.mark.parametrize("cuts", [[], [1], [13, 14, 40], [30, 60, 90]])
def test_likelihood_of_composed_chunks_is_the_dense_normals(cuts):
    w = np.random.default_rng(1).normal(size=100)
    gains = arima.Gains(PARAMS)
    total = None
    bounds = [0, *cuts, len(w)]
    for lo, hi in zip(bounds, bounds[1:]):
        s = arima.summary(gains, lo, w[lo:hi])
        total = s if total is None else arima.composed(total, s)
    for i, p in enumerate(PARAMS):
        want, s2 = dense(p, w)
        assert abs(arima.log_likelihood(total[0][i, 0, 0], total[2][i], len(w)) - want) < 1e-6
        assert abs(total[0][i, 0, 0] / len(w) - s2) < 1e-8


def test_settled_gains_equal_the_full_recursion():
    w = np.random.default_rng(2).normal(size=3000)
    gains = arima.Gains(PARAMS)
    arima.summary(gains, 0, w)
    assert gains.settled and len(gains.f) < 3000


def test_composition_is_associative():
    w = np.random.default_rng(3).normal(size=60)
    g = arima.Gains(PARAMS[:1])
    a, b, c = (arima.summary(g, lo, w[lo:lo + 20]) for lo in (0, 20, 40))
    for x, y in zip(arima.composed(arima.composed(a, b), c), arima.composed(a, arima.composed(b, c))):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_spark_evaluation_spans_tasks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(arima, "CHUNKS_PER_GROUP", 3)
    pdf = series(["a", "b"], 200)
    frame = arima.differenced(spark.createDataFrame(pdf))
    packed = arima.chunks(frame, chunk_rows=10).repartition(5)
    found = arima.evaluate(packed, {"a": PARAMS, "b": PARAMS[:1]}, chunk_rows=10)
    for city, params in (("a", PARAMS), ("b", PARAMS[:1])):
        y = pdf[pdf.city == city]["demand"].to_numpy()[:160]
        w = (y[25:] - y[24:-1]) - (y[1:-24] - y[:-25])
        n, quad, logs, _ = found[city]
        assert n == len(w)
        for i, p in enumerate(params):
            assert abs(arima.log_likelihood(quad[i], logs[i], n) - dense(p, w)[0]) < 1e-5


def test_fit_and_forecasts_against_the_conditional_mean(spark):
    pdf = series(["a", "short"], 140)
    pdf = pdf[(pdf.city == "a") | (pdf.row_id < 1040)]
    pdf = pd.concat([pdf, pd.DataFrame([(5, "a", pd.Timestamp("2024-01-01 05:30"), np.nan)], columns=pdf.columns)])
    df = spark.createDataFrame(pdf)
    frame = arima.differenced(df)
    models = arima.fit(arima.chunks(frame, chunk_rows=50), chunk_rows=50)
    assert set(models) == {"a"}
    m = models["a"]
    y = pdf[pdf.city == "a"]["demand"].dropna().to_numpy()
    train, test = y[:112], y[112:]
    w = (train[25:] - train[24:-1]) - (train[1:-24] - train[:-25])
    assert abs(dense(m["params"], w)[0] - m["loglik"]) < 1e-5
    truth = dense(np.array([0.5, 0.0, 0.0, -0.4]), w)[0]
    assert m["loglik"] > truth - 0.05           # no worse than the parameters that made the series
    for z in np.eye(4):                         # and a maximum
        for s in (-0.1, 0.1):
            assert dense(np.tanh(m["z"] + s * z), w)[0] < m["loglik"] + 0.02
    g = covariances(m["params"], len(w) + len(test))
    n = len(w)
    oo = g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    fo = g[np.abs(np.subtract.outer(np.arange(n, n + len(test)), np.arange(n)))]
    ahead = fo @ np.linalg.solve(oo, w)
    full = list(train)
    for v in ahead:
        full.append(v + full[-1] + full[-24] - full[-25])
    got = arima.forecast(frame, models).toPandas().sort_values("row_id")
    mine = got[got.row_id < 1000]
    np.testing.assert_allclose(mine["prediction"].astype(float), full[112:], rtol=1e-6, atol=1e-5)
    np.testing.assert_allclose(mine["actual"], test)
    assert got[got.row_id >= 1000]["prediction"].isna().all() and (got.row_id >= 1000).sum() == 8
