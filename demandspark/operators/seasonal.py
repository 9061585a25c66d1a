"""Per-city seasonal ARIMA-type forecaster (FC11, re-aimed SARIMA(1,1,1)(1,1,1,24)).

The reference fits a state-space SARIMA per city.  Here the same model family
is fitted by two-stage least squares (Hannan and Rissanen, 1982), written as
Spark jobs that never gather a city's series:

1. positions within each city come from the global row index; the first 80 %
   of a city's rows are its training span;
2. ``w_t = (1 - B)(1 - B^24) y_t`` and all lags are chunked row-offset windows;
3. a long autoregression on ``w`` is fitted per city from its normal
   equations, whose cross-products are ``groupBy(city)`` sums (partially
   aggregated, so a hot city is spread over all tasks);
4. its residuals stand in for the innovations, and ``w_t`` is regressed on
   ``w`` and residual lags 1, 24 and 25 (the AR and MA terms of the
   multiplicative model, left unconstrained);
5. the forecast recursion is linear, so each test row's forecast is a row of
   ``M^k z`` for the city's 75 x 75 state map ``M`` and 25-row tail state
   ``z``; test rows are scored in parallel batches, so no task walks a whole
   city's horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import ranking, windows
from demandspark.session import cut_lineage

SEASON = 24
ARMA_LAGS = (1, 24, 25)
LONG_AR_LAGS = (1, 2, 3, 24, 25, 26, 48, 49, 50)


def _positions(df: DataFrame, by: str, order: Sequence[str], train_share: float) -> DataFrame:
    idx = ranking.global_row_index(df, [by, *order], "_g")
    starts = idx.groupBy(by).agg(F.min("_g").alias("_s"), F.count(F.lit(1)).alias("n"))
    out = idx.join(starts, by).withColumn("pos", F.col("_g") - F.col("_s"))
    out = out.withColumn("n_train", F.floor(F.col("n") * train_share).cast("long"))
    return out.withColumn("is_train", F.col("pos") < F.col("n_train")).drop("_s")


def _lagged(df: DataFrame, by: str, value: str, lags: Sequence[int], prefix: str) -> DataFrame:
    """Lags over the city series; the global index ``_g`` from ``_positions`` is reused, so
    no pass after the first re-sorts the data."""
    exprs = {f"{prefix}{n}": windows.lag_expr(value, n) for n in lags}
    return windows.chunked_window(df, [by], ["pos"], exprs, back=max(lags), index="_g")


def _fit_ls(df: DataFrame, by: str, xs: Sequence[str], y: str, name: str) -> DataFrame:
    """Least squares per city from distributed cross-product sums -> (city, name array)."""
    clean = df.na.drop(subset=[*xs, y])
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(xs)
            for j, b in enumerate(xs) if j >= i]
    aggs += [F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(xs)]
    sums = clean.groupBy(by).agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    k = len(xs)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        xx = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                xx[i, j] = xx[j, i] = r[f"xx_{i}_{j}"]
        xy = np.array([r[f"xy_{i}"] for i in range(k)])
        coef = np.linalg.lstsq(xx, xy, rcond=None)[0] if r["_rows"] > k else np.zeros(k)
        return pd.DataFrame({by: [r[by]], name: [coef.tolist()]})

    return sums.groupBy(by).applyInPandas(solve, f"{by} string, {name} array<double>")


def seasonal_ar_fit(series: DataFrame, by: str = "city", order: Sequence[str] = ("local_time", "row_id"),
                    value: str = "demand", train_share: float = 0.8):
    """Fit per city; returns (positioned frame with w and residuals, coefficient table)."""
    pos = _positions(series.select("row_id", by, *[o for o in order if o != "row_id"], value),
                     by, order, train_share)
    y = _lagged(pos, by, value, (1, SEASON, SEASON + 1), "_y")
    w = y.withColumn("w", F.col(value) - F.col("_y1") - F.col(f"_y{SEASON}") + F.col(f"_y{SEASON + 1}"))
    w = w.drop("_y1", f"_y{SEASON}", f"_y{SEASON + 1}")
    long = cut_lineage(_lagged(w, by, "w", LONG_AR_LAGS, "_wl"))
    xs1 = [f"_wl{n}" for n in LONG_AR_LAGS]
    c1 = _fit_ls(long.filter("is_train"), by, xs1, "w", "c1")
    fitted = long.join(c1, by, "left")   # a city too short for any complete row has no coefficients
    pred1 = sum((F.col(x) * F.col("c1")[i] for i, x in enumerate(xs1)), F.lit(0.0))
    # read by the stage-2 fit, the forecast tail and the test rows: written once
    resid = cut_lineage(fitted.withColumn("e", F.col("w") - pred1).drop(*xs1, "c1"))
    stage2 = _lagged(_lagged(resid, by, "w", ARMA_LAGS, "_w"), by, "e", ARMA_LAGS, "_e")
    xs2 = [f"_w{n}" for n in ARMA_LAGS] + [f"_e{n}" for n in ARMA_LAGS]
    c2 = _fit_ls(stage2.filter("is_train"), by, xs2, "w", "coef")
    return resid, c2


_LAGS = SEASON + 1          # 25 values of w, e and y make the state
_DIM = 3 * _LAGS            # state: w_t..w_{t-24}, e_t..e_{t-24}, y_t..y_{t-24}


def _transition(coef) -> np.ndarray:
    """State map z_{t+1} = M z_t of the fitted recursion with future innovations at zero."""
    a1, a24, a25, b1, b24, b25 = coef
    m = np.zeros((_DIM, _DIM))
    w0, e0, y0 = 0, _LAGS, 2 * _LAGS
    # new w from lagged w and e (state index j holds lag j + 1 after the step)
    m[w0, w0 + 0], m[w0, w0 + SEASON - 1], m[w0, w0 + SEASON] = a1, a24, a25
    m[w0, e0 + 0], m[w0, e0 + SEASON - 1], m[w0, e0 + SEASON] = b1, b24, b25
    # new y = new w + y_{t} + y_{t-23} - y_{t-24}
    m[y0] = m[w0]
    m[y0, y0 + 0] += 1.0
    m[y0, y0 + SEASON - 1] += 1.0
    m[y0, y0 + SEASON] -= 1.0
    for base in (w0, e0, y0):   # shift the lags; the new e stays 0
        for j in range(1, _LAGS):
            m[base + j, base + j - 1] = 1.0
    return m


def seasonal_ar_forecast(resid: DataFrame, coef: DataFrame, by: str = "city", value: str = "demand",
                         test: DataFrame | None = None) -> DataFrame:
    """Forecast every test position of every city from its last 25 training rows.

    The recursion is linear, so the forecast ``k`` steps ahead is a row of
    ``M^k z`` (``M`` the 75 x 75 state map, ``z`` the tail state).  Each city's
    six coefficients and z are one small row built from its 25-row tail; tasks
    rebuild M.  A city with a shorter tail has no row.  The test rows are
    scored in parallel batches: within a batch, rows are sorted by step, the
    first power comes from repeated squaring and later ones from one
    matrix-vector product per step.  No task walks a whole city's horizon.
    """
    tail_n = _LAGS
    tail = resid.filter(F.col("is_train") & (F.col("pos") >= F.col("n_train") - tail_n))
    state = tail.select(by, "pos", value, "w", "e").join(coef, by)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ascending=False)  # newest first = lag order
        if len(pdf) < tail_n:
            return pd.DataFrame({by: pd.Series(dtype=object), "c": pd.Series(dtype=object),
                                 "z": pd.Series(dtype=object)})
        z = np.concatenate([np.nan_to_num(pdf["w"].to_numpy(dtype=float)),
                            np.nan_to_num(pdf["e"].to_numpy(dtype=float)),
                            pdf[value].to_numpy(dtype=float)])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "c": [list(pdf["coef"].iloc[0])], "z": [z.tolist()]})

    models = state.groupBy(by).applyInPandas(build, f"{by} string, c array<double>, z array<double>")
    steps = (test if test is not None else resid.filter(~F.col("is_train")))
    steps = steps.select(by, "pos", (F.col("pos") - F.col("n_train") + 1).alias("_k")).join(models, by)

    def score(it):
        for pdf in it:
            if pdf.empty:
                continue
            pdf = pdf.sort_values([by, "_k"])
            preds = np.empty(len(pdf))
            for _, idx in pdf.groupby(by, sort=False).indices.items():
                rows = pdf.iloc[idx]
                m = _transition(rows["c"].iloc[0])
                z = np.asarray(rows["z"].iloc[0], dtype=float)
                ks = rows["_k"].to_numpy()
                cur_k, v = 0, z
                for i, k in zip(idx, ks):
                    gap = int(k) - cur_k
                    v = np.linalg.matrix_power(m, gap) @ v if gap > 1 else (m @ v if gap == 1 else v)
                    cur_k = int(k)
                    preds[i] = v[2 * _LAGS]
            yield pd.DataFrame({by: pdf[by].to_numpy(), "pos": pdf["pos"].to_numpy(dtype=np.int64),
                                "prediction": preds})

    return steps.mapInPandas(score, f"{by} string, pos long, prediction double")


def seasonal_ar_predictions(series: DataFrame, by: str = "city", value: str = "demand",
                            train_share: float = 0.8) -> DataFrame:
    """FC11: (row_id, model, actual, prediction) over every city's test span.

    A city with fewer than 25 training rows cannot be forecast: its rows come
    back with a NULL prediction.
    """
    resid, coef = seasonal_ar_fit(series, by, value=value, train_share=train_share)
    test = resid.filter(~F.col("is_train"))
    fc = seasonal_ar_forecast(resid, coef, by, value, test)
    return (test.select("row_id", by, "pos", F.col(value).alias("actual")).join(fc, [by, "pos"], "left")
            .select("row_id", F.lit("seasonal_ar").alias("model"), "actual", "prediction"))


