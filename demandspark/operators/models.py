"""Forecasting models, grid search, ensembles and persistence (FC4, FC7-FC10, FC12-FC14, SNK4).

The linear models are MLlib estimators in a ``Pipeline`` behind a
``VectorAssembler``; forests and boosting are grown by ``trees``, every
candidate and fold of a search in the same passes.  Predictions are keyed by
row_id, so ensembles are joins, never positional.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators import forecast as fc
from demandspark.operators import ranking, reshape, scale, trees
from demandspark.session import cut_lineage

# The reference's hyper-parameter grids (None: unlimited depth; minSplit: rows needed for a split).
RF_GRID = {"numTrees": [50, 100], "maxDepth": [10, 20, None], "minSplit": [2, 5, 10]}
GBT_GRID = {"maxIter": [50, 100], "stepSize": [0.01, 0.1], "maxDepth": [3, 5]}
BOOST_GRID = {"maxIter": [50, 100], "stepSize": [0.01, 0.1], "maxDepth": [3, 5],
              "subsamplingRate": [0.8, 1.0]}
# What the endpoint fits when no saved model is found.
ENDPOINT_PARAMS = {"linear": {}, "random_forest": {"numTrees": 50, "maxDepth": 10},
                   "gradient_boosting": {"maxIter": 50, "stepSize": 0.1, "maxDepth": 3},
                   "boosted_subsampled": {"maxIter": 50, "stepSize": 0.1, "maxDepth": 6}}
MODEL_TYPES = ("baseline", "linear", "random_forest", "gradient_boosting", "boosted_subsampled",
               "seasonal_ar", "ensemble_average", "ensemble_stack", "all")


def pipeline(kind: str, features: Sequence[str], params: Mapping | None = None, seed: int = 42):
    """An estimator of the kind: ``fit(df)`` gives a model with ``transform(df)``."""
    if kind in trees.DEFAULTS:
        return trees.TreeEstimator(kind, list(features), dict(params or {}), fc.TARGET, seed)
    if kind != "linear":
        raise ValueError(f"unknown model type {kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal", featuresCol="features",
                                             labelCol=fc.TARGET, predictionCol="prediction")])


def predict(model, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.select("row_id", F.lit(name).alias("model"), F.col(fc.TARGET).alias("actual"), "prediction")


def grid(values: Mapping[str, Sequence]) -> list[dict]:
    keys = list(values)
    return [dict(zip(keys, combo)) for combo in itertools.product(*[values[k] for k in keys])]


def _fold_limits(n: int, n_splits: int) -> list[tuple[int, int]]:
    """(end of training, end of test) positions of the expanding folds, as ``time_series_folds`` cuts them."""
    size = n // (n_splits + 1)
    return [(n - (n_splits - i) * size, n - (n_splits - i - 1) * size) for i in range(n_splits)]


def search(train: DataFrame, features: Sequence[str], grids: Mapping[str, Mapping[str, Sequence]], n_splits: int = 3,
           seed: int = 42) -> dict[str, tuple[trees.TreeModel, dict]]:
    """FC4 for several kinds at once: kind -> (model refitted on all of train, its parameters).

    ``train`` must carry a 0-based ``position`` in time order.  All candidates
    of all kinds on all folds, and on the whole of train, are grown in the same
    passes; one more pass gives every fold's squared error.  The lowest mean
    error wins, the first candidate at ties.
    """
    candidates = [(kind, params) for kind, values in grids.items() for params in grid(values)]
    folds = _fold_limits(train.count(), n_splits)
    requests = [trees.Request(kind, params, limit) for kind, params in candidates
                for limit in [None, *[end for end, _ in folds]]]
    fitted = trees.fit_many(train, features, requests, fc.TARGET, seed=seed)
    each = 1 + n_splits
    tested = [m for i, m in enumerate(fitted) if i % each]
    errors = trees.squared_errors(train, tested, folds * len(candidates), fc.TARGET)
    out = {}
    for kind in grids:
        own = [i for i, (k, _) in enumerate(candidates) if k == kind]
        best = min(own, key=lambda i: (sum(errors[i * n_splits:(i + 1) * n_splits]), i))
        out[kind] = fitted[best * each], candidates[best][1]
    return out


def grid_search(kind: str, train: DataFrame, features: Sequence[str], param_grid: Mapping[str, Sequence],
                n_splits: int = 3, seed: int = 42) -> tuple[trees.TreeModel, dict]:
    """FC4: lowest mean squared error over expanding time folds, then the fit on all of train."""
    return search(train, features, {kind: param_grid}, n_splits, seed)[kind]


def ridge_reg_param(alpha: float, df: DataFrame, label: str) -> float:
    """MLlib regParam equal to an unscaled ridge penalty ``alpha`` (labels are
    internally scaled by their sample std; the loss is averaged over n rows)."""
    row = ranking.first_row(df.agg(F.stddev_samp(label).alias("s"), F.count(F.lit(1)).alias("n")))
    return float(alpha) * float(row["s"] or 0.0) / max(1, int(row["n"]))


def ensemble_average(preds: Sequence[DataFrame], name: str = "ensemble_average") -> DataFrame:
    """FC12: row mean of at least two base models' predictions (joined on row_id)."""
    if len(preds) < 2:
        raise ValueError("averaging needs at least two base models")
    wide = _wide(preds)
    cols = [f"_p{i}" for i in range(len(preds))]
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    return wide.select("row_id", F.lit(name).alias("model"), "actual", mean.alias("prediction"))


def out_of_fold(kind: str, train: DataFrame, features: Sequence[str], params: Mapping | None = None,
                n_splits: int = 3, seed: int = 42, name: str | None = None) -> DataFrame:
    """FC13 ``oof``: predictions of the later folds by models that saw only earlier rows."""
    folds = fc.time_series_folds(train, n_splits)
    limits = _fold_limits(train.count(), n_splits)
    if kind in trees.DEFAULTS:
        fitted = trees.fit_many(train, features, [trees.Request(kind, params or {}, end) for end, _ in limits], fc.TARGET, seed=seed)
    else:
        fitted = [pipeline(kind, features, params, seed).fit(folds.filter((F.col("fold") == i) & (F.col("role") == "train")))
                  for i in range(n_splits)]
    out = None
    for i, model in enumerate(fitted):
        part = predict(model, folds.filter((F.col("fold") == i) & (F.col("role") == "test")), name or kind)
        out = part if out is None else out.unionByName(part)
    return out


def ensemble_stack(train_preds: Sequence[DataFrame], test_preds: Sequence[DataFrame], alpha: float = 1.0,
                   name: str = "ensemble_stack") -> DataFrame:
    """FC13: ridge (``alpha``) over base predictions, fitted on the training predictions.

    The reference fits it on in-sample predictions; pass ``out_of_fold`` frames
    as ``train_preds`` for a meta-model that has not seen its inputs' targets.
    """
    tr, te = _wide(train_preds), _wide(test_preds)
    cols = [f"_p{i}" for i in range(len(train_preds))]
    reg = ridge_reg_param(alpha, tr, "actual")
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="actual", regParam=reg,
                                              elasticNetParam=0.0, standardization=False, solver="l-bfgs",
                                              predictionCol="prediction")]).fit(tr)
    return model.transform(te).select("row_id", F.lit(name).alias("model"), "actual", "prediction")


def _wide(preds: Sequence[DataFrame]) -> DataFrame:
    out = preds[0].select("row_id", "actual", F.col("prediction").alias("_p0"))
    for i, p in enumerate(preds[1:], start=1):
        out = out.join(p.select("row_id", F.col("prediction").alias(f"_p{i}")), "row_id")
    return out


@dataclass
class ForecastRun:
    predictions: DataFrame
    metrics: DataFrame
    status: DataFrame
    models: dict = field(default_factory=dict)
    scaler: scale.ScalerModel | None = None


def run_forecast(df: DataFrame, city: str | None = None, test_size: float = 0.2,
                 model_types: Sequence[str] = ("linear", "random_forest", "gradient_boosting",
                                               "boosted_subsampled"),
                 grids: Mapping[str, Mapping] | None = None, seasonal: bool = True,
                 n_splits: int = 3, save_dir: str | None = None, oof: bool = False) -> ForecastRun:
    """FC14: features -> time split -> scaler fitted on train -> baseline -> models ->
    seasonal AR for one city -> ensembles -> metrics.  A model that fails is
    reported in ``status`` and the rest go on.  ``oof`` stacks on out-of-fold
    instead of in-sample predictions (Q24)."""
    from demandspark.operators import seasonal as sar
    spark = df.sparkSession
    grids = dict(grids or {"random_forest": RF_GRID, "gradient_boosting": GBT_GRID,
                           "boosted_subsampled": BOOST_GRID})
    feats = fc.prepare_features(df, city)
    split = fc.time_split(feats, test_size)
    features = fc.feature_columns(feats)
    train_raw = split.filter("is_train")
    scaler = scale.fit_scaler(train_raw, features)
    scaled = scaler.transform(split, suffix="_s")
    sfeatures = [f"{c}_s" for c in features]
    train = cut_lineage(scaled.filter("is_train"))   # every fit reads it
    test = cut_lineage(scaled.filter(~F.col("is_train")))
    preds = {"baseline": fc.baseline_lag24(test)}
    train_preds, status, fitted = {}, [], {}
    wanted = {k: grids[k] for k in model_types if k in trees.DEFAULTS}
    found: dict = {}
    if wanted:
        try:
            found = search(train, sfeatures, wanted, n_splits)
        except Exception as e:  # noqa: BLE001 -- failing trees must not stop the others
            status += [(k, "failed", f"{type(e).__name__}: {e}"[:500]) for k in wanted]
    for kind in model_types:
        if kind in wanted and kind not in found:
            continue
        try:
            model, best = found[kind] if kind in found else (pipeline(kind, sfeatures).fit(train), None)
            fitted[kind] = model
            preds[kind] = predict(model, test, kind)
            train_preds[kind] = (out_of_fold(kind, train, sfeatures, best, n_splits) if oof
                                 else predict(model, train, kind))
            status.append((kind, "ok", "" if best is None else str(best)))
        except Exception as e:  # noqa: BLE001 -- a failing model must not stop the others
            status.append((kind, "failed", f"{type(e).__name__}: {e}"[:500]))
    if seasonal and city:
        try:
            series = reshape.filter_city(df, city).select("row_id", "city", "local_time", "demand")
            preds["seasonal_ar"] = sar.seasonal_ar_predictions(series)
            status.append(("seasonal_ar", "ok", ""))
        except Exception as e:  # noqa: BLE001
            status.append(("seasonal_ar", "failed", f"{type(e).__name__}: {e}"[:500]))
    base = [k for k in model_types if k in train_preds]
    if len(base) >= 2:
        preds["ensemble_average"] = ensemble_average([preds[k] for k in base])
        preds["ensemble_stack"] = ensemble_stack([train_preds[k] for k in base], [preds[k] for k in base])
    all_preds = None
    for p in preds.values():
        all_preds = p if all_preds is None else all_preds.unionByName(p)
    if save_dir:
        save_run(fitted, scaler, save_dir, spark)
    status_df = spark.createDataFrame(status or [("none", "ok", "")], "model string, status string, detail string")
    return ForecastRun(all_preds, fc.metrics(all_preds), status_df, fitted, scaler)


def save_model(model, path: str) -> str:
    """SNK4: persist a fitted pipeline or tree model (shared storage path)."""
    if isinstance(model, trees.TreeModel):
        from pyspark.sql import SparkSession
        SparkSession.active().createDataFrame([(model.to_json(),)], "model string").write.mode("overwrite").json(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str, kind: str = "linear"):
    """SNK4: reload a saved model of the kind."""
    if kind not in trees.DEFAULTS:
        return PipelineModel.load(path)
    from pyspark.sql import SparkSession
    return trees.TreeModel.from_json(SparkSession.active().read.schema("model string").json(path).first()["model"])


def save_run(fitted: Mapping, scaler: scale.ScalerModel, path: str, spark) -> None:
    """SNK4: every fitted model and the scaler that its features went through."""
    for kind, model in fitted.items():
        save_model(model, f"{path.rstrip('/')}/{kind}")
    spark.createDataFrame([(scaler.to_json(),)], "scaler string").write.mode("overwrite").json(
        f"{path.rstrip('/')}/scaler")


def load_run(spark, path: str, kind: str) -> tuple:
    """SNK4: a saved model with its scaler, so that a reload predicts as the saved run did."""
    text = spark.read.schema("scaler string").json(f"{path.rstrip('/')}/scaler").first()["scaler"]
    return load_model(f"{path.rstrip('/')}/{kind}", kind), scale.ScalerModel.from_json(text)
