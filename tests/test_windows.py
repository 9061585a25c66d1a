import numpy as np
import pandas as pd

from demandspark.operators import windows


def _series(spark, n=900, parts=5):
    rng = np.random.default_rng(2)
    city = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    pdf = pd.DataFrame({"city": city, "t": rng.permutation(n), "row_id": np.arange(n),
                        "demand": rng.normal(100, 10, n).round(3)})
    pdf.loc[::37, "demand"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(parts)


def test_chunked_lags_and_rolling_equal_per_city_shift(spark):
    pdf, df = _series(spark)
    got = windows.lags_and_rolling(df, "demand", ["city"], ["t", "row_id"], (1, 24), (6,), chunk_rows=50)
    got = got.toPandas().set_index("row_id").sort_index()
    exp = pdf.sort_values(["city", "t", "row_id"]).copy()
    grp = exp.groupby("city")["demand"]
    exp["demand_lag_1"] = grp.shift(1)
    exp["demand_lag_24"] = grp.shift(24)
    exp["demand_rolling_6"] = grp.transform(lambda s: s.rolling(6).mean())
    exp = exp.set_index("row_id").sort_index()
    for c in ("demand_lag_1", "demand_lag_24", "demand_rolling_6"):
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float), equal_nan=True)


def test_chunked_lead(spark):
    pdf, df = _series(spark)
    got = windows.lead_target(df, "demand", 24, ["city"], ["t", "row_id"], chunk_rows=40)
    got = got.toPandas().set_index("row_id").sort_index()
    exp = pdf.sort_values(["city", "t", "row_id"]).copy()
    exp["target_demand"] = exp.groupby("city")["demand"].shift(-24)
    exp = exp.set_index("row_id").sort_index()
    np.testing.assert_allclose(got["target_demand"].to_numpy(dtype=float),
                               exp["target_demand"].to_numpy(dtype=float), equal_nan=True)


def test_single_row_city_zscore_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("solo", 5.0)], "city string, demand double")
    z = {r["city"]: r["demand_zscore"] for r in windows.group_zscore(df, ["demand"]).collect()}
    assert z["solo"] is None and abs(z["a"] - 0.7071067811865476) < 1e-12
