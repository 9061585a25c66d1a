import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from demandspark.operators import ranking


def test_global_row_index_any_partitioning(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "t": rng.normal(size=500), "id": np.arange(500)})
    expected = pdf.sort_values(["g", "t", "id"]).reset_index(drop=True)
    for parts in (1, 4, 17):
        df = spark.createDataFrame(pdf).repartition(parts)
        out = ranking.global_row_index(df, ["g", "t", "id"], "pos").toPandas().sort_values("pos")
        assert out["pos"].tolist() == list(range(500))
        assert out["id"].tolist() == expected["id"].tolist()


def test_exact_quantiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))
    pdf = pd.DataFrame({"g": g, "v": rng.normal(size=3000).round(2)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = ranking.quantiles(df, ["v"], qs, by=["g"]).toPandas()
    for key, part in pdf.groupby("g"):
        vals = part["v"].dropna().to_numpy()
        for q in qs:
            v = got[(got.g == key) & (got.q == q)]["value"].iloc[0]
            assert abs(v - np.quantile(vals, q)) < 1e-9


def test_mode_breaks_ties_with_the_smallest_value(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("x", 3), ("x", 1), ("y", 5)], "k string, v int")
    got = {r["k"]: r["v_mode"] for r in ranking.mode(df, "v", by=["k"]).collect()}
    assert got == {"x": 1, "y": 5}


def test_approx_quantiles_stay_in_range(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("v"))
    got = ranking.quantiles(df, ["v"], [0.5], method="approx").first()["value"]
    assert 4900 <= got <= 5100
