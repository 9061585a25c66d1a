"""Results that must not depend on partitioning, size or the number of groups, and rows that must not be lost."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandspark.operators import anomaly, clean, cluster, iforest, kmeans_batch, ranking, scale, seasonal
from demandspark.plans import api
from demandspark.session import checkpoint_dir


def _points(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.4, (n // 4, 2)) for c in ((0, 0), (5, 5), (0, 5), (5, 0))])
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["row_id"] = np.arange(len(pdf))
    return scale.assemble(spark.createDataFrame(pdf), ["a", "b"])


def test_kmeans_is_the_same_on_any_number_of_partitions(spark):
    df = _points(spark)
    fits = [kmeans_batch.fit_many(df.repartition(p), [(4, 1), (3, 2)]) for p in (1, 8, 40)]
    for other in fits[1:]:
        for a, b in zip(fits[0], other):
            np.testing.assert_allclose(a["centres"], b["centres"], atol=1e-9)
            assert a["iterations"] == b["iterations"]


def test_kmeans_draws_by_row_so_copies_weigh(spark):
    rows = [(i, 0.0) for i in range(1000)] + [(1000 + i, float(v)) for i, v in enumerate((1.0, 2.0, 3.0))]
    df = scale.assemble(spark.createDataFrame(rows, "row_id long, a double"), ["a"])
    first = [kmeans_batch._seed(kmeans_batch.to_matrix_frame(df), [(1, s)], 1)[0][0, 0] for s in range(8)]
    assert first.count(0.0) >= 7     # 99.7 % of the rows are copies of 0


def test_kmeans_leaves_no_centre_empty(spark):
    rows = [(i, float(v)) for i, v in enumerate([0, 0, 0, 0, 1, 9, 10])]
    df = scale.assemble(spark.createDataFrame(rows, "row_id long, a double"), ["a"])
    for seed in range(6):
        fit = cluster.kmeans(df, 4, n_init=1, seed=seed)
        labels = {r[0] for r in cluster.assign(fit, df).select("label").distinct().collect()}
        assert labels == {0, 1, 2, 3}


@pytest.mark.parametrize("n,ties", [(200, False), (30_000, False), (30_000, True)])
def test_quantiles_around_the_sketch(spark, n, ties):
    rng = np.random.default_rng(4)
    v = rng.normal(size=n)
    if ties:
        v[: n // 3] = 0.25
        v[n // 3: n // 2] = np.round(v[n // 3: n // 2], 1)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": np.where(rng.random(n) < 0.9, "hot", "b")})).repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for by in ([], ["g"]):
        got = ranking.quantiles(df, ["v"], qs, by, accuracy=1000).toPandas()
        pdf = df.toPandas()
        parts = pdf.groupby("g") if by else [("", pdf)]
        for key, part in parts:
            mine = got[got.g == key] if by else got
            for q in qs:
                assert abs(mine[mine.q == q]["value"].iloc[0] - np.quantile(part.v, q)) < 1e-12


def test_group_statistics_join_alike_broadcast_or_not(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    stats = df.groupBy("g").agg(F.avg("id").alias("m"))
    small, large = (ranking.join_groups(df, stats, ["g"], "left", n).orderBy("id").collect() for n in (100, 3))
    assert small == large


def test_group_zscore_does_not_shuffle_rows_on_the_city(spark):
    from demandspark.operators import windows
    df = spark.range(1000).select(F.col("id").cast("double").alias("demand"),
                                  F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("city"))
    plan = windows.group_zscore(df, ["demand"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(city" not in plan and "BroadcastHashJoin" in plan


def test_forest_on_few_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(100, 4)), columns=list(iforest.FEATURES))
    pdf["row_id"] = np.arange(100)
    pdf.loc[3, "demand"] = 50.0
    flagged = [r.row_id for r in iforest.forest_anomalies(spark.createDataFrame(pdf)).collect()]
    assert flagged == [3]


def _days(rows):
    return [(i, c, dt.datetime.fromisoformat(f"{d} 01:00"), v) for i, (c, d, v) in enumerate(rows)]


def test_spike_after_a_zero_day_of_the_previous_city(spark):
    rows = _days([("a", "2024-01-01", 5.0), ("a", "2024-01-02", 0.0), ("b", "2024-01-01", 7.0), ("b", "2024-01-02", 7.0)])
    df = spark.createDataFrame(rows, "row_id long, city string, local_time timestamp_ntz, demand double")
    found = {(r.city, str(r.date)) for r in anomaly.spike_days(df, cross_city=True).collect()}
    assert found == {("a", "2024-01-02"), ("b", "2024-01-01")}


def test_detection_reads_its_rows_once_per_pass(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", dt.datetime(2024, 1, 1 + i % 9, i % 24), float(i % 50), 60.0, 50.0, 5.0) for i in range(300)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "row_id long, city string, local_time timestamp_ntz, demand double, temperature double, "
                                "humidity double, windSpeed double").write.parquet(path)
    det = anomaly.detect_anomalies(spark.read.parquet(path))
    plan = det._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_short_city_keeps_its_rows(spark):
    start = pd.Timestamp("2024-01-01")
    long = pd.DataFrame({"city": "x", "local_time": start + pd.to_timedelta(np.arange(480), "h")})
    short = pd.DataFrame({"city": "y", "local_time": start + pd.to_timedelta(np.arange(20), "h")})
    pdf = pd.concat([long, short], ignore_index=True)
    pdf["row_id"] = np.arange(len(pdf))
    pdf["demand"] = 100 + 10 * np.sin(2 * np.pi * np.arange(len(pdf)) / 24)
    got = seasonal.seasonal_ar_predictions(spark.createDataFrame(pdf)).toPandas()
    assert len(got) == 96 + 4
    assert got["prediction"].isna().sum() == 4


def test_impute_mode_in_one_pass(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "y"), ("b", "x")], "p string, q string")
    assert [tuple(r) for r in clean.impute_mode(df).collect()] == [
        ("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "x")]


def test_cluster_program_keeps_every_row(spark):
    rng = np.random.default_rng(6)
    n = 240
    pdf = pd.DataFrame({"row_id": np.arange(n), "city": "a", "local_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"),
                        "demand": np.r_[rng.normal(10, 1, n // 2), rng.normal(90, 1, n // 2)]})
    for c in ("temperature", "humidity", "windSpeed"):
        pdf[c] = rng.normal(50, 5, n)
    df = spark.createDataFrame(pdf).withColumn("temperature", F.when(F.col("row_id") % 10 != 0, F.col("temperature")))
    df = df.withColumns({"hour": F.hour("local_time"), "day_of_week": F.weekday("local_time"), "month": F.month("local_time"),
                         "day_name": F.date_format("local_time", "EEEE")})
    run = api.cluster_pipeline(df, ks=range(2, 5), n_init=2, compare=True, eps=2.0, min_samples=4)
    assert run.labelled.count() == n and run.labelled.filter("label is null or pc1 is null").count() == 0
    report = {r.metric: r.value for r in run.run_report.collect()}
    assert {"cluster_summary", "interpretability_scores"} <= set(report)
    assert [r.algorithm for r in run.comparison.collect()] == ["K-Means", "Hierarchical", "DBSCAN"]


def test_shared_checkpoint_folder_is_required_off_local_mode():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
