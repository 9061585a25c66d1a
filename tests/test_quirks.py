"""One assertion per reference quirk and hand-made fixtures."""
import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import anomaly, cluster, reshape, rollup, windows
from demandspark.sources import io


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_q1_cross_city_pct_change(spark):
    rows = [("a", _ts("2024-01-01 01:00"), 10.0), ("a", _ts("2024-01-02 01:00"), 10.0),
            ("b", _ts("2024-01-01 01:00"), 30.0), ("b", _ts("2024-01-02 01:00"), 30.0)]
    df = spark.createDataFrame(rows, "city string, local_time timestamp_ntz, demand double")
    per_city = {(r.city, str(r.date)): r.demand_pct_change for r in windows.daily_pct_change(df).collect()}
    cross = {(r.city, str(r.date)): r.demand_pct_change
             for r in windows.daily_pct_change(df, cross_city=True).collect()}
    assert per_city[("b", "2024-01-01")] is None
    assert abs(cross[("b", "2024-01-01")] - 2.0) < 1e-12   # compared with city a's last day
    assert cross[("a", "2024-01-01")] is None


def test_q1_zero_previous_mean_is_a_spike(spark):
    rows = [("a", _ts("2024-01-01 01:00"), 0.0), ("a", _ts("2024-01-02 01:00"), 5.0)]
    df = spark.createDataFrame(rows, "city string, local_time timestamp_ntz, demand double")
    assert [str(r.date) for r in anomaly.spike_days(df).collect()] == ["2024-01-02"]


def test_q10_choose_k_reference_offset(spark):
    sweep = spark.createDataFrame([(2, 1.0, 0.2), (3, 1.0, 0.5), (4, 1.0, 0.4), (5, 1.0, 0.5)],
                                  "k int, ssd double, silhouette double")
    r = cluster.choose_k(sweep).first()
    assert (r.best_k, r.reference_rule_k) == (3, 4)
    top = spark.createDataFrame([(2, 1.0, 0.1), (3, 1.0, 0.9)], "k int, ssd double, silhouette double")
    assert cluster.choose_k(top).first().reference_rule_k == 3  # clipped to the range


def test_q16_ratio_at_minus_one_is_null(spark):
    df = spark.createDataFrame([(10.0, -1.0), (10.0, 4.0)], "demand double, temperature double")
    got = [r[0] for r in df.select(S.temp_demand_ratio("demand", "temperature")).collect()]
    assert got == [None, 2.0]


def test_q17_weekly_key_mixes_iso_week_and_calendar_year(spark):
    df = spark.createDataFrame([("a", _ts("2021-01-01 10:00"), 1.0, 1.0, 1.0, 1.0)],
                               "city string, local_time timestamp_ntz, demand double, temperature double, "
                               "humidity double, windSpeed double")
    r = rollup.weekly_rollup(df).first()
    assert (r.year, r.week) == (2021, 53)
    r2 = rollup.weekly_rollup(df, iso_year=True).first()
    assert (r2.year, r2.week) == (2020, 53)


def test_q18_city_key_joins_file_stem_and_column_names(spark):
    demand = spark.createDataFrame([("san antonio", _ts("2024-01-01 00:00"), 5.0)],
                                   "city string, local_time timestamp_ntz, demand double")
    weather = spark.createDataFrame([("san_antonio", _ts("2024-01-01 00:00"), 70.0)],
                                    "city string, local_time timestamp_ntz, temperature double")
    assert reshape.merge_weather(demand, weather).first().temperature == 70.0
    assert reshape.merge_weather(demand, weather, normalise_city=False).first().temperature is None


def test_q26_weekday_names_by_date_not_position(spark):
    df = spark.createDataFrame([(_ts("2024-01-06 00:00"),)], "t timestamp_ntz")
    r = df.select(S.day_name("t").alias("n"), S.day_of_week("t").alias("d")).first()
    assert (r.n, r.d) == ("Saturday", 5)
    assert df.select(reshape.weekday_name(F.lit(5))).first()[0] == "Saturday"


def test_ano1_negative_demand(spark):
    df = spark.createDataFrame([(1, -3.0, 50.0, 50.0, 5.0), (2, 3.0, 200.0, 50.0, 5.0)],
                               "row_id long, demand double, temperature double, humidity double, windSpeed double")
    got = sorted((r.row_id, r.detector) for r in anomaly.range_anomalies(df).collect())
    assert got == [(1, "range_demand"), (2, "range_temperature")]


def test_title_label(spark):
    df = spark.createDataFrame([("random_forest",), ("gradient_boosting_x",)], "m string")
    assert [r[0] for r in df.select(S.title_label("m")).collect()] == ["Random forest", "Gradient boosting_x"]


def test_src3_weather_json_object_array_and_missing_time(spark):
    d = tempfile.mkdtemp(prefix="ds-weather-")
    with open(os.path.join(d, "san_antonio.json"), "w") as f:
        json.dump([{"time": 1704067200, "temperature": 60.0, "humidity": 0.5},
                   {"temperature": 61.0}], f, indent=1)
    with open(os.path.join(d, "dallas.json"), "w") as f:
        json.dump({"time": 1704070800, "temperature": 55.0, "windSpeed": 3.0}, f, indent=1)
    import pytest
    with pytest.warns(UserWarning, match="missing.json"):
        got = io.read_weather_json(spark, [os.path.join(d, "san_antonio.json"), os.path.join(d, "dallas.json"),
                                           os.path.join(d, "missing.json")]).orderBy("city").collect()
    assert [(r.city, str(r.local_time), r.humidity, r.pressure) for r in got] == [
        ("dallas", "2024-01-01 01:00:00", None, None), ("san_antonio", "2024-01-01 00:00:00", 50.0, None)]


def test_smp1_exact_size_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    a = [r.row_id for r in reshape.sample_exact(df, 100, seed=42).collect()]
    b = [r.row_id for r in reshape.sample_exact(df, 100, seed=42).collect()]
    assert len(a) == 100 and a == b
    import pytest
    with pytest.raises(ValueError):
        reshape.sample_exact(df, 1001)
