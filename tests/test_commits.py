"""Outputs committed together, split JSON arrays and merged rollup states."""
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandspark.operators import rollup
from demandspark.session import scratch_path
from demandspark.sources import io


def test_a_broken_write_leaves_the_old_set(spark):
    base = scratch_path(spark, "set")
    one, two = spark.range(3), spark.range(5)
    assert io.committed_tables(spark, base) == {}
    first = io.write_tables(one, one, one, base)
    assert io.committed_tables(spark, base) == first
    broken = two.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception):
        io.write_tables(two, broken, two, base)        # the first table is written, the second fails
    assert io.committed_tables(spark, base) == first
    assert [spark.read.parquet(p).count() for p in io.committed_tables(spark, base).values()] == [3, 3, 3]
    second = io.write_tables(two, two, two, base)
    assert io.committed_tables(spark, base) == second != first
    assert [spark.read.parquet(p).count() for p in second.values()] == [5, 5, 5]


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_arrays_are_split_between_tasks(spark, tmp_path):
    rows = [{"time": 1_700_000_000 + 3600 * i, "temperature": i / 7, "humidity": 0.5} for i in range(5000)]
    files = [_write(tmp_path, "dallas.json", json.dumps(rows, indent=1)), _write(tmp_path, "houston.json", json.dumps(rows[0])),
             _write(tmp_path, "austin.json", "[]"), _write(tmp_path, "waco.json", json.dumps(rows[:3]) + "\n")]
    want = sorted(map(str, io.read_weather_json(spark, files, tz="UTC").collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = io.read_weather_arrays(spark, files, tz="UTC")
        assert got.rdd.getNumPartitions() > 8
        assert sorted(map(str, got.collect())) == want and len(want) == 5004
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_odd_arrays_fall_back(spark, tmp_path):
    rows = [{"time": 1, "temperature": 2.0, "summary": "a } in { a text"}, {"time": 2, "more": {"x": 1}, "temperature": 3.0}]
    files = [_write(tmp_path, "dallas.json", json.dumps(rows))]
    got = io.read_weather_arrays(spark, files, tz="UTC").select("city", "temperature").collect()
    assert sorted((r[0], r[1]) for r in got) == [("dallas", 2.0), ("dallas", 3.0)]
    with pytest.warns(UserWarning):
        assert io.read_weather_arrays(spark, [str(tmp_path / "none.json")]).count() == 0


def test_merged_states_equal_one_pass(spark):
    n = 400
    pdf = pd.DataFrame({"city": [f"c{i % 3}" for i in range(n)], "local_time": pd.Timestamp("2023-12-30") + pd.to_timedelta(range(n), "h"),
                        "demand": [None if i % 11 == 0 else 1e6 + (i * 37 % 101) for i in range(n)],
                        "temperature": [float(i % 13) if i < 300 else None for i in range(n)]})
    df = spark.createDataFrame(pdf).withColumn("local_time", F.col("local_time").cast("timestamp_ntz"))
    df = df.withColumn("demand", F.when(~F.isnan("demand"), F.col("demand"))).withColumn(
        "temperature", F.when(~F.isnan("temperature"), F.col("temperature")))
    base = scratch_path(spark, "states")
    hours = F.hour("local_time")
    for part in (hours < 1, (hours >= 1) & (hours < 20), hours >= 20, hours > 99):
        got = rollup.add_hours(df.filter(part), base, ("demand", "temperature"))
    spec = {"daily": rollup.DAILY_STATS, "weekly": rollup.WEEKLY_STATS}
    for kind, whole in (("daily", rollup.daily_rollup(df)), ("weekly", rollup.weekly_rollup(df))):
        keys = rollup.KEYS[kind]
        a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (got[kind], whole))
        pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False, rtol=1e-9)
        assert set(a.columns) == {*keys, *[f"{c}_{s}" for c in ("demand", "temperature") for s in spec[kind][c]]}
