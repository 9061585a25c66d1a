"""Checked queries: sources and sinks (SRC1-4, SNK1-3), projections and filters
(PRJ1-4, FLT1-6, SMP1), reshape (RSH1, RSH7), set operations (SET1, SET3),
joins (JN1, JN7, JN8) and scalar functions (FN1-FN23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import clean, reshape, rollup
from demandspark.plans.common import round_doubles, sql_stats
from demandspark.plans.registry import query, r4
from demandspark.session import scratch_path
from demandspark.sources import fixtures as fx
from demandspark.sources import io

DP = fx.with_ctes(fx.SQL_DEMAND_PANEL)
HP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL)
LP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_LABELLED_PANEL)
TW = fx.with_ctes(fx.SQL_TEXAS_WIDE)
TS = "strftime(local_time, '%Y-%m-%d %H:%M:%S.%f')"
MEAS = list(fx.MEASURES)


def _ts_us(c="local_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# --- sources and sinks -----------------------------------------------------------------------

@query("src1_read_demand_csv", DP + f"""
SELECT row_id, city, {TS} AS local_time, company, demand, temperature, humidity, windSpeed, sparse_col
FROM demand_panel WHERE row_id % 2 = 0""")
def src1_read_demand_csv(spark, sf):
    path = io.write_table(fx.balance_panel(spark, sf), scratch_path(spark, "balance_csv"), "csv")
    df = io.read_demand_csv(spark, path)
    return df.select(*[_ts_us() if c == "local_time" else c for c in df.columns])


@query("src2_read_wide_csv", TW + f"""
SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS date, {r4('houston')} AS houston,
       {r4('"san antonio"')} AS "san antonio", {r4('dallas')} AS dallas FROM texas_wide""")
def src2_read_wide_csv(spark, sf):
    path = io.write_table(fx.texas_wide(spark, sf), scratch_path(spark, "texas_csv"), "csv")
    df = io.read_wide_csv(spark, path)
    return round_doubles(df.withColumn("date", S.format_ts("date")))


@query("src3_read_weather_json", DP.rstrip() + ",\n" + fx.SQL_WEATHER_PANEL + f"""
SELECT city, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time,
       {r4('temperature')} AS temperature, {r4('humidity * 100')} AS humidity FROM weather""")
def src3_read_weather_json(spark, sf):
    w = fx.weather_panel(spark, sf)
    recs = w.select("city", S.ntz_epoch_seconds("local_time").alias("time"),
                    "temperature", "humidity")
    path = io.write_table(recs, scratch_path(spark, "weather_json"), "json", partition_by=["city"])
    df = io.read_weather_json(spark, path, multi_line=False)
    return round_doubles(df.select("city", S.format_ts("local_time").alias("local_time"),
                                   "temperature", "humidity"))


@query("src3_read_weather_arrays", DP.rstrip() + ",\n" + fx.SQL_WEATHER_PANEL + f"""
SELECT city, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time,
       {r4('temperature')} AS temperature, {r4('humidity * 100')} AS humidity FROM weather""")
def src3_read_weather_arrays(spark, sf):
    """Files that hold one array of readings each, split between tasks."""
    w = fx.weather_panel(spark, sf)
    recs = w.select("city", F.struct(S.ntz_epoch_seconds("local_time").alias("time"), "temperature", "humidity").alias("r"),
                    F.pmod(F.xxhash64("local_time"), F.lit(64)).alias("file"))
    arrays = recs.groupBy("city", "file").agg(F.to_json(F.collect_list("r"), {"pretty": "true"}).alias("value"))
    path = scratch_path(spark, "weather_arrays")
    arrays.select("city", "value").repartition(8, "value").write.partitionBy("city").option("lineSep", "\n").text(path)
    df = io.read_weather_arrays(spark, path)
    return round_doubles(df.select("city", S.format_ts("local_time").alias("local_time"), "temperature", "humidity"))


@query("src4_read_processed", LP + """
SELECT row_id, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, hour, day_of_week, day_name,
       CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
            WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
FROM labelled_panel""")
def src4_read_processed(spark, sf):
    processed = clean.engineer_features(fx.demand_panel(spark, sf))
    path = io.write_table(processed, scratch_path(spark, "processed"))
    df = io.read_processed(spark, path)
    return df.select("row_id", S.format_ts("local_time").alias("local_time"), "hour", "day_of_week",
                     "day_name", "season")


@query("snk1_write_tables", DP + f"""
SELECT city, CAST(CAST(local_time AS DATE) AS VARCHAR) AS date,
       {sql_stats(rollup.DAILY_STATS)}
FROM demand_panel GROUP BY city, CAST(local_time AS DATE)""")
def snk1_write_tables(spark, sf):
    p = fx.demand_panel(spark, sf)
    paths = io.write_tables(p, rollup.daily_rollup(p), rollup.weekly_rollup(p),
                            scratch_path(spark, "tables"), fmt="csv", partition_by_city=False)
    daily = spark.read.option("header", True).option("inferSchema", False).csv(paths["daily_stats"])
    stats = [c for c in daily.columns if c not in ("city", "date")]
    return round_doubles(daily.select("city", "date", *[F.col(c).cast("double").alias(c) for c in stats]))


@query("snk2_write_labeled", LP + """
SELECT row_id, label, 'Cluster ' || CAST(label AS VARCHAR) AS cluster_name FROM labelled_panel""")
def snk2_write_labeled(spark, sf):
    p = fx.labelled_panel(spark, sf).select("row_id", "label")
    p = p.withColumn("cluster_name", F.concat(F.lit("Cluster "), F.col("label").cast("string")))
    path = io.write_labeled(p, scratch_path(spark, "labeled"))
    return spark.read.parquet(path)


@query("snk3_write_report", DP + """
SELECT metric, value FROM (
  SELECT 'total_observations' AS metric, CAST(count(*) AS VARCHAR) AS value FROM demand_panel
  UNION ALL SELECT 'cities', CAST(count(DISTINCT city) AS VARCHAR) FROM demand_panel
  UNION ALL SELECT 'mean_demand', printf('%.4f', avg(demand)) FROM demand_panel)""")
def snk3_write_report(spark, sf):
    p = fx.demand_panel(spark, sf)
    one = p.agg(F.count(F.lit(1)).alias("total_observations"),
                F.countDistinct("city").alias("cities"), F.avg("demand").alias("mean_demand"))
    path = io.write_report(reshape.to_metric_table(one), scratch_path(spark, "report"))
    return spark.read.option("header", True).csv(path)


# --- projections, filters, sampling -------------------------------------------------------

@query("prj1_rename", TW + "SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS local_time, " + r4("houston")
       + " AS houston FROM texas_wide")
def prj1_rename(spark, sf):
    w = reshape.rename(fx.texas_wide(spark, sf), "date", "local_time")
    return round_doubles(w.select(S.format_ts("local_time").alias("local_time"), "houston"))


@query("prj2_constant_column", TW + """
SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS date, 'ERCOT' AS company FROM texas_wide""")
def prj2_constant_column(spark, sf):
    w = reshape.with_constant(fx.texas_wide(spark, sf), "company", "ERCOT")
    return w.select(S.format_ts("date").alias("date"), "company")


_FEATURES = ["temperature", "humidity", "windSpeed", "pressure", "precipIntensity", "cloudCover"]


@query("prj3_present_columns", DP + f"""
SELECT row_id, {r4('temperature')} AS temperature, {r4('humidity')} AS humidity,
       {r4('windSpeed')} AS windSpeed FROM demand_panel""")
def prj3_present_columns(spark, sf):
    return round_doubles(reshape.select_present(fx.demand_panel(spark, sf), _FEATURES, keep=["row_id"]))


@query("prj4_numeric_selector", DP + f"""
SELECT {r4('demand')} AS demand, {r4('temperature')} AS temperature, {r4('humidity')} AS humidity,
       {r4('windSpeed')} AS windSpeed, {r4('sparse_col')} AS sparse_col FROM demand_panel""")
def prj4_numeric_selector(spark, sf):
    p = fx.demand_panel(spark, sf)
    return round_doubles(p.select(*rollup.numeric_columns(p, exclude=["row_id"])))


@query("prj4_string_selector", DP + "SELECT city, company FROM demand_panel")
def prj4_string_selector(spark, sf):
    p = fx.demand_panel(spark, sf)
    return p.select(*rollup.string_columns(p))


@query("flt1_city_filter", DP + "SELECT row_id FROM demand_panel WHERE lower(city) = 'purchase'")
def flt1_city_filter(spark, sf):
    return reshape.filter_city(fx.demand_panel(spark, sf), "Purchase").select("row_id")


@query("flt1_city_all", DP + "SELECT CAST(count(*) AS BIGINT) AS n FROM demand_panel")
def flt1_city_all(spark, sf):
    return reshape.filter_city(fx.demand_panel(spark, sf), "all").agg(F.count(F.lit(1)).alias("n"))


@query("flt2_time_range", DP + """
SELECT row_id FROM demand_panel
WHERE local_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""")
def flt2_time_range(spark, sf):
    p = reshape.filter_time(fx.demand_panel(spark, sf), "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return p.select("row_id")


@query("flt3_drop_nulls", DP + """
SELECT row_id FROM demand_panel WHERE temperature IS NOT NULL AND humidity IS NOT NULL""")
def flt3_drop_nulls(spark, sf):
    return reshape.drop_nulls(fx.demand_panel(spark, sf), ["temperature", "humidity"]).select("row_id")


@query("flt4_range_violation", DP + """
SELECT row_id FROM demand_panel WHERE temperature < -50 OR temperature > 130""")
def flt4_range_violation(spark, sf):
    from demandspark.operators.anomaly import range_violation
    return fx.demand_panel(spark, sf).filter(range_violation("temperature", -50.0, 130.0)).select("row_id")


@query("flt5_membership", LP + "SELECT row_id, hour FROM labelled_panel WHERE hour IN (17, 18, 19, 20)")
def flt5_membership(spark, sf):
    return reshape.filter_in(fx.labelled_panel(spark, sf), "hour", S.PEAK_HOURS).select("row_id", "hour")


@query("flt6_exclude_noise", LP + """
SELECT row_id FROM (SELECT row_id, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM labelled_panel)
WHERE label <> -1""")
def flt6_exclude_noise(spark, sf):
    p = fx.labelled_panel(spark, sf).withColumn(
        "label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return reshape.exclude_noise(p).select("row_id")


@query("smp1_exact_sample")
def smp1_exact_sample(spark, sf):
    """Rows-only check: exactly 1,000 rows, repeatable for a seed."""
    p = fx.demand_panel(spark, sf)
    return reshape.sample_exact(p, 1000, seed=42).select("row_id", "city", "demand")


# --- reshape, sets, joins ------------------------------------------------------------------

@query("rsh1_melt", TW + f"""
SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS local_time, city, {r4('demand')} AS demand, 'ERCOT' AS company
FROM (UNPIVOT texas_wide ON houston, "san antonio", dallas INTO NAME city VALUE demand)""")
def rsh1_melt(spark, sf):
    m = reshape.melt(fx.texas_wide(spark, sf), ["date"], list(io.WIDE_CITIES))
    m = reshape.with_constant(reshape.rename(m, "date", "local_time"), "company", "ERCOT")
    m = m.filter(F.col("demand").isNotNull())
    return round_doubles(m.withColumn("local_time", S.format_ts("local_time")))


@query("rsh7_metric_table", DP + """
SELECT metric, value FROM (
  SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM demand_panel
  UNION ALL SELECT 'demand_mean', printf('%.4f', avg(demand)) FROM demand_panel
  UNION ALL SELECT 'demand_max', printf('%.4f', max(demand)) FROM demand_panel)""")
def rsh7_metric_table(spark, sf):
    p = fx.demand_panel(spark, sf)
    one = p.agg(F.count(F.lit(1)).alias("rows"), F.avg("demand").alias("demand_mean"),
                F.max("demand").alias("demand_max"))
    return reshape.to_metric_table(one)


_SET1 = """merged AS (
  SELECT * FROM demand_panel WHERE row_id % 2 = 0
  UNION ALL BY NAME
  SELECT * EXCLUDE (company) FROM demand_panel WHERE row_id % 2 = 1)"""


@query("set1_union_by_name", DP.rstrip() + ",\n" + _SET1 + """
SELECT row_id, city, company FROM merged""")
def set1_union_by_name(spark, sf):
    m = reshape.union_by_name([fx.balance_panel(spark, sf), fx.subregion_panel(spark, sf)])
    return m.select("row_id", "city", "company")


@query("set3_distinct_rows", DP + "SELECT DISTINCT city, company FROM demand_panel")
def set3_distinct_rows(spark, sf):
    return reshape.distinct_rows(fx.demand_panel(spark, sf).select("city", "company"))


@query("set3_drop_duplicates_by_key", DP.rstrip() + ",\n" + """doubled AS (
  SELECT row_id, city FROM demand_panel UNION ALL SELECT row_id, city FROM demand_panel WHERE row_id % 5 = 0)
SELECT DISTINCT row_id, city FROM doubled""")
def set3_drop_duplicates_by_key(spark, sf):
    p = fx.demand_panel(spark, sf).select("row_id", "city")
    doubled = p.unionByName(p.filter(F.col("row_id") % 5 == 0))
    return reshape.distinct_rows(doubled, ["row_id"])


@query("jn1_merge_weather", HP.rstrip() + ",\n" + fx.SQL_WEATHER_PANEL + f"""
SELECT h.row_id, h.city, strftime(h.local_time, '%Y-%m-%d %H:%M:%S') AS local_time, {r4('h.demand')} AS demand,
       {r4('w.temperature')} AS temperature, {r4('w.humidity')} AS humidity
FROM hourly_panel h LEFT JOIN weather w ON lower(h.city) = lower(w.city) AND h.local_time = w.local_time""")
def jn1_merge_weather(spark, sf):
    demand = fx.hourly_panel(spark, sf).select("row_id", "city", "local_time", "demand")
    merged = reshape.merge_weather(demand, fx.weather_panel(spark, sf))
    return round_doubles(merged.withColumn("local_time", S.format_ts("local_time")))


@query("jn7_weekday_name_lookup", LP + """
SELECT row_id, CASE day_of_week WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday'
  WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS day_label
FROM labelled_panel""")
def jn7_weekday_name_lookup(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return p.select("row_id", reshape.weekday_name("day_of_week").alias("day_label"))


@query("jn8_label_reattachment", LP + """
SELECT p.row_id, p.city, l.label FROM demand_panel p LEFT JOIN labelled_panel l ON l.row_id = p.row_id""")
def jn8_label_reattachment(spark, sf):
    labels = fx.labelled_panel(spark, sf).select("row_id", "label")
    return reshape.attach_labels(fx.demand_panel(spark, sf).select("row_id", "city"), labels)


# --- scalar functions -------------------------------------------------------------------------

@query("fn1_epoch_to_local", DP + """
SELECT row_id, strftime(timezone('America/Chicago', to_timestamp(floor(epoch(local_time))::BIGINT)),
                        '%Y-%m-%d %H:%M:%S') AS local_time FROM demand_panel""")
def fn1_epoch_to_local(spark, sf):
    p = fx.demand_panel(spark, sf)
    epoch = S.ntz_epoch_seconds("local_time")
    return p.select("row_id", S.format_ts(S.epoch_to_local(epoch, "America/Chicago")).alias("local_time"))


@query("fn2_format_timestamp", DP + """
SELECT row_id, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS ts, strftime(local_time, '%Y-%m-%d') AS day
FROM demand_panel""")
def fn2_format_timestamp(spark, sf):
    p = fx.demand_panel(spark, sf)
    return p.select("row_id", S.format_ts("local_time").alias("ts"),
                    S.format_ts("local_time", with_time=False).alias("day"))


@query("fn3_parse_timestamp", DP + """
SELECT row_id, strftime(try_strptime(CASE WHEN row_id % 7 = 0 THEN 'not a time'
                 ELSE strftime(local_time, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S'),
                 '%Y-%m-%d %H:%M:%S') AS parsed FROM demand_panel""")
def fn3_parse_timestamp(spark, sf):
    p = fx.demand_panel(spark, sf)
    raw = F.when(F.col("row_id") % 7 == 0, F.lit("not a time")).otherwise(S.format_ts("local_time"))
    return p.select("row_id", S.format_ts(S.parse_ts(raw, "yyyy-MM-dd HH:mm:ss")).alias("parsed"))


@query("fn4_fn13_engineer_features", DP + """
SELECT row_id, CAST(hour(local_time) AS INTEGER) AS hour, CAST(isodow(local_time) - 1 AS INTEGER) AS day_of_week,
  dayname(local_time) AS day_name, CAST(month(local_time) AS INTEGER) AS month,
  CAST(year(local_time) AS INTEGER) AS year, CAST(day(local_time) AS INTEGER) AS day,
  CASE WHEN month(local_time) IN (12, 1, 2) THEN 'Winter' WHEN month(local_time) IN (3, 4, 5) THEN 'Spring'
       WHEN month(local_time) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
  CASE WHEN isodow(local_time) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(local_time) < 6 THEN 'Night' WHEN hour(local_time) < 12 THEN 'Morning'
       WHEN hour(local_time) < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_of_day,
  """ + r4("demand / nullif(temperature + 1, 0)") + """ AS temp_demand_ratio,
  CASE WHEN hour(local_time) IN (17, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour,
  CAST(weekofyear(local_time) AS INTEGER) AS week, CAST(CAST(local_time AS DATE) AS VARCHAR) AS date
FROM demand_panel""")
def fn4_fn13_engineer_features(spark, sf):
    f = clean.engineer_features(fx.demand_panel(spark, sf))
    f = f.withColumns({"week": S.iso_week("local_time"),
                       "date": S.date_part("local_time").cast("string")})
    return round_doubles(f.select("row_id", "hour", "day_of_week", "day_name", "month", "year", "day",
                                  "season", "is_weekend", "time_of_day", "temp_demand_ratio",
                                  "is_peak_hour", "week", "date"))


@query("fn12_period_of_day", LP + """
SELECT row_id, CASE WHEN hour >= 5 AND hour < 12 THEN 'Morning' WHEN hour >= 12 AND hour < 17 THEN 'Afternoon'
                    WHEN hour >= 17 AND hour < 22 THEN 'Evening' ELSE 'Night' END AS period
FROM labelled_panel""")
def fn12_period_of_day(spark, sf):
    return fx.labelled_panel(spark, sf).select("row_id", S.period_of_day("hour").alias("period"))


@query("fn14_ratio_minus_one", DP + """
SELECT row_id, """ + r4("demand / nullif(temperature + 1, 0)") + """ AS ratio
FROM (SELECT row_id, demand, CASE WHEN row_id % 17 = 0 THEN -1.0 ELSE temperature END AS temperature
      FROM demand_panel)""")
def fn14_ratio_minus_one(spark, sf):
    p = fx.demand_panel(spark, sf).withColumn(
        "temperature", F.when(F.col("row_id") % 17 == 0, F.lit(-1.0)).otherwise(F.col("temperature")))
    return round_doubles(p.select("row_id", S.temp_demand_ratio("demand", "temperature").alias("ratio")))


@query("fn15_unit_scale", DP.rstrip() + ",\n" + fx.SQL_WEATHER_PANEL + f"""
SELECT city, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, {r4('humidity * 100')} AS humidity_pct
FROM weather""")
def fn15_unit_scale(spark, sf):
    w = fx.weather_panel(spark, sf)
    return round_doubles(w.select("city", S.format_ts("local_time").alias("local_time"),
                                  S.to_percent("humidity").alias("humidity_pct")))


@query("fn16_fn17_city_key_and_stem", DP + """
SELECT row_id, replace(lower(trim(upper(city) || '_' || company)), '_', ' ') AS city_key,
       split_part('/data/' || city || '_' || company || '.v1.json', '/', -1) AS base,
       split_part(split_part('/data/' || city || '_' || company || '.v1.json', '/', -1), '.', 1) AS stem
FROM demand_panel""")
def fn16_fn17_city_key_and_stem(spark, sf):
    p = fx.demand_panel(spark, sf)
    path = F.concat(F.lit("/data/"), F.col("city"), F.lit("_"), F.col("company"), F.lit(".v1.json"))
    return p.select("row_id",
                    S.city_key(F.concat(F.upper("city"), F.lit("_"), F.col("company"))).alias("city_key"),
                    F.regexp_extract(path, r"([^/]*)$", 1).alias("base"),
                    S.file_stem(path).alias("stem"))


@query("fn18_abs_clamp_sqrt", DP + f"""
SELECT row_id, {r4('abs(demand - 50)')} AS abs_dev, {r4('least(demand / 5 * 25, 25.0)')} AS size_score,
       {r4('sqrt(demand)')} AS root FROM demand_panel""")
def fn18_abs_clamp_sqrt(spark, sf):
    p = fx.demand_panel(spark, sf)
    return round_doubles(p.select("row_id", F.abs(F.col("demand") - 50).alias("abs_dev"),
                                  S.clamp_max(F.col("demand") / 5 * 25, 25).alias("size_score"),
                                  F.sqrt("demand").alias("root")))


@query("fn19_fn20_labels", LP + """
SELECT label, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) OVER ()) AS percentage,
       (CASE WHEN label >= 3 THEN 'High Demand' ELSE 'Low Demand' END) || ' - ' ||
       (CASE WHEN label % 2 = 0 THEN 'Hot' ELSE 'Cool' END) || ' ' ||
       (CASE WHEN label < 2 THEN 'Night' ELSE 'Evening' END) AS description
FROM labelled_panel GROUP BY label""")
def fn19_fn20_labels(spark, sf):
    p = fx.labelled_panel(spark, sf)
    counts = rollup.value_counts(p, "label", normalize=True)
    lab = F.col("label")
    return counts.select(
        "label", S.percent_label("pct").alias("percentage"),
        S.cluster_name(F.when(lab >= 3, "High Demand").otherwise("Low Demand"),
                       F.when(lab % 2 == 0, "Hot").otherwise("Cool"),
                       F.when(lab < 2, "Night").otherwise("Evening")).alias("description"))


@query("fn21_title_label", DP + """
SELECT DISTINCT city || '_' || company || '_v' AS raw,
       upper(substr(regexp_replace(city || '_' || company || '_v', '_', ' '), 1, 1)) ||
       substr(regexp_replace(city || '_' || company || '_v', '_', ' '), 2) AS label
FROM demand_panel""")
def fn21_title_label(spark, sf):
    p = fx.demand_panel(spark, sf)
    raw = F.concat(F.col("city"), F.lit("_"), F.col("company"), F.lit("_v"))
    return p.select(raw.alias("raw"), S.title_label(raw).alias("label")).distinct()


@query("fn22_missing_key_null", DP.rstrip() + ",\n" + fx.SQL_WEATHER_PANEL + """
SELECT city, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, CAST(NULL AS DOUBLE) AS pressure,
       CAST(NULL AS DOUBLE) AS cloudCover FROM weather""")
def fn22_missing_key_null(spark, sf):
    w = fx.weather_panel(spark, sf)
    recs = w.select("city", S.ntz_epoch_seconds("local_time").alias("time"),
                    "temperature")
    path = io.write_table(recs, scratch_path(spark, "weather_missing"), "json", partition_by=["city"])
    df = io.read_weather_json(spark, path, multi_line=False)
    return df.select("city", S.format_ts("local_time").alias("local_time"), "pressure", "cloudCover")


@query("fn23_forecast_error", fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL, fx.SQL_PREDICTIONS) + f"""
SELECT row_id, {r4('demand - pred_a')} AS error, {r4('(demand - pred_a) * 100.0 / nullif(demand, 0)')} AS error_pct
FROM predictions""")
def fn23_forecast_error(spark, sf):
    p = fx.predictions_panel(spark, sf)
    return round_doubles(p.select("row_id", S.forecast_error("demand", "pred_a").alias("error"),
                                  S.forecast_error_pct("demand", "pred_a").alias("error_pct")))
