"""Checked queries: aggregations (AGG1-AGG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import ranking, rollup
from demandspark.plans.common import date_str, round_doubles, sql_stats
from demandspark.plans.registry import query, r4
from demandspark.session import scratch_path
from demandspark.sources import fixtures as fx

DP = fx.with_ctes(fx.SQL_DEMAND_PANEL)
LP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_LABELLED_PANEL)
MEAS = list(fx.MEASURES)


@query("agg1_daily_rollup", DP + f"""
SELECT city, CAST(CAST(local_time AS DATE) AS VARCHAR) AS date,
       {sql_stats(rollup.DAILY_STATS)}
FROM demand_panel GROUP BY city, CAST(local_time AS DATE)""")
def agg1_daily_rollup(spark, sf):
    d = rollup.daily_rollup(fx.demand_panel(spark, sf))
    return round_doubles(d.select("city", date_str("date"), *d.columns[2:]))


@query("agg2_weekly_rollup", DP + f"""
SELECT city, CAST(year(local_time) AS INTEGER) AS year, CAST(week(local_time) AS INTEGER) AS week,
       {sql_stats(rollup.WEEKLY_STATS)}
FROM demand_panel GROUP BY city, year(local_time), week(local_time)""")
def agg2_weekly_rollup(spark, sf):
    return round_doubles(rollup.weekly_rollup(fx.demand_panel(spark, sf)))


def _in_three_parts(spark, sf):
    """Rollups from three disjoint parts of the hours, each merged into the stored states in turn."""
    p = fx.demand_panel(spark, sf)
    base = scratch_path(spark, "rollup-states")
    part = F.pmod(F.xxhash64("row_id"), F.lit(3))
    for i in range(3):
        out = rollup.add_hours(p.filter(part == i), base)
    return out


@query("agg1_merged_daily_rollup", DP + f"""
SELECT city, CAST(CAST(local_time AS DATE) AS VARCHAR) AS date,
       {sql_stats(rollup.DAILY_STATS)}
FROM demand_panel GROUP BY city, CAST(local_time AS DATE)""")
def agg1_merged_daily_rollup(spark, sf):
    d = _in_three_parts(spark, sf)["daily"]
    return round_doubles(d.select("city", date_str("date"), *d.columns[2:]))


@query("agg2_merged_weekly_rollup", DP + f"""
SELECT city, CAST(year(local_time) AS INTEGER) AS year, CAST(week(local_time) AS INTEGER) AS week,
       {sql_stats(rollup.WEEKLY_STATS)}
FROM demand_panel GROUP BY city, year(local_time), week(local_time)""")
def agg2_merged_weekly_rollup(spark, sf):
    return round_doubles(_in_three_parts(spark, sf)["weekly"])


def _describe_sql(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    unions = "\n  UNION ALL ".join(
        f"SELECT {keys}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM demand_panel WHERE {c} IS NOT NULL"
        for c in MEAS)
    return DP.rstrip() + f""",
long AS ({unions})
SELECT {keys}column_name AS "column", CAST(count(value) AS BIGINT) AS count, {r4('avg(value)')} AS mean,
       {r4('stddev_samp(value)')} AS std, {r4('min(value)')} AS min,
       {r4('quantile_cont(value, 0.25)')} AS p25, {r4('quantile_cont(value, 0.5)')} AS p50,
       {r4('quantile_cont(value, 0.75)')} AS p75, {r4('max(value)')} AS max
FROM long GROUP BY {keys}column_name"""


@query("agg3_describe", _describe_sql())
def agg3_describe(spark, sf):
    return round_doubles(rollup.describe(fx.demand_panel(spark, sf), MEAS))


@query("agg4_grouped_describe", _describe_sql("city"))
def agg4_grouped_describe(spark, sf):
    return round_doubles(rollup.describe(fx.demand_panel(spark, sf), MEAS, by=["city"]))


@query("agg4_describe_grouping_sets", LP + f"""
SELECT 'city' AS group_by, city AS group_value, count(demand) AS count, {r4('avg(demand)')} AS mean,
       {r4('stddev_samp(demand)')} AS std, {r4('min(demand)')} AS min, {r4('max(demand)')} AS max
FROM labelled_panel GROUP BY city
UNION ALL
SELECT 'day_name', day_name, count(demand), {r4('avg(demand)')}, {r4('stddev_samp(demand)')},
       {r4('min(demand)')}, {r4('max(demand)')} FROM labelled_panel GROUP BY day_name
UNION ALL
SELECT 'hour', CAST(hour AS VARCHAR), count(demand), {r4('avg(demand)')}, {r4('stddev_samp(demand)')},
       {r4('min(demand)')}, {r4('max(demand)')} FROM labelled_panel GROUP BY hour""")
def agg4_describe_grouping_sets(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return round_doubles(rollup.describe_grouping_sets(p, "demand", ["city", "day_name", "hour"]))


_NP_COLS = ["row_id", "city", "local_time", "company", "demand", "temperature", "humidity",
            "windSpeed", "sparse_col"]


@query("agg5_null_profile", DP + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"{r4(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM demand_panel"
    for c in _NP_COLS))
def agg5_null_profile(spark, sf):
    return round_doubles(rollup.null_profile(fx.demand_panel(spark, sf)))


@query("agg6_median_by_city", DP + f"""
SELECT city, {r4('median(demand)')} AS demand_median, {r4('median(temperature)')} AS temperature_median,
       {r4('median(humidity)')} AS humidity_median, {r4('median(windSpeed)')} AS windSpeed_median
FROM demand_panel GROUP BY city""")
def agg6_median_by_city(spark, sf):
    return round_doubles(ranking.medians(fx.demand_panel(spark, sf), MEAS, by=["city"]))


@query("agg6_median_overall", DP + f"""
SELECT {r4('median(demand)')} AS demand_median, {r4('median(temperature)')} AS temperature_median,
       {r4('median(humidity)')} AS humidity_median, {r4('median(windSpeed)')} AS windSpeed_median
FROM demand_panel""")
def agg6_median_overall(spark, sf):
    return round_doubles(ranking.medians(fx.demand_panel(spark, sf), MEAS))


_QS = (0.01, 0.25, 0.75, 0.99)


@query("agg7_quantiles", DP + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {q} AS q, {r4(f'quantile_cont({c}, {q})')} AS value FROM demand_panel"
    for c in MEAS for q in _QS))
def agg7_quantiles(spark, sf):
    return round_doubles(ranking.quantiles(fx.demand_panel(spark, sf), MEAS, _QS))


_MODE_SQL = """
SELECT {keys}{col} AS {name} FROM (
  SELECT {keys}{col}, row_number() OVER ({part} ORDER BY count(*) DESC, {col}) AS rn
  FROM {src} WHERE {col} IS NOT NULL GROUP BY {keys}{col}) WHERE rn = 1"""


@query("agg8_mode_company", DP + _MODE_SQL.format(keys="", col="company", name="company_mode",
                                                 part="", src="demand_panel"))
def agg8_mode_company(spark, sf):
    return ranking.mode(fx.demand_panel(spark, sf), "company")


@query("agg8_mode_hour_by_city", LP + _MODE_SQL.format(keys="city, ", col="hour", name="hour_mode",
                                                       part="PARTITION BY city", src="labelled_panel"))
def agg8_mode_hour_by_city(spark, sf):
    return ranking.mode(fx.labelled_panel(spark, sf), "hour", by=["city"])


@query("agg9_common_label_by_day", LP + _MODE_SQL.format(
    keys="month, day, ", col="label", name="common_label", part="PARTITION BY month, day",
    src="labelled_panel"))
def agg9_common_label_by_day(spark, sf):
    return ranking.mode(fx.labelled_panel(spark, sf), "label", by=["month", "day"], name="common_label")


@query("agg10_value_counts", LP + f"""
SELECT label, CAST(count(*) AS BIGINT) AS count,
       {r4('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct
FROM labelled_panel GROUP BY label""")
def agg10_value_counts(spark, sf):
    return round_doubles(rollup.value_counts(fx.labelled_panel(spark, sf), "label", normalize=True))


@query("agg10_month_share_by_label", LP + f"""
SELECT label, month, CAST(count(*) AS BIGINT) AS count,
       {r4('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label)')} AS pct
FROM labelled_panel GROUP BY label, month""")
def agg10_month_share_by_label(spark, sf):
    return round_doubles(rollup.value_counts(fx.labelled_panel(spark, sf), "month", by=["label"],
                                             normalize=True))


@query("agg11_shares", LP + f"""
SELECT label,
  {r4('avg(CASE WHEN day_of_week < 5 THEN 1.0 ELSE 0.0 END) * 100')} AS weekday_pct,
  {r4('avg(CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END) * 100')} AS weekend_pct,
  {r4('avg(CASE WHEN temperature > 60 THEN 1.0 ELSE 0.0 END) * 100')} AS warm_pct
FROM labelled_panel GROUP BY label""")
def agg11_shares(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return round_doubles(p.groupBy("label").agg(
        rollup.share(F.col("day_of_week") < 5, "weekday_pct"),
        rollup.share(F.col("day_of_week") >= 5, "weekend_pct"),
        rollup.share(F.col("temperature") > 60, "warm_pct")))


@query("agg12_correlation_by_group", LP + f"""
SELECT label, {r4('corr(temperature, demand)')} AS temp_demand,
       {r4('corr(humidity, demand)')} AS humidity_demand, {r4('corr(windSpeed, demand)')} AS wind_demand
FROM labelled_panel GROUP BY label""")
def agg12_correlation_by_group(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return round_doubles(p.groupBy("label").agg(
        F.corr("temperature", "demand").alias("temp_demand"),
        F.corr("humidity", "demand").alias("humidity_demand"),
        F.corr("windSpeed", "demand").alias("wind_demand")))


@query("agg13_regression_by_group", LP + f"""
SELECT label, {r4('regr_slope(demand, temperature)')} AS slope,
       {r4('regr_intercept(demand, temperature)')} AS intercept
FROM labelled_panel GROUP BY label""")
def agg13_regression_by_group(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return round_doubles(p.groupBy("label").agg(
        F.regr_slope("demand", "temperature").alias("slope"),
        F.regr_intercept("demand", "temperature").alias("intercept")))


@query("agg14_distinct_cities", DP + """
SELECT DISTINCT city FROM demand_panel""")
def agg14_distinct_cities(spark, sf):
    return rollup.distinct_values(fx.demand_panel(spark, sf), "city")


@query("agg14_city_count", DP + """
SELECT CAST(count(DISTINCT city) AS BIGINT) AS n_cities FROM demand_panel""")
def agg14_city_count(spark, sf):
    return fx.demand_panel(spark, sf).agg(F.countDistinct("city").alias("n_cities"))


@query("agg15_extent", DP + """
SELECT city, strftime(min(local_time), '%Y-%m-%d %H:%M:%S') AS start,
       strftime(max(local_time), '%Y-%m-%d %H:%M:%S') AS "end", CAST(count(*) AS BIGINT) AS rows
FROM demand_panel GROUP BY city""")
def agg15_extent(spark, sf):
    e = rollup.extent(fx.demand_panel(spark, sf), by=["city"])
    return e.select("city", S.format_ts("start").alias("start"), S.format_ts("end").alias("end"), "rows")


# --- sort, limit, top-k (SRT1-SRT6) ------------------------------------------------------

HP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL)


@query("srt1_sort_by_time", DP + """
SELECT row_id, CAST(row_number() OVER (ORDER BY local_time, row_id) - 1 AS BIGINT) AS position FROM demand_panel""")
def srt1_sort_by_time(spark, sf):
    return ranking.global_row_index(fx.demand_panel(spark, sf).select("row_id", "local_time"),
                                    ["local_time", "row_id"], "position").select("row_id", "position")


@query("srt2_k_distance_curve", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
pairs AS (SELECT a.id, b.id AS nbr_id, sqrt(round(power(list_distance(a.vec, b.vec), 2), 9)) AS distance FROM v a, v b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nbr_id) AS rank FROM pairs)
SELECT CAST(row_number() OVER (ORDER BY distance, id) - 1 AS BIGINT) AS position, """ + r4("distance") + """ AS k_distance
FROM ranked WHERE rank = 20""")
def srt2_k_distance_curve(spark, sf):
    from demandspark.operators import neighbors
    kd = neighbors.k_distance(neighbors.embedding_points(fx.vectors(spark, sf)), 20, tile_size=256)
    return round_doubles(kd.select("position", "k_distance"))


@query("srt3_preview", DP + """
SELECT row_id, city, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, demand
FROM demand_panel ORDER BY local_time, row_id LIMIT 5""")
def srt3_preview(spark, sf):
    p = fx.demand_panel(spark, sf).orderBy("local_time", "row_id").limit(5)
    return p.select("row_id", "city", S.format_ts("local_time").alias("local_time"), "demand")


@query("srt4_first_100_with_total", HP + """
SELECT row_id, strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time, """ + r4("demand") + """ AS demand,
       (SELECT CAST(count(*) AS BIGINT) FROM hourly_panel WHERE city = 'view') AS total_rows
FROM hourly_panel WHERE city = 'view' ORDER BY local_time, row_id LIMIT 100""")
def srt4_first_100_with_total(spark, sf):
    h = fx.hourly_panel(spark, sf).filter(F.col("city") == "view")
    total = h.count()
    top = h.orderBy("local_time", "row_id").limit(100)
    return round_doubles(top.select("row_id", S.format_ts("local_time").alias("local_time"), "demand",
                                    F.lit(total).cast("long").alias("total_rows")))


@query("srt5_arg_max", LP + """
SELECT arg_max(label, m) AS best_label FROM (SELECT label, avg(demand) AS m FROM labelled_panel GROUP BY label)""")
def srt5_arg_max(spark, sf):
    per = fx.labelled_panel(spark, sf).groupBy("label").agg(F.avg("demand").alias("m"))
    return per.agg(F.max_by("label", "m").alias("best_label"))


@query("srt6_sorted_distinct", LP + "SELECT DISTINCT label FROM labelled_panel")
def srt6_sorted_distinct(spark, sf):
    return fx.labelled_panel(spark, sf).select("label").distinct().orderBy("label")
