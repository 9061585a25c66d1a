"""Checked queries: cluster profiles and reports (AGG16-19, CLU12-16, RSH2-6) on the
stand-in label ``hour div 4`` of the labelled panel (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.operators import profile, reshape
from demandspark.plans.common import round_doubles
from demandspark.plans.registry import query, r4
from demandspark.sources import fixtures as fx

LP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_LABELLED_PANEL)
LABELS = list(range(6))
F6 = profile.PROFILE_FEATURES


@query("agg16_cluster_count_mean", LP + f"""
SELECT label, CAST(count(*) AS BIGINT) AS count, {r4('avg(demand)')} AS avg_demand
FROM labelled_panel GROUP BY label""")
def agg16_cluster_count_mean(spark, sf):
    return round_doubles(profile.count_and_mean(fx.labelled_panel(spark, sf)))


@query("agg17_wide_profile", LP + "SELECT label, " + ", ".join(
    f"{r4(f'avg({c})')} AS {c}_mean, {r4(f'stddev_samp({c})')} AS {c}_std, "
    f"{r4(f'min({c})')} AS {c}_min, {r4(f'max({c})')} AS {c}_max"
    + (", CAST(count(demand) AS BIGINT) AS demand_count" if c == "demand" else "")
    for c in F6) + " FROM labelled_panel GROUP BY label")
def agg17_wide_profile(spark, sf):
    p = fx.labelled_panel(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("hour", "day_of_week")})
    return round_doubles(profile.wide_profile(p))


@query("agg18_short_profile", LP + "SELECT label, " + ", ".join(
    f"{r4(f'{fn}({c})')} AS {c}_{n}" for c in ("demand", "temperature", "hour")
    for n, fn in (("mean", "avg"), ("min", "min"), ("max", "max"))) + ", " + ", ".join(
    f"{r4(f'avg({c})')} AS {c}_mean" for c in ("humidity", "windSpeed", "day_of_week"))
    + " FROM labelled_panel GROUP BY label")
def agg18_short_profile(spark, sf):
    p = fx.labelled_panel(spark, sf).withColumn("hour", F.col("hour").cast("double"))
    return round_doubles(profile.short_profile(p))


def _norm_sql(c):
    rng = f"(max({c}) OVER () - min({c}) OVER ())"
    return f"CASE WHEN {rng} = 0 THEN 0.0 ELSE ({c} - min({c}) OVER ()) / {rng} END AS {c}"


@query("agg19_normalized_profile", LP + ", scaled AS (SELECT label, " + ", ".join(
    _norm_sql(c) for c in F6) + " FROM labelled_panel)\nSELECT label, " + ", ".join(
    f"{r4(f'avg({c})')} AS {c}" for c in F6) + " FROM scaled GROUP BY label")
def agg19_normalized_profile(spark, sf):
    return round_doubles(profile.normalized_profile(fx.labelled_panel(spark, sf)))


_NAME_SQL = """q AS (SELECT quantile_cont(demand, 0.25) AS d25, quantile_cont(demand, 0.75) AS d75,
                  quantile_cont(temperature, 0.25) AS t25, quantile_cont(temperature, 0.75) AS t75
           FROM labelled_panel),
prof AS (SELECT label, avg(demand) AS dm, avg(temperature) AS tm, avg(hour) AS hm
         FROM labelled_panel GROUP BY label),
named AS (SELECT prof.*, (CASE WHEN dm > d75 THEN 'High Demand' WHEN dm < d25 THEN 'Low Demand'
                  ELSE 'Medium Demand' END) || ' - ' ||
                (CASE WHEN tm > t75 THEN 'Hot' WHEN tm < t25 THEN 'Cool' ELSE 'Moderate' END) || ' ' ||
                (CASE WHEN hm >= 5 AND hm < 12 THEN 'Morning' WHEN hm >= 12 AND hm < 17 THEN 'Afternoon'
                      WHEN hm >= 17 AND hm < 22 THEN 'Evening' ELSE 'Night' END) AS cluster_name
          FROM prof, q)"""


@query("clu12_name_clusters", LP.rstrip() + ",\n" + _NAME_SQL + f"""
SELECT label, {r4('dm')} AS demand_mean, {r4('tm')} AS temperature_mean, {r4('hm')} AS hour_mean,
       cluster_name FROM named""")
def clu12_name_clusters(spark, sf):
    return round_doubles(profile.name_clusters(fx.labelled_panel(spark, sf)))


@query("clu13_cluster_summary", LP.rstrip() + ",\n" + _NAME_SQL + f""",
counts AS (SELECT label, count(*) AS n FROM labelled_panel GROUP BY label)
SELECT named.label, cluster_name AS description, CAST(n AS BIGINT) AS count,
       printf('%.2f%%', n * 100.0 / sum(n) OVER ()) AS percentage, {r4('dm')} AS avg_demand,
       {r4('tm')} AS avg_temperature, {r4('hm')} AS avg_hour
FROM named JOIN counts ON counts.label = named.label""")
def clu13_cluster_summary(spark, sf):
    return round_doubles(profile.cluster_summary(fx.labelled_panel(spark, sf)))


_MODE = """(SELECT label, {col} AS {name} FROM (SELECT label, {col},
      row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, {col}) AS rn
      FROM labelled_panel GROUP BY label, {col}) WHERE rn = 1)"""

_REPORT_SQL = LP.rstrip() + f""",
base AS (SELECT label, count(*) AS count,
  avg(demand) AS demand_mean, stddev_samp(demand) AS demand_std, min(demand) AS demand_min, max(demand) AS demand_max,
  avg(temperature) AS temperature_mean, stddev_samp(temperature) AS temperature_std,
  min(temperature) AS temperature_min, max(temperature) AS temperature_max, avg(hour) AS hour_mean,
  corr(temperature, demand) AS temp_demand, corr(humidity, demand) AS humidity_demand,
  corr(windSpeed, demand) AS wind_demand,
  avg(CASE WHEN day_of_week < 5 THEN 1.0 ELSE 0.0 END) * 100 AS weekday_pct,
  avg(CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END) * 100 AS weekend_pct,
  avg(CASE WHEN hour >= 5 AND hour < 12 THEN 1.0 ELSE 0.0 END) * 100 AS morning_pct,
  avg(CASE WHEN hour >= 12 AND hour < 17 THEN 1.0 ELSE 0.0 END) * 100 AS afternoon_pct,
  avg(CASE WHEN hour >= 17 AND hour < 22 THEN 1.0 ELSE 0.0 END) * 100 AS evening_pct,
  avg(CASE WHEN hour < 5 OR hour >= 22 THEN 1.0 ELSE 0.0 END) * 100 AS night_pct,
  median(demand) AS demand_median, median(temperature) AS temperature_median
  FROM labelled_panel GROUP BY label),
rep AS (SELECT base.*, count * 100.0 / sum(count) OVER () AS percentage, hm.hour_mode, dm.common_day
        FROM base JOIN {_MODE.format(col='hour', name='hour_mode')} hm ON hm.label = base.label
        JOIN {_MODE.format(col='day_name', name='common_day')} dm ON dm.label = base.label)"""

_REPORT_NUM = ["demand_mean", "demand_std", "demand_min", "demand_max", "demand_median",
               "temperature_mean", "temperature_std", "temperature_min", "temperature_max",
               "temperature_median", "hour_mean", "temp_demand", "humidity_demand", "wind_demand",
               "weekday_pct", "weekend_pct", "morning_pct", "afternoon_pct", "evening_pct", "night_pct",
               "percentage"]


@query("clu14_profile_report", _REPORT_SQL + "\nSELECT label, CAST(count AS BIGINT) AS count, "
       "CAST(hour_mode AS INTEGER) AS hour_mode, common_day, "
       + ", ".join(f"{r4(c)} AS {c}" for c in _REPORT_NUM) + " FROM rep")
def clu14_profile_report(spark, sf):
    rep = profile.profile_report(fx.labelled_panel(spark, sf))
    return round_doubles(rep.select("label", "count", "hour_mode", "common_day", *_REPORT_NUM))


@query("clu14_month_distribution", LP + f"""
SELECT label, CAST(month AS INTEGER) AS month,
       {r4('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY label)')} AS pct
FROM labelled_panel GROUP BY label, month""")
def clu14_month_distribution(spark, sf):
    rep = profile.profile_report(fx.labelled_panel(spark, sf))
    return round_doubles(rep.select("label", F.explode("monthly_distribution").alias("month", "pct")))


@query("clu15_interpretability", _REPORT_SQL + """,
scored AS (SELECT label, least(percentage / 5 * 25, 25.0) AS size_score,
  least(abs(demand_mean - (SELECT avg(demand) FROM labelled_panel)) / (SELECT avg(demand) FROM labelled_panel) * 100, 25.0)
    AS distinctiveness_score,
  least(greatest(morning_pct, afternoon_pct, evening_pct, night_pct), 25.0) AS time_clarity,
  abs(temp_demand) * 25 AS correlation_strength FROM rep),
tot AS (SELECT *, size_score + distinctiveness_score + time_clarity + correlation_strength AS total_score FROM scored)
SELECT label, """ + ", ".join(f"{r4(c)} AS {c}" for c in ("size_score", "distinctiveness_score", "time_clarity",
                                                           "correlation_strength", "total_score")) + """,
  CASE WHEN total_score >= 75 THEN 'Excellent' WHEN total_score >= 60 THEN 'Good'
       WHEN total_score >= 45 THEN 'Moderate' WHEN total_score >= 30 THEN 'Fair' ELSE 'Poor' END AS rating
FROM tot""")
def clu15_interpretability(spark, sf):
    p = fx.labelled_panel(spark, sf)
    return round_doubles(profile.interpretability(profile.profile_report(p), df=p))


@query("clu16_hourly_profile", LP + f"""
SELECT label, hour, {r4('avg(demand)')} AS avg_demand FROM labelled_panel GROUP BY label, hour""")
def clu16_hourly_profile(spark, sf):
    return round_doubles(profile.hourly_profile(fx.labelled_panel(spark, sf)))


@query("rsh2_pivot_mean", LP + "SELECT hour, " + ", ".join(
    f"{r4(f'avg(CASE WHEN label = {k} THEN demand END)')} AS \"{k}\"" for k in LABELS)
    + " FROM labelled_panel GROUP BY hour")
def rsh2_pivot_mean(spark, sf):
    return round_doubles(reshape.pivot_mean(fx.labelled_panel(spark, sf), "hour", "label", "demand", LABELS))


@query("rsh3_crosstab_counts", LP + "SELECT day_name, " + ", ".join(
    f"CAST(count(CASE WHEN label = {k} THEN 1 END) AS BIGINT) AS \"{k}\"" for k in LABELS)
    + " FROM labelled_panel GROUP BY day_name")
def rsh3_crosstab_counts(spark, sf):
    return reshape.crosstab(fx.labelled_panel(spark, sf), "day_name", "label", LABELS)


@query("rsh4_crosstab_row_share", LP + f"""
SELECT day_name, label, CAST(count(*) AS BIGINT) AS count,
       {r4('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY day_name)')} AS share
FROM labelled_panel GROUP BY day_name, label""")
def rsh4_crosstab_row_share(spark, sf):
    return round_doubles(reshape.crosstab_row_share(fx.labelled_panel(spark, sf), "day_name", "label"))


@query("rsh5_crosstab_aggregate", LP + "SELECT hour, " + ", ".join(
    f"{r4(f'avg(CASE WHEN day_of_week = {d} THEN label END)')} AS \"{d}\"" for d in range(7))
    + " FROM labelled_panel GROUP BY hour")
def rsh5_crosstab_aggregate(spark, sf):
    return round_doubles(reshape.pivot_mean(fx.labelled_panel(spark, sf), "hour", "day_of_week", "label",
                                            list(range(7))))


@query("rsh6_calendar_matrix", LP + """, common AS (
  SELECT month, day, label FROM (SELECT month, day, label,
    row_number() OVER (PARTITION BY month, day ORDER BY count(*) DESC, label) AS rn
    FROM labelled_panel GROUP BY month, day, label) WHERE rn = 1)
SELECT day, """ + ", ".join(f"CAST(max(CASE WHEN month = {m} THEN label END) AS DOUBLE) AS \"{m}\"" for m in range(1, 13))
       + " FROM common GROUP BY day")
def rsh6_calendar_matrix(spark, sf):
    cal = reshape.calendar_matrix(fx.labelled_panel(spark, sf))
    return cal.select("day", *[F.col(f"`{m}`").cast("double").alias(str(m)) for m in range(1, 13)])


@query("clu17_run_report", LP + """
SELECT metric, value FROM (
  SELECT 'total_observations' AS metric, CAST(count(*) AS VARCHAR) AS value FROM labelled_panel
  UNION ALL SELECT 'features_used', 'demand,temperature,humidity,windSpeed,hour,day_of_week,month'
  UNION ALL SELECT 'optimal_k', CAST(count(DISTINCT label) AS VARCHAR) FROM labelled_panel
  UNION ALL SELECT 'silhouette_score', ''
  UNION ALL SELECT 'cluster_sizes', string_agg(label || ':' || n, ',' ORDER BY label)
            FROM (SELECT label, count(*) AS n FROM labelled_panel GROUP BY label))""")
def clu17_run_report(spark, sf):
    from demandspark.operators import scale
    p = fx.labelled_panel(spark, sf)
    k = p.select("label").distinct().count()
    return profile.run_report(p, list(scale.CLUSTER_FEATURES), k, None)
