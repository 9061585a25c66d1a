"""Checked queries: windows (WIN1-7), cleaning (PRJ5, CLN1-3), anomalies (ANO1-5),
repair (REP1-3) and the joins they are made of (JN2-JN6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandspark.functions import scalars as S
from demandspark.operators import anomaly, clean, ranking, windows
from demandspark.plans.common import date_str, round_doubles
from demandspark.plans.registry import query, r4
from demandspark.sources import fixtures as fx

DP = fx.with_ctes(fx.SQL_DEMAND_PANEL)
HP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_HOURLY_PANEL)
LP = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_LABELLED_PANEL)
TS_SQL = "strftime(local_time, '%Y-%m-%d %H:%M:%S') AS local_time"
LAGS = (1, 24, 48, 168)
ROLLS = (6, 12, 24, 48)
W_CITY = "PARTITION BY city ORDER BY local_time, row_id"


def _ts(df, c="local_time"):
    return df.withColumn(c, S.format_ts(c))


# --- windows ------------------------------------------------------------------------------

@query("win1_lags", HP + "SELECT city, row_id, " + TS_SQL + ", " + ", ".join(
    f"{r4(f'lag(demand, {n}) OVER ({W_CITY})')} AS demand_lag_{n}" for n in LAGS) + " FROM hourly_panel")
def win1_lags(spark, sf):
    h = fx.hourly_panel(spark, sf).select("city", "row_id", "local_time", "demand")
    out = windows.lags_and_rolling(h, lags=LAGS, windows=())
    return round_doubles(_ts(out.drop("demand")))


def _roll_sql(n):
    frame = f"OVER ({W_CITY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{r4(f'CASE WHEN count(demand) {frame} = {n} THEN avg(demand) {frame} END')} AS demand_rolling_{n}"


@query("win3_rolling_mean", HP + "SELECT city, row_id, " + TS_SQL + ", "
       + ", ".join(_roll_sql(n) for n in ROLLS) + " FROM hourly_panel")
def win3_rolling_mean(spark, sf):
    h = fx.hourly_panel(spark, sf).select("city", "row_id", "local_time", "demand")
    out = windows.lags_and_rolling(h, lags=(), windows=ROLLS)
    return round_doubles(_ts(out.drop("demand")))


@query("win1_lags_small_chunks", HP + "SELECT city, row_id, " + TS_SQL + ", "
       + ", ".join(f"{r4(f'lag(demand, {n}) OVER ({W_CITY})')} AS demand_lag_{n}" for n in LAGS) + ", "
       + ", ".join(_roll_sql(n) for n in ROLLS) + " FROM hourly_panel")
def win1_lags_small_chunks(spark, sf):
    """Same features with chunks of 500 rows: halo rows carry every window across chunk edges."""
    h = fx.hourly_panel(spark, sf).select("city", "row_id", "local_time", "demand")
    out = windows.lags_and_rolling(h, lags=LAGS, windows=ROLLS, chunk_rows=500)
    return round_doubles(_ts(out.drop("demand")))


@query("win2_lead_target", HP + "SELECT city, row_id, " + TS_SQL + ", "
       + r4(f"lead(demand, 24) OVER ({W_CITY})") + " AS target_demand FROM hourly_panel")
def win2_lead_target(spark, sf):
    h = fx.hourly_panel(spark, sf).select("city", "row_id", "local_time", "demand")
    return round_doubles(_ts(windows.lead_target(h, chunk_rows=700).drop("demand")))


def _z_sql(c, part="PARTITION BY city"):
    return r4(f"abs(({c} - avg({c}) OVER ({part})) / nullif(stddev_samp({c}) OVER ({part}), 0))")


@query("win4_group_zscore", DP + "SELECT row_id, " + ", ".join(
    f"{_z_sql(c)} AS {c}_zscore" for c in fx.MEASURES) + " FROM demand_panel")
def win4_group_zscore(spark, sf):
    z = windows.group_zscore(fx.demand_panel(spark, sf), fx.MEASURES)
    return round_doubles(z.select("row_id", *[f"{c}_zscore" for c in fx.MEASURES]))


@query("win4_overall_zscore", DP + "SELECT row_id, " + f"{_z_sql('demand', '')} AS demand_zscore FROM demand_panel")
def win4_overall_zscore(spark, sf):
    z = windows.group_zscore(fx.demand_panel(spark, sf), ["demand"], by=None)
    return round_doubles(z.select("row_id", "demand_zscore"))


@query("win5_group_median", DP + f"""
SELECT row_id, {r4('median(temperature) OVER (PARTITION BY city)')} AS temperature_median
FROM demand_panel""")
def win5_group_median(spark, sf):
    p = fx.demand_panel(spark, sf)
    med = ranking.medians(p, ["temperature"], by=["city"])
    return round_doubles(windows.attach_group_stat(p, med, ["city"]).select("row_id", "temperature_median"))


_DAILY_SQL = """daily AS (SELECT city, CAST(local_time AS DATE) AS date, avg(demand) AS demand_mean
                FROM demand_panel GROUP BY city, CAST(local_time AS DATE))"""


@query("win6_pct_change", DP.rstrip() + ",\n" + _DAILY_SQL + f"""
SELECT city, CAST(date AS VARCHAR) AS date, {r4('demand_mean')} AS demand_mean,
       {r4('(demand_mean - lag(demand_mean) OVER w) / nullif(lag(demand_mean) OVER w, 0)')} AS demand_pct_change
FROM daily WINDOW w AS (PARTITION BY city ORDER BY date)""")
def win6_pct_change(spark, sf):
    d = windows.daily_pct_change(fx.demand_panel(spark, sf))
    return round_doubles(d.select("city", date_str("date"), "demand_mean", "demand_pct_change"))


@query("win6_pct_change_cross_city", DP.rstrip() + ",\n" + _DAILY_SQL + f"""
SELECT city, CAST(date AS VARCHAR) AS date, {r4('demand_mean')} AS demand_mean,
       {r4('(demand_mean - lag(demand_mean) OVER w) / nullif(lag(demand_mean) OVER w, 0)')} AS demand_pct_change
FROM daily WINDOW w AS (ORDER BY city, date)""")
def win6_pct_change_cross_city(spark, sf):
    d = windows.daily_pct_change(fx.demand_panel(spark, sf), cross_city=True)
    return round_doubles(d.select("city", date_str("date"), "demand_mean", "demand_pct_change"))


@query("win7_global_row_index", HP + """
SELECT row_id, CAST(row_number() OVER (ORDER BY city, local_time, row_id) - 1 AS BIGINT) AS row_index
FROM hourly_panel""")
def win7_global_row_index(spark, sf):
    h = fx.hourly_panel(spark, sf).select("city", "local_time", "row_id")
    return ranking.global_row_index(h, ["city", "local_time", "row_id"]).select("row_id", "row_index")


# --- cleaning -------------------------------------------------------------------------------

_PANEL_COLS = ["row_id", "city", "local_time", "company", "demand", "temperature", "humidity", "windSpeed"]


@query("prj5_drop_sparse_columns", DP + "SELECT row_id, city, " + TS_SQL
       + ", company, demand, temperature, humidity, windSpeed FROM demand_panel")
def prj5_drop_sparse_columns(spark, sf):
    return _ts(clean.drop_sparse_columns(fx.demand_panel(spark, sf)))


def _impute_sql(c):
    return (f"{r4(f'coalesce({c}_c, median({c}_c) OVER ())')} AS {c}")


@query("cln1_impute_median", DP + """, city_fill AS (
  SELECT row_id, coalesce(temperature, median(temperature) OVER (PARTITION BY city)) AS temperature_c,
         coalesce(humidity, median(humidity) OVER (PARTITION BY city)) AS humidity_c,
         coalesce(sparse_col, median(sparse_col) OVER (PARTITION BY city)) AS sparse_col_c
  FROM demand_panel)
SELECT row_id, """.replace("WITH ", "WITH ", 1) + ", ".join(
    _impute_sql(c) for c in ("temperature", "humidity", "sparse_col")) + " FROM city_fill")
def cln1_impute_median(spark, sf):
    out = clean.impute_median(fx.demand_panel(spark, sf), ["temperature", "humidity", "sparse_col"])
    return round_doubles(out.select("row_id", "temperature", "humidity", "sparse_col"))


_SET1_SQL = """merged AS (
  SELECT * FROM demand_panel WHERE row_id % 2 = 0
  UNION ALL BY NAME
  SELECT * EXCLUDE (company) FROM demand_panel WHERE row_id % 2 = 1)"""


@query("cln2_impute_mode", DP.rstrip() + ",\n" + _SET1_SQL + """,
m AS (SELECT company FROM (SELECT company, row_number() OVER (ORDER BY count(*) DESC, company) AS rn
      FROM merged WHERE company IS NOT NULL GROUP BY company) WHERE rn = 1)
SELECT row_id, coalesce(merged.company, m.company) AS company FROM merged, m""")
def cln2_impute_mode(spark, sf):
    merged = fx.balance_panel(spark, sf).unionByName(fx.subregion_panel(spark, sf),
                                                     allowMissingColumns=True)
    return clean.impute_mode(merged, ["company"]).select("row_id", "company")


def _mm_sql(c):
    rng = f"(max({c}) OVER () - min({c}) OVER ())"
    return (f"{r4(f'CASE WHEN {c} IS NULL THEN NULL WHEN {rng} = 0 THEN 0.0 '
                  f'ELSE ({c} - min({c}) OVER ()) / {rng} END')} AS {c}_normalized")


@query("cln3_min_max", DP + "SELECT row_id, " + ", ".join(_mm_sql(c) for c in fx.MEASURES)
       + " FROM demand_panel")
def cln3_min_max(spark, sf):
    out = clean.min_max(fx.demand_panel(spark, sf), list(fx.MEASURES))
    return round_doubles(out.select("row_id", *[f"{c}_normalized" for c in fx.MEASURES]))


# --- anomalies ----------------------------------------------------------------------------

def _range_sql(src="demand_panel"):
    parts = []
    for c, lo, hi in anomaly.RANGE_RULES:
        cond = " OR ".join(x for x in ((f"{c} < {lo}" if lo is not None else ""),
                                       (f"{c} > {hi}" if hi is not None else "")) if x)
        parts.append(f"SELECT row_id, 'range_{c}' AS detector FROM {src} WHERE {cond}")
    return "\nUNION ALL ".join(parts)


def _zdet_sql(src="demand_panel"):
    return "\nUNION ALL ".join(
        f"SELECT row_id, 'zscore_{c}' AS detector FROM (SELECT row_id, abs(({c} - avg({c}) OVER (PARTITION BY city))"
        f" / nullif(stddev_samp({c}) OVER (PARTITION BY city), 0)) AS z FROM {src}) WHERE z > 3"
        for c in anomaly.ZSCORE_COLUMNS)


_SPIKE_DAYS_SQL = _DAILY_SQL + """,
chg AS (SELECT *, lag(demand_mean) OVER (PARTITION BY city ORDER BY date) AS prev FROM daily),
spikes AS (SELECT city, date, demand_mean, (demand_mean - prev) / nullif(prev, 0) AS demand_pct_change
           FROM chg WHERE (demand_mean - prev) / nullif(prev, 0) > 0.5
                       OR (demand_mean - prev) / nullif(prev, 0) < -0.5 OR (prev = 0 AND demand_mean <> 0))"""


def _spike_rows_sql(src="demand_panel"):
    return (f"SELECT row_id, 'spike' AS detector FROM {src} p WHERE EXISTS (SELECT 1 FROM spikes s "
            f"WHERE s.city = p.city AND s.date = CAST(p.local_time AS DATE))")


@query("ano1_range_anomalies", DP + _range_sql())
def ano1_range_anomalies(spark, sf):
    return anomaly.range_anomalies(fx.demand_panel(spark, sf))


@query("ano2_zscore_anomalies", DP + _zdet_sql())
def ano2_zscore_anomalies(spark, sf):
    return anomaly.zscore_anomalies(fx.demand_panel(spark, sf))


@query("ano4_spike_days", DP.rstrip() + ",\n" + _SPIKE_DAYS_SQL + f"""
SELECT city, CAST(date AS VARCHAR) AS date, {r4('demand_mean')} AS demand_mean,
       {r4('demand_pct_change')} AS demand_pct_change FROM spikes""")
def ano4_spike_days(spark, sf):
    d = anomaly.spike_days(fx.demand_panel(spark, sf))
    return round_doubles(d.select("city", date_str("date"), "demand_mean", "demand_pct_change"))


@query("ano4_spike_rows", DP.rstrip() + ",\n" + _SPIKE_DAYS_SQL + "\n" + _spike_rows_sql())
def ano4_spike_rows(spark, sf):
    return anomaly.spike_anomalies(fx.demand_panel(spark, sf))


_DET_SQL = f"""det AS (SELECT DISTINCT row_id, detector FROM (
{_range_sql()}
UNION ALL {_zdet_sql()}
UNION ALL {_spike_rows_sql()}))"""

_ANO5_CTES = DP.rstrip() + ",\n" + _SPIKE_DAYS_SQL + ",\n" + _DET_SQL


@query("ano5_detect_anomalies", _ANO5_CTES + "\nSELECT row_id, detector FROM det")
def ano5_detect_anomalies(spark, sf):
    return anomaly.detect_anomalies(fx.demand_panel(spark, sf))


@query("set2_detector_union", DP.rstrip() + ",\n" + _SPIKE_DAYS_SQL + f"""
{_range_sql()}
UNION ALL {_zdet_sql()}
UNION ALL {_spike_rows_sql()}""")
def set2_detector_union(spark, sf):
    p = fx.demand_panel(spark, sf)
    parts = [anomaly.range_anomalies(p), anomaly.zscore_anomalies(p), anomaly.spike_anomalies(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("ano5_detector_counts", _ANO5_CTES + "\nSELECT detector, CAST(count(*) AS BIGINT) AS rows FROM det GROUP BY detector")
def ano5_detector_counts(spark, sf):
    return anomaly.detector_counts(anomaly.detect_anomalies(fx.demand_panel(spark, sf)))


@query("jn2_anomaly_rows_semi_join", _ANO5_CTES + "\nSELECT row_id, " + r4("demand") +
       " AS demand FROM demand_panel WHERE row_id IN (SELECT row_id FROM det)")
def jn2_anomaly_rows_semi_join(spark, sf):
    p = fx.demand_panel(spark, sf)
    rows = anomaly.anomaly_rows(p, anomaly.detect_anomalies(p))
    return round_doubles(rows.select("row_id", "demand"))


@query("jn3_spike_day_semi_join", DP.rstrip() + ",\n" + _SPIKE_DAYS_SQL + """
SELECT row_id, city FROM demand_panel p
WHERE EXISTS (SELECT 1 FROM spikes s WHERE s.city = p.city AND s.date = CAST(p.local_time AS DATE))""")
def jn3_spike_day_semi_join(spark, sf):
    p = fx.demand_panel(spark, sf)
    days = anomaly.spike_days(p).select("city", "date")
    return (p.withColumn("date", S.date_part("local_time"))
            .join(days, ["city", "date"], "left_semi").select("row_id", "city"))


# --- repair -------------------------------------------------------------------------------

_REP_CTES = fx.with_ctes(fx.SQL_DEMAND_PANEL, fx.SQL_LABELLED_PANEL).rstrip() + ",\n" + \
    _SPIKE_DAYS_SQL + ",\n" + _DET_SQL + """,
flag AS (SELECT DISTINCT row_id FROM det),
q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi"
                             for c in fx.MEASURES) + """ FROM labelled_panel),
med AS (SELECT city, """ + ", ".join(f"median({c}) AS {c}_med" for c in fx.MEASURES) + """
        FROM labelled_panel GROUP BY city),
sim AS (SELECT city, hour, day_of_week, avg(demand) AS sim_mean FROM labelled_panel
        WHERE row_id NOT IN (SELECT row_id FROM flag) GROUP BY city, hour, day_of_week),
joined AS (SELECT p.*, f.row_id IS NOT NULL AS flagged, q.*, med.* EXCLUDE (city), sim.sim_mean
           FROM labelled_panel p CROSS JOIN q LEFT JOIN flag f ON f.row_id = p.row_id
           LEFT JOIN med ON med.city = p.city
           LEFT JOIN sim ON sim.city = p.city AND sim.hour = p.hour AND sim.day_of_week = p.day_of_week)"""


def _rep_sql(c):
    out = f"flagged AND ({c} < {c}_lo OR {c} > {c}_hi)"
    repl = "coalesce(sim_mean, demand_med)" if c == "demand" else f"{c}_med"
    return f"{r4(f'CASE WHEN {out} THEN {repl} ELSE {c} END')} AS {c}"


def _repaired(spark, sf):
    p = fx.labelled_panel(spark, sf)
    det = anomaly.detect_anomalies(p)
    return clean.handle_anomalies(p, det)


@query("rep1_repair_weather", _REP_CTES + "\nSELECT row_id, " + ", ".join(
    _rep_sql(c) for c in ("temperature", "humidity", "windSpeed")) + " FROM joined")
def rep1_repair_weather(spark, sf):
    return round_doubles(_repaired(spark, sf).select("row_id", "temperature", "humidity", "windSpeed"))


@query("rep2_repair_demand", _REP_CTES + "\nSELECT row_id, " + _rep_sql("demand") + " FROM joined")
def rep2_repair_demand(spark, sf):
    return round_doubles(_repaired(spark, sf).select("row_id", "demand"))


@query("rep3_handle_anomalies", _REP_CTES + "\nSELECT row_id, city, " + ", ".join(
    _rep_sql(c) for c in fx.MEASURES) + " FROM joined")
def rep3_handle_anomalies(spark, sf):
    return round_doubles(_repaired(spark, sf).select("row_id", "city", *fx.MEASURES))


@query("jn4_similar_hours_anti_join", _REP_CTES + f"""
SELECT city, hour, day_of_week, {r4("sim_mean")} AS similar_mean FROM sim""")
def jn4_similar_hours_anti_join(spark, sf):
    p = fx.labelled_panel(spark, sf)
    flagged = anomaly.detect_anomalies(p).select("row_id").distinct()
    sim = (p.join(flagged, "row_id", "left_anti").groupBy("city", "hour", "day_of_week")
           .agg(F.avg("demand").alias("similar_mean")))
    return round_doubles(sim)


@query("jn5_city_median_lookup", LP + f"""
SELECT row_id, {r4('median(demand) OVER (PARTITION BY city)')} AS demand_median FROM labelled_panel""")
def jn5_city_median_lookup(spark, sf):
    p = fx.labelled_panel(spark, sf)
    med = ranking.medians(p, ["demand"], by=["city"])
    return round_doubles(p.join(med, "city", "left").select("row_id", "demand_median"))


@query("jn6_similar_period_lookup", LP + f""",
sim AS (SELECT city, hour, day_of_week, avg(demand) AS s FROM labelled_panel GROUP BY city, hour, day_of_week)
SELECT p.row_id, {r4('coalesce(sim.s, p.demand)')} AS similar_demand FROM labelled_panel p
LEFT JOIN sim ON sim.city = p.city AND sim.hour = p.hour AND sim.day_of_week = p.day_of_week""")
def jn6_similar_period_lookup(spark, sf):
    p = fx.labelled_panel(spark, sf)
    sim = p.groupBy("city", "hour", "day_of_week").agg(F.avg("demand").alias("_s"))
    out = p.join(sim, ["city", "hour", "day_of_week"], "left")
    return round_doubles(out.select("row_id", F.coalesce("_s", "demand").alias("similar_demand")))
