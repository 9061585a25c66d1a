"""Driver tables -> the demand / weather panels the operators work on.

Each panel has a Spark builder (lazy DataFrame over the parquet tables, so
its work grows with them) and the equivalent DuckDB SQL used by the
oracles.  Definitions follow FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions import scalars as S

MEASURES = ("demand", "temperature", "humidity", "windSpeed")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hour(c) -> F.Column:
    return S.hour_start(c)


def demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: row_id, city, local_time, company, demand, weather, sparse_col."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("row_id"),
        F.col("event_type").alias("city"),
        F.col("ts").alias("local_time"),
        F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("company"),
        F.col("value").alias("demand"),
        F.when(eid % 11 != 0,
               F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 1.5 - 10
               ).alias("temperature"),
        F.when(eid % 13 != 0, ((eid * 37) % 103).cast("double")).alias("humidity"),
        ((F.col("user_id") * 13) % 41).cast("double").alias("windSpeed"),
        F.when(eid % 3 == 0, F.col("value")).alias("sparse_col"),
    )


def balance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).filter(F.col("row_id") % 2 == 0)


def subregion_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).filter(F.col("row_id") % 2 == 1).drop("company")


def texas_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly wide table: one demand column per city (a space in 'san antonio')."""
    ev = read_table(spark, sf_dir, "events")
    t = F.col("event_type")
    return (ev.groupBy(_hour(F.col("ts")).alias("date"))
            .agg(F.sum(F.when(t == "click", F.col("value"))).alias("houston"),
                 F.sum(F.when(t == "view", F.col("value"))).alias("san antonio"),
                 F.sum(F.when(t == "purchase", F.col("value"))).alias("dallas")))


def weather_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd event ids by (city, hour): mean temperature and humidity on a 0-1 scale."""
    p = demand_panel(spark, sf_dir).filter(F.col("row_id") % 2 == 1)
    return (p.groupBy("city", _hour(F.col("local_time")).alias("local_time"))
            .agg(F.avg("temperature").alias("temperature"),
                 F.avg(F.col("humidity") / 100.0).alias("humidity")))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, hour) grain: mean of every measure; row_id = smallest event id."""
    p = demand_panel(spark, sf_dir)
    return (p.groupBy("city", _hour(F.col("local_time")).alias("local_time"))
            .agg(F.min("row_id").alias("row_id"),
                 *[F.avg(m).alias(m) for m in MEASURES]))


def with_calendar(df: DataFrame, ts: str = "local_time") -> DataFrame:
    """hour, day_of_week, day_name, month, year, day (the reference's time parts)."""
    t = F.col(ts)
    return df.withColumns({
        "hour": S.hour(t), "day_of_week": S.day_of_week(t), "day_name": S.day_name(t),
        "month": F.month(t), "year": F.year(t), "day": F.dayofmonth(t),
    })


def labelled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """demand_panel + calendar parts + a stand-in cluster label (hour div 4, 0..5)."""
    p = with_calendar(demand_panel(spark, sf_dir))
    return p.withColumn("label", F.floor(F.col("hour") / 4).cast("int"))


def predictions_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly_panel(spark, sf_dir)
    return h.withColumns({"pred_a": F.col("demand") * 0.9 + 1,
                          "pred_b": F.col("demand") * 1.1 - 2})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", "label")


# --- the same panels as DuckDB CTEs ------------------------------------------------

SQL_DEMAND_PANEL = """demand_panel AS (
  SELECT event_id AS row_id, event_type AS city, ts AS local_time,
         concat('C', CAST(user_id % 3 AS VARCHAR)) AS company, value AS demand,
         CASE WHEN event_id % 11 <> 0
              THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 1.5 - 10 END AS temperature,
         CASE WHEN event_id % 13 <> 0 THEN CAST((event_id * 37) % 103 AS DOUBLE) END AS humidity,
         CAST((user_id * 13) % 41 AS DOUBLE) AS windSpeed,
         CASE WHEN event_id % 3 = 0 THEN value END AS sparse_col
  FROM events)"""

SQL_HOURLY_PANEL = """hourly_panel AS (
  SELECT city, date_trunc('hour', local_time) AS local_time, min(row_id) AS row_id,
         avg(demand) AS demand, avg(temperature) AS temperature,
         avg(humidity) AS humidity, avg(windSpeed) AS windSpeed
  FROM demand_panel GROUP BY city, date_trunc('hour', local_time))"""

SQL_WEATHER_PANEL = """weather AS (
  SELECT city, date_trunc('hour', local_time) AS local_time,
         avg(temperature) AS temperature, avg(humidity / 100.0) AS humidity
  FROM demand_panel WHERE row_id % 2 = 1
  GROUP BY city, date_trunc('hour', local_time))"""

SQL_TEXAS_WIDE = """texas_wide AS (
  SELECT date_trunc('hour', ts) AS date,
         sum(CASE WHEN event_type = 'click' THEN value END) AS houston,
         sum(CASE WHEN event_type = 'view' THEN value END) AS "san antonio",
         sum(CASE WHEN event_type = 'purchase' THEN value END) AS dallas
  FROM events GROUP BY date_trunc('hour', ts))"""

SQL_CALENDAR_COLS = """CAST(hour(local_time) AS INTEGER) AS hour,
         CAST(isodow(local_time) - 1 AS INTEGER) AS day_of_week,
         dayname(local_time) AS day_name, CAST(month(local_time) AS INTEGER) AS month,
         CAST(year(local_time) AS INTEGER) AS year, CAST(day(local_time) AS INTEGER) AS day"""

SQL_LABELLED_PANEL = f"""labelled_panel AS (
  SELECT *, CAST(hour // 4 AS INTEGER) AS label FROM (
    SELECT *, {SQL_CALENDAR_COLS} FROM demand_panel))"""

SQL_PREDICTIONS = """predictions AS (
  SELECT *, demand * 0.9 + 1 AS pred_a, demand * 1.1 - 2 AS pred_b FROM hourly_panel)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
