"""Sources and sinks (SRC1-4, SNK1-4).

Schemas are declared, never inferred; weather JSON may hold a single object
or an array of objects per file, and the city comes from the file stem (or
from a ``city=`` directory when the folder is Hive-partitioned).
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions import scalars as S

DEMAND_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("city", T.StringType()),
    T.StructField("local_time", T.TimestampNTZType()),
    T.StructField("company", T.StringType()),
    T.StructField("demand", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("windSpeed", T.DoubleType()),
    T.StructField("sparse_col", T.DoubleType()),
])

CSV_TS_WRITE = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_TS_READ = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

WIDE_CITIES = ("houston", "san antonio", "dallas")

WIDE_SCHEMA = T.StructType([T.StructField("date", T.TimestampNTZType())]
                           + [T.StructField(c, T.DoubleType()) for c in WIDE_CITIES])

# The weather keys a reading may carry.
WEATHER_KEYS = ("temperature", "humidity", "windSpeed", "pressure", "precipIntensity",
                "precipProbability", "cloudCover", "uvIndex", "visibility")

WEATHER_RECORD = T.StructType([T.StructField("time", T.LongType())]
                              + [T.StructField(k, T.DoubleType()) for k in WEATHER_KEYS])


def read_demand_csv(spark: SparkSession, path: str | Sequence[str],
                    schema: T.StructType = DEMAND_SCHEMA) -> DataFrame:
    """SRC1: header CSV with a declared schema; absent columns are simply not in the schema."""
    return (spark.read.schema(schema).option("header", True)
            .option("timestampNTZFormat", CSV_TS_READ)
            .csv(path))


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType = WIDE_SCHEMA) -> DataFrame:
    """SRC2: wide table, one demand column per city."""
    return read_demand_csv(spark, path, schema)


def read_weather_json(spark: SparkSession, paths: str | Sequence[str], tz: str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """SRC3: weather readings -> (city, local_time, weather columns).

    A file holds one object or an array of objects; both are read with one
    declared schema, so no inference pass runs.  Missing paths are skipped with
    a warning; rows without ``time`` are dropped.
    """
    if isinstance(paths, str):
        paths = [paths]
    existing = [p for p in paths if _exists(spark, p)]
    for p in paths:
        if p not in existing:
            warnings.warn(f"weather file not found, skipped: {p}", stacklevel=2)
    if not existing:
        return spark.createDataFrame([], weather_output_schema())
    # An object file is a struct at top level; an array file is a top-level JSON
    # array, which the reader already turns into one row per element: one declared
    # schema covers both, and no inference pass runs.
    return _weather(spark.read.option("multiLine", multi_line).schema(WEATHER_RECORD).json(existing), tz)


def read_weather_arrays(spark: SparkSession, paths: str | Sequence[str], tz: str | None = None) -> DataFrame:
    """SRC3 for large files: the same readings, with a file's array split between tasks.

    Files are read as text whose lines end at every closing brace, which Spark
    splits by byte ranges, so one array of any size is parsed by many tasks.
    Readings are flat objects; if any piece is not a whole one (a nested object,
    or a brace inside a text), all files are read by ``read_weather_json``.
    """
    if isinstance(paths, str):
        paths = [paths]
    existing = [p for p in paths if _exists(spark, p)]
    if len(existing) < len(paths) or not existing:
        return read_weather_json(spark, paths, tz)
    text = spark.read.option("lineSep", "}").text(existing)
    partitioned = "city" in text.columns
    piece = F.regexp_replace("value", r"^[\s\[\],]+", "")
    broken = T.StructType([*WEATHER_RECORD.fields, T.StructField("_broken", T.StringType())])
    parsed = text.select(
        (F.col("city") if partitioned else S.file_stem(F.col("_metadata.file_name"))).alias("city"),
        piece.alias("piece")).filter("piece <> ''").select(
        "city", F.from_json(F.concat("piece", F.lit("}")), broken,
                            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"), "piece")
    whole = F.col("piece").startswith("{") & F.col("r._broken").isNull() & ~F.col("piece").substr(2, 1 << 30).contains("{")
    if not parsed.filter(~whole).isEmpty():
        return read_weather_json(spark, paths, tz)
    return _weather(parsed.select("city", "r.*").drop("_broken"), tz)


def _weather(raw: DataFrame, tz: str | None) -> DataFrame:
    partitioned = "city" in raw.columns
    rec = raw.select(
        (F.col("city") if partitioned else S.file_stem(F.col("_metadata.file_name"))).alias("city"),
        *[F.col(c) for c in WEATHER_RECORD.fieldNames()])
    rec = rec.filter(F.col("time").isNotNull())
    return rec.select(
        "city",
        S.epoch_to_local(F.col("time"), tz).alias("local_time"),
        *[(F.col("humidity") * 100.0).alias("humidity") if k == "humidity" else F.col(k)
          for k in WEATHER_KEYS])


def weather_output_schema() -> T.StructType:
    return T.StructType([T.StructField("city", T.StringType()),
                         T.StructField("local_time", T.TimestampNTZType())]
                        + [T.StructField(k, T.DoubleType()) for k in WEATHER_KEYS])


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame:
    """SRC4: processed table; ``local_time`` cast to timestamp, ``demand`` required.

    A CSV is read with ``schema``, or else with its number columns inferred (one
    more pass); time columns stay text until the tolerant parse below.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else
              reader.option("inferSchema", True).option("prefersDate", False)
              .option("timestampFormat", "'none'").option("timestampNTZFormat", "'none'")).csv(path)
    if "demand" not in df.columns:
        raise ValueError("processed table has no 'demand' column")
    if "local_time" in df.columns and df.schema["local_time"].dataType != T.TimestampNTZType():
        df = df.withColumn("local_time", S.parse_ts(F.col("local_time").cast("string")))
    if fmt != "parquet":
        df = df.withColumn("demand", F.col("demand").cast("double"))
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(hpath)) and len(fs.globStatus(hpath)) > 0


# --- sinks ----------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", CSV_TS_WRITE).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


MANIFESTS = "_manifests"


def _file_system(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def commit_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet",
                  partition_by: Sequence[str] | None = None) -> dict[str, str]:
    """Write several tables so that readers see all of them or none.

    Every table goes to a folder of a new version; only when all are written is
    one small manifest file created that names them, and ``committed_tables``
    reads through the newest manifest.  A run that breaks leaves the tables of
    the last manifest in force; a rerun replaces all of them together.  Two
    writers of the same version number end with one manifest, the other fails.
    """
    base = base.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    version = max(_versions(spark, base), default=0) + 1
    folder = f"{base}/v{version:08d}-{uuid.uuid4().hex}"
    paths = {name: write_table(df, f"{folder}/{name}", fmt, partition_by=partition_by) for name, df in tables.items()}
    fs, target = _file_system(spark, f"{base}/{MANIFESTS}/{version:08d}.json")
    out = fs.create(target, False)      # fails if the version is there
    try:
        out.write(bytearray(json.dumps({"format": fmt, "tables": paths}).encode()))
    finally:
        out.close()
    return paths


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, folder = _file_system(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.getLen() > 0]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def committed_tables(spark: SparkSession, base: str) -> dict[str, str]:
    """Table name -> folder of the newest committed version; empty if nothing was committed."""
    base = base.rstrip("/")
    versions = _versions(spark, base)
    if not versions:
        return {}
    text = spark.read.text(f"{base}/{MANIFESTS}/{max(versions):08d}.json", wholetext=True).first()["value"]
    return json.loads(text)["tables"]


def write_tables(processed: DataFrame, daily: DataFrame, weekly: DataFrame, base: str,
                 fmt: str = "parquet", partition_by_city: bool = False) -> dict[str, str]:
    """SNK1: processed data, daily and weekly stats (CSV with header on request), committed together."""
    return commit_tables({"processed": processed, "daily_stats": daily, "weekly_stats": weekly}, base, fmt,
                         ["city"] if partition_by_city else None)


def write_labeled(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """SNK2: rows with their cluster labels and names."""
    return write_table(df, path, fmt)


def write_report(metrics: DataFrame, path: str) -> str:
    """SNK3: two-column (metric, value) table written as header CSV."""
    return write_table(metrics.select("metric", F.col("value").cast("string")), path, "csv")
