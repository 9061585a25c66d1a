"""Column expressions (JVM-side, codegen friendly) for the scalar functions.

Every function returns a ``Column``; none of them uses a Python UDF.
ANSI mode is on by default in Spark 4, so all divisions go through
``safe_div`` (``try_divide``): a zero or NULL divisor gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """NULL instead of an error or +-inf when the divisor is 0 or NULL."""
    return F.try_divide(col(num), col(den))


def oracle_round(c: ColumnOrName, digits: int = 4) -> Column:
    """Rounding used on both engines before hashing: exact ties moved off the boundary."""
    return F.round(col(c) + F.lit(3.3e-7), digits)


# --- FN1-FN3: timestamps ---------------------------------------------------

def epoch_to_local(epoch_s: ColumnOrName, tz: str | None = None) -> Column:
    """Epoch seconds -> wall-clock timestamp (TIMESTAMP_NTZ) in ``tz`` (UTC when None).

    Built from the day number and the seconds of the day, so the session time
    zone never enters; a named ``tz`` is applied with ``convert_timezone``.
    """
    e = col(epoch_s).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(e / 86400).cast("int"))
    sod = e - F.floor(e / 86400) * 86400
    utc = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day),
                               F.floor(sod / 3600), F.floor(sod % 3600 / 60), sod % 60)
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc) if tz else utc


def ntz_epoch_seconds(c: ColumnOrName) -> Column:
    """Whole seconds from 1970-01-01 00:00:00 to a wall-clock timestamp read as UTC."""
    t = col(c)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def hour_start(c: ColumnOrName) -> Column:
    """Wall-clock timestamp truncated to the hour, without a session-zone round trip."""
    t = col(c)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def format_ts(c: ColumnOrName, with_time: bool = True) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd")


def parse_ts(c: ColumnOrName, fmt: str | None = None) -> Column:
    """Tolerant parse: a bad value becomes NULL instead of failing the job."""
    if fmt:
        return F.try_to_timestamp(col(c), F.lit(fmt)).cast("timestamp_ntz")
    return F.try_to_timestamp(col(c)).cast("timestamp_ntz")


# --- FN4-FN13: calendar parts and labels ---------------------------------------

def hour(c: ColumnOrName) -> Column:
    return F.hour(col(c))


def day_of_week(c: ColumnOrName) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(c))


def day_name(c: ColumnOrName) -> Column:
    return F.date_format(col(c), "EEEE")


def iso_week(c: ColumnOrName) -> Column:
    return F.weekofyear(col(c))


def date_part(c: ColumnOrName) -> Column:
    return F.to_date(col(c))


def season(month: ColumnOrName) -> Column:
    m = col(month)
    return (F.when(m.isin(12, 1, 2), "Winter")
            .when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer")
            .otherwise("Fall"))


def is_weekend(dow: ColumnOrName) -> Column:
    return F.when(col(dow) >= 5, 1).otherwise(0)


def time_of_day(h: ColumnOrName) -> Column:
    """Feature bins: <6 Night, <12 Morning, <18 Afternoon, else Evening."""
    h = col(h)
    return (F.when(h < 6, "Night").when(h < 12, "Morning")
            .when(h < 18, "Afternoon").otherwise("Evening"))


def period_of_day(h: ColumnOrName) -> Column:
    """Cluster-naming bins: [5,12) Morning, [12,17) Afternoon, [17,22) Evening, else Night."""
    h = col(h)
    return (F.when((h >= 5) & (h < 12), "Morning")
            .when((h >= 12) & (h < 17), "Afternoon")
            .when((h >= 17) & (h < 22), "Evening")
            .otherwise("Night"))


# Peak hours 17, 18, 19, 20.
PEAK_HOURS = (17, 18, 19, 20)


def is_peak_hour(h: ColumnOrName) -> Column:
    return F.when(col(h).isin(*PEAK_HOURS), 1).otherwise(0)


# --- FN14-FN23: arithmetic and strings -------------------------------------------

def temp_demand_ratio(demand: ColumnOrName, temperature: ColumnOrName) -> Column:
    """demand / (temperature + 1); NULL where temperature = -1."""
    return safe_div(col(demand), col(temperature) + F.lit(1.0))


def to_percent(c: ColumnOrName) -> Column:
    return col(c) * F.lit(100.0)


def city_key(c: ColumnOrName, normalise_separators: bool = True) -> Column:
    """Lower-case city; optionally '_' -> ' ' so file-stem and column-name cities meet."""
    k = F.lower(F.trim(col(c)))
    return F.regexp_replace(k, "_", " ") if normalise_separators else k


def file_stem(path: ColumnOrName) -> Column:
    """Base name up to its first dot: '/x/san_antonio.json' -> 'san_antonio'."""
    base = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.substring_index(base, ".", 1)


def clamp_max(c: ColumnOrName, cap: float) -> Column:
    return F.least(col(c), F.lit(float(cap)))


def percent_label(c: ColumnOrName) -> Column:
    return F.format_string("%.2f%%", col(c))


def cluster_name(demand_level: ColumnOrName, temp_level: ColumnOrName,
                 period: ColumnOrName) -> Column:
    return F.format_string("%s - %s %s", col(demand_level), col(temp_level), col(period))


def title_label(c: ColumnOrName) -> Column:
    """First letter upper-cased, first '_' replaced by a space ('random_forest' -> 'Random forest')."""
    once = F.regexp_replace(col(c), r"^([^_]*)_", "$1 ")
    return F.concat(F.upper(F.substr(once, F.lit(1), F.lit(1))), F.substr(once, F.lit(2)))


def forecast_error(actual: ColumnOrName, forecast: ColumnOrName) -> Column:
    return col(actual) - col(forecast)


def forecast_error_pct(actual: ColumnOrName, forecast: ColumnOrName) -> Column:
    return safe_div((col(actual) - col(forecast)) * F.lit(100.0), col(actual))
