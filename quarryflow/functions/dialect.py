"""Functions of other warehouses as Spark columns, for queries moved over by hand or by a front end.

Spark SQL has NVL, NVL2, IFNULL, ZEROIFNULL, DECODE, LISTAGG, TRY_CAST and IF itself; these are the ones it lacks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def iff(condition: Column, then: Column, other: Column) -> Column:
    return F.when(condition, then).otherwise(other)


def isnull2(value: Column, default: Column) -> Column:
    """ISNULL with two arguments."""
    return F.coalesce(value, default)


def to_char(value: Column) -> Column:
    """TO_CHAR with one argument."""
    return value.cast("string")


def safe_cast(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def minus_days(value: Column, days: int, is_date: bool) -> Column:
    """date - n and timestamp - n."""
    return F.date_sub(value, days) if is_date else value - F.expr(f"INTERVAL {int(days)} DAYS")


def day_diff(start: Column, end: Column) -> Column:
    """DATEDIFF('day', start, end) by calendar days."""
    return F.datediff(end.cast("date"), start.cast("date"))


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """DATEDIFF(unit, start, end): how many borders of the unit lie between the two; weeks begin on Monday."""
    unit = unit.lower().rstrip("s")
    months = lambda t: F.year(t) * 12 + F.month(t)
    if unit in ("hour", "minute", "second"):
        seconds = {"hour": 3600, "minute": 60, "second": 1}[unit]
        borders = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (seconds * 1_000_000))
        return borders(end) - borders(start)
    return {
        "year": F.year(end) - F.year(start),
        "quarter": (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start),
        "month": months(end) - months(start),
        "week": (F.datediff(F.trunc(end, "week"), F.trunc(start, "week")) / 7).cast("int"),
        "day": day_diff(start, end),
    }[unit].cast("long")


#: Parts of TO_CHAR's date formats and of Spark's, longest first.
FORMATS = (("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("DDD", "DDD"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("DY", "E"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"))


def to_char_format(value: Column, form: str) -> Column:
    """TO_CHAR(date or timestamp, format)."""
    known = dict(FORMATS)
    parts = re.sub("|".join(a for a, _ in FORMATS), lambda m: known[m[0].upper()], form, flags=re.IGNORECASE)
    return F.date_format(value, parts)


def register(spark: SparkSession) -> None:
    """SQL functions for the names whose types are fixed; they are macros that Catalyst inlines."""
    for name, body in {
        "getdate": "getdate() RETURNS TIMESTAMP RETURN current_timestamp()",
        "sysdate": "sysdate() RETURNS TIMESTAMP RETURN current_timestamp()",
    }.items():
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        spark.sql(f"CREATE TEMPORARY FUNCTION {body}")
