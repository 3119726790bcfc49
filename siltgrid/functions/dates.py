"""Serial day numbers, calendar dates and yyyymmdd numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Serial of 1970-01-01 with 0001-01-01 as day 1, and with 0000-01-01 as day 1.
ORDINAL_1970, SERIAL_1970 = 719163, 719529


def ordinal(date: Column) -> Column:
    return F.unix_date(date) + ORDINAL_1970


def serial(date: Column) -> Column:
    return F.unix_date(date) + SERIAL_1970


def from_serial(day: Column) -> Column:
    return F.date_from_unix_date((day - SERIAL_1970).cast("int"))


def yyyymmdd(date: Column) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)
