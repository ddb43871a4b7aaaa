"""Daily time windows in the schedule's local zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEDULE_ZONE = "Asia/Shanghai"  # fixed value: windows are written in this zone


def minute_of_day(clock: Column) -> Column:
    """``HH:MM`` → minutes since midnight."""
    parts = F.split(clock, ":")
    return (parts[0].try_cast("int") * 60 + parts[1].try_cast("int")).cast("int")


def local_time(ts: Column) -> Column:
    """UTC instant → wall clock of the schedule's zone, as zone-free timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(SCHEDULE_ZONE), ts.cast("timestamp_ntz"))


def local_minute(ts: Column) -> Column:
    local = local_time(ts)
    return F.hour(local) * 60 + F.minute(local)
