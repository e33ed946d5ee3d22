"""Date functions. Months are those in UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tweet_ts(s: Column) -> Column:
    """Timestamp of ``Thu Jan 01 00:00:00 +0000 2015``; NULL where the text is no such time."""
    return F.try_to_timestamp(F.substring(s, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def month0(s: Column) -> Column:
    """Month counted from 0, the year ignored."""
    return (F.month(F.to_utc_timestamp(tweet_ts(s), F.current_timezone())) - 1).cast("int")


def epoch_ms(s: Column) -> Column:
    return F.unix_millis(tweet_ts(s))
