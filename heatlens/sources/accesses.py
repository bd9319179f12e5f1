"""Any table with a key and an order as an access table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Session time zones in which a zoneless timestamp is cast without a shift.
_UTC = ("UTC", "Etc/UTC", "Z", "+00:00")


def as_micros(df: DataFrame, column: str) -> Column:
    """A timestamp column as microseconds since 1970, whatever the session's
    time zone; integer columns pass through."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        if df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC:
            return F.unix_micros(F.col(column).cast("timestamp"))
        day = F.date_diff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        second = (F.extract(F.lit("SECOND"), column) * F.lit(1_000_000)).cast("bigint")
        minutes = (day * 24 + F.hour(column)) * 60 + F.minute(column)
        return minutes * F.lit(60_000_000).cast("bigint") + second
    return F.col(column).cast("bigint")


def accesses_from(
    df: DataFrame, key: str, ts: str | None = None, arrival: str | None = None
) -> DataFrame:
    """``key`` with ``ts`` and ``arrival`` where given. ``arrival`` must be unique.

    A row without a key or without an arrival is no access and is left out here, once,
    before anything is counted. Rows without ``ts`` are left out where the clock is used.
    """
    cols = [F.col(key).alias("key")]
    if ts is not None:
        cols.append(as_micros(df, ts).alias("ts"))
    if arrival is not None:
        cols.append(F.col(arrival).alias("arrival"))
    needed = ["key"] if arrival is None else ["key", "arrival"]
    return df.select(*cols).dropna(subset=needed)
