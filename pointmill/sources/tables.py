"""Canonical frames (series, time_ns, fields...) from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.timerange import nanoseconds


def from_timestamps(df: DataFrame, series: str, ts: str, fields: list[str], t0=None, t1=None) -> DataFrame:
    """Points of a table whose time is a timestamp column.

    Bounds are also put on the timestamp itself, rounded outwards to microseconds: a predicate on the
    computed time_ns alone would not reach the scan.
    """
    t0, t1 = nanoseconds(t0), nanoseconds(t1)
    kind = dict(df.dtypes)[ts]
    bound = lambda us: F.timestamp_micros(F.lit(us)).cast(kind)
    if t0 is not None:
        df = df.where(F.col(ts) >= bound(t0 // 1000))
    if t1 is not None:
        df = df.where(F.col(ts) <= bound(-(-t1 // 1000)))
    ns = F.unix_micros(F.col(ts).cast("timestamp")) * F.lit(1000).cast("long")
    out = df.where(F.col(ts).isNotNull()).select(F.col(series).cast("string").alias("series"), ns.alias("time_ns"), *fields)
    if t0 is not None:
        out = out.where(F.col("time_ns") >= F.lit(t0).cast("long"))
    return out if t1 is None else out.where(F.col("time_ns") <= F.lit(t1).cast("long"))


def events(spark: SparkSession, sf_dir: str, t0=None, t1=None, fields: tuple[str, ...] = ("value",)) -> DataFrame:
    """The events table: a series per event type, with field `value`."""
    return from_timestamps(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", list(fields), t0, t1)
