"""Range scans, counts and series discovery on frames of shape (series, time_ns, fields...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.errors import EngineError
from pointmill.functions.formula import compile_formula
from pointmill.functions.schema import MeasurementSchema
from pointmill.functions.timerange import TimeRange


def _number(n: int | None) -> int | None:
    if n is not None and n < 0:
        raise EngineError("INVALID_ARGUMENT", f"limit {n}")
    return n


def select_range(df: DataFrame, fields=("*",), t0=None, t1=None) -> DataFrame:
    """All points of every series in [t0, t1]; fields in the order asked for, [] for time stamps only."""
    names = MeasurementSchema.of(df).resolve(fields)
    return TimeRange.between(t0, t1).apply(df).select("series", "time_ns", *[F.col(f"`{n}`") for n in names])


def _nth(df: DataFrame, n: int | None, last: bool) -> DataFrame:
    if _number(n) is None:
        return df
    order = F.col("time_ns").desc() if last else F.col("time_ns").asc()
    # a rank limit runs before the shuffle too, so at most n rows a series and task travel
    w = Window.partitionBy("series").orderBy(order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def select_first(df: DataFrame, fields=("*",), t0=None, t1=None, n: int | None = None) -> DataFrame:
    """The first n points of each series in range. Order the result by series, time_ns to show it."""
    return _nth(select_range(df, fields, t0, t1), n, last=False)


def select_last(df: DataFrame, fields=("*",), t0=None, t1=None, n: int | None = None) -> DataFrame:
    return _nth(select_range(df, fields, t0, t1), n, last=True)


def select_series(df: DataFrame, series: str, fields=("*",), t0=None, t1=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """One series, ascending in time; limits become a distributed top-n."""
    if first is not None and last is not None:
        raise EngineError("INVALID_ARGUMENT", "first and last")
    out = select_range(df.where(F.col("series") == series), fields, t0, t1)
    if _number(last) is not None:
        return out.orderBy(F.col("time_ns").desc()).limit(last).orderBy("time_ns")
    out = out.orderBy("time_ns")
    return out if _number(first) is None else out.limit(first)


def count_points(df: DataFrame, t0=None, t1=None, series: DataFrame | None = None) -> DataFrame:
    """(series, npoints, time_first, time_last): points, whatever their fields hold.

    With `series`, a frame of names, those without points in range come back with 0 and the bounds asked for.
    """
    r = TimeRange.between(t0, t1)
    out = r.apply(df).groupBy("series").agg(F.count(F.lit(1)).alias("npoints"), F.min("time_ns").alias("time_first"), F.max("time_ns").alias("time_last"))
    if series is None:
        return out
    bound = lambda t: F.lit(t).cast("long")
    out = series.select("series").distinct().join(out, "series", "left")
    return out.select("series", F.coalesce("npoints", F.lit(0)).cast("long").alias("npoints"), F.coalesce("time_first", bound(r.t0)).alias("time_first"), F.coalesce("time_last", bound(r.t1)).alias("time_last"))


def list_series(df: DataFrame) -> DataFrame:
    return df.select("series").distinct().orderBy("series")


def active_series(df: DataFrame, t0=None, t1=None) -> DataFrame:
    """Series with a point in [t0, t1], sorted."""
    return TimeRange.between(t0, t1).apply(df).select("series").distinct().orderBy("series")


def compute(df: DataFrame, formula: str, t0=None, t1=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(series, time_ns, value): the formula at every point, NULL where a field it names is NULL."""
    f = compile_formula(formula, MeasurementSchema.of(df))
    out = TimeRange.between(t0, t1).apply(df).select("series", "time_ns", f.value.cast("double").alias("value"))
    return _nth(out, first if last is None else last, last is not None)
