"""Dashboard transforms: tare, difference, derivative, min/max envelope and automatic down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.errors import EngineError
from pointmill.functions.formula import divide
from pointmill.functions.schema import UNSIGNED, MeasurementSchema
from pointmill.functions.timerange import TimeRange
from pointmill.operators.neighbours import with_previous
from pointmill.operators.windows import window_agg, window_compute

PERIODS = {"sec": 1.0, "min": 60.0, "hour": 3600.0}


def _minus(a: Column, b: Column, kind: str) -> Column:
    """a - b; of unsigned kinds modulo their size."""
    if kind in UNSIGNED:
        wide = "int" if kind == "bool" else "decimal(38,0)"
        d = F.pmod(a.cast(wide) - b.cast(wide), F.lit(str(UNSIGNED[kind])).cast("decimal(38,0)" if kind != "bool" else "int"))
        return d.cast("int" if kind == "bool" else "long" if kind == "u32" else "decimal(20,0)")
    return a - b


def _field(df: DataFrame, field: str, *others: Column) -> tuple[DataFrame, str]:
    schema = MeasurementSchema.of(df)
    (name,) = schema.resolve([field])
    return df.select("series", "time_ns", F.col(f"`{name}`").alias("value"), *others), schema.kinds[name]


def tare(df: DataFrame, field: str) -> DataFrame:
    """(series, time_ns, value): the series' first known value taken off; a row per series is joined back."""
    d, kind = _field(df, field)
    zero = d.where(F.col("value").isNotNull()).groupBy("series").agg(F.min_by("value", "time_ns").alias("__zero"))
    return d.join(zero, "series", "left").select("series", "time_ns", _minus(F.col("value"), F.col("__zero"), kind).alias("value"))


def difference(df: DataFrame, field: str) -> DataFrame:
    """Each value less the one before; NULL at the first point and beside a NULL."""
    d, kind = _field(df, field)
    return with_previous(d, ["value"]).select("series", "time_ns", _minus(F.col("value"), F.col("__prev.value"), kind).alias("value"))


def derivative(df: DataFrame, field: str, period: str | float = "sec", order: str | None = None) -> DataFrame:
    """Change per period (sec, min, hour or seconds); an unsigned difference wraps before it is scaled.

    Between points of one time, which the column `order` puts in order, it is infinite, or NaN without a change.
    """
    seconds = PERIODS.get(period, period)
    if not isinstance(seconds, (int, float)):
        raise EngineError("INVALID_ARGUMENT", f"period {period!r}")
    d, kind = _field(df, field, *([F.col(f"`{order}`").alias("__order")] if order else []))
    d = with_previous(d, ["value"], order=("__order",) if order else ())
    dt = (F.col("time_ns") - F.col("__prev.time_ns")).cast("double") / F.lit(1e9)
    dv = _minus(F.col("value"), F.col("__prev.value"), kind).cast("double")
    return d.select("series", "time_ns", divide(F.lit(float(seconds)) * dv, dt).alias("value"))


def envelope(windows: DataFrame) -> DataFrame:
    """(series, time_ns, value) from rows (series, window_ns, min, max, mean, n).

    Two rows a window: max at its start, min 1 ms later. The first window with values has mean, max and
    min at 0, 1 and 2 ms. Empty windows have two NULLs. A series without values has no rows.
    """
    ms = 1_000_000
    first = windows.where("n > 0").groupBy("series").agg(F.min("window_ns").alias("__first"))
    d = windows.join(first, "series")
    row = lambda k, v: F.struct((F.col("window_ns") + k * ms).alias("time_ns"), v.cast("double").alias("value"))
    null = F.lit(None).cast("double")
    two = F.when(F.col("n") == 0, F.array(row(0, null), row(1, null))).otherwise(F.array(row(0, F.col("max")), row(1, F.col("min"))))
    rows = F.when(F.col("window_ns") == F.col("__first"), F.array(row(0, F.col("mean")), row(1, F.col("max")), row(2, F.col("min")))).otherwise(two)
    return d.select("series", F.explode(rows).alias("p")).select("series", "p.time_ns", "p.value")


def downsample(
    df: DataFrame, field: str | None = None, t0=None, t1=None, max_points: int = 1000, window_ns: int = 60 * 10**9,
    zoom: str | None = "Mean", formula: str | None = None,
) -> DataFrame:
    """(series, time_ns, value) of a field or a formula, as a dashboard draws it.

    A series with at most max_points points in range comes as it is. Others come as window means ("Mean",
    NULL where empty) or as an envelope ("Min/Max"); with another zoom they have no rows. Series without
    a point or a value in range have none either. One plan serves all series.
    """
    if (field is None) == (formula is None):
        raise EngineError("INVALID_ARGUMENT", "one of field and formula")
    if formula is not None:
        from pointmill.operators.scan import compute

        points = compute(df, formula)
    else:
        points = _field(df, field)[0].withColumn("value", F.col("value").cast("double"))
    inside = TimeRange.between(t0, t1).apply(points)
    seen = inside.groupBy("series").agg(F.count(F.lit(1)).alias("__n"), F.count("value").alias("__known"))
    raw = inside.join(seen.where((F.col("__n") <= max_points) & (F.col("__known") > 0)).select("series"), "series", "left_semi")
    if zoom not in ("Mean", "Min/Max"):
        return raw
    many = points.join(seen.where((F.col("__n") > max_points) & (F.col("__known") > 0)).select("series"), "series", "left_semi")
    w = window_agg(many, ["value"], t0, t1, window_ns)
    if zoom == "Mean":
        drawn = w.select("series", F.col("window_ns").alias("time_ns"), F.col("value_mean").alias("value"))
        return raw.unionByName(drawn)
    return raw.unionByName(envelope(w.select("series", "window_ns", *[F.col(f"value_{k}").alias(k) for k in ("min", "max", "mean", "n")])))


__all__ = ["derivative", "difference", "downsample", "envelope", "tare", "window_compute"]
