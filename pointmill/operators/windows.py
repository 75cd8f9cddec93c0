"""Dense tumbling windows, aligned to the epoch: sum, min, max, mean and count of fields or a formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.errors import EngineError
from pointmill.functions.formula import compile_formula
from pointmill.functions.schema import LARGEST, SMALLEST, SPARK_TYPES, MeasurementSchema
from pointmill.functions.timerange import TimeRange

#: Windows of a gap that one array holds at most.
GAP = 1 << 16


def _text(x: float) -> str:
    """Spark's spelling of a bound, to be cast; 64-bit unsigned ones don't fit a literal."""
    return {float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(x, str(x))


def _floor(t: Column, w: int) -> Column:
    return t - F.pmod(t, F.lit(w).cast("long"))


def _dense(df: DataFrame, r: TimeRange, w: int, aggregates: list[Column], zeros: dict[str, object]) -> DataFrame:
    """aggregates per (series, window), with the empty windows between the first and the last that has points.

    The first window is that of t0, rounded up, or that of the series' first live point, if later: a
    leading partial window is dropped. The last one may be partial.
    """
    if not isinstance(w, int) or w <= 0:
        raise EngineError("INVALID_ARGUMENT", f"window of {w} ns")
    up = None if r.t0 is None else -(-r.t0 // w) * w
    inside = TimeRange(up, r.t1).apply(df)
    agg = inside.groupBy("series", _floor(F.col("time_ns"), w).alias("window_ns")).agg(*aggregates)
    if up is not None:
        # a series that lives before t0 starts at t0's window, even if that is empty: a mark stands before it
        older = df.where(F.col("time_ns") < F.lit(up).cast("long")).select("series").distinct()
        agg = agg.unionByName(older.withColumn("window_ns", F.lit(up - w).cast("long")), allowMissingColumns=True)
    agg = agg.withColumn("__before", F.lag("window_ns").over(Window.partitionBy("series").orderBy("window_ns")))
    values = [c for c in agg.columns if c not in ("series", "window_ns", "__before")]
    # each window with points brings the empty ones between it and the one before
    d = agg.where("__points is not null").withColumnRenamed("window_ns", "__own")
    d = _filled(d, F.coalesce(F.col("__before") + w, "__own"), F.col("__own"), w, "__own", *values)
    own = F.col("__own") == F.col("window_ns")
    return d.select("series", "window_ns", *[F.when(own, F.col(f"`{c}`")).alias(c) for c in values]).fillna(zeros)


def _filled(df: DataFrame, start: Column, stop: Column, w: int, *others: str) -> DataFrame:
    """A row per window from start to stop, made in two steps, so that no array holds a very long gap."""
    wide = w * max(1, min(GAP, (1 << 60) // w))
    d = df.select("series", *[F.col(f"`{c}`") for c in others], stop.alias("__stop"), F.explode(F.sequence(start, stop, F.lit(wide).cast("long"))).alias("__start"))
    end = F.when(F.col("__stop") - F.col("__start") >= wide, F.col("__start") + (wide - w)).otherwise(F.col("__stop"))
    return d.select("series", *[F.col(f"`{c}`") for c in others], F.explode(F.sequence("__start", end, F.lit(w).cast("long"))).alias("window_ns"))


def window_agg(df: DataFrame, fields=("*",), t0=None, t1=None, window_ns: int = 10**9, sentinels: bool = False) -> DataFrame:
    """(series, window_ns, <f>_sum, <f>_min, <f>_max, <f>_n, <f>_mean ...), a row per window.

    NULL cells are skipped field by field. A window without values has sum 0.0, n 0 and NULL min, max and
    mean; with `sentinels` its min is the type's largest value and its max the smallest.
    """
    schema = MeasurementSchema.of(df)
    names = schema.resolve(fields)
    aggregates, zeros, out = [F.count(F.lit(1)).alias("__points")], {}, []
    for n in names:
        kind = schema.kinds[n]
        c = F.col(f"`{n}`").cast("int") if kind == "bool" else F.col(f"`{n}`")
        aggregates += [F.sum(c.cast("double")).alias(f"{n}_sum"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.count(c).alias(f"{n}_n")]
        zeros |= {f"{n}_sum": 0.0, f"{n}_n": 0}
        low, high = F.col(f"`{n}_min`"), F.col(f"`{n}_max`")
        if sentinels:
            t = "int" if kind == "bool" else SPARK_TYPES[kind]
            low, high = F.coalesce(low, F.lit(_text(LARGEST[kind])).cast(t)), F.coalesce(high, F.lit(_text(SMALLEST[kind])).cast(t))
        count, total = F.col(f"`{n}_n`"), F.col(f"`{n}_sum`")
        out += [total, low.alias(f"{n}_min"), high.alias(f"{n}_max"), count, F.when(count > 0, total / F.when(count > 0, count)).alias(f"{n}_mean")]
    d = _dense(df.select("series", "time_ns", *[F.col(f"`{n}`") for n in names]), TimeRange.between(t0, t1), window_ns, aggregates, zeros)
    return d.select("series", "window_ns", *out)


def window_compute(df: DataFrame, formula: str, t0=None, t1=None, window_ns: int = 10**9) -> DataFrame:
    """(series, window_ns, sum, min, max, n, mean) of a formula; a point counts if all its fields are known."""
    f = compile_formula(formula, MeasurementSchema.of(df))
    v = df.select("series", "time_ns", f.value.cast("double").alias("value"))
    out = window_agg(v, ["value"], t0, t1, window_ns)
    return out.select("series", "window_ns", *[F.col(f"value_{k}").alias(k) for k in ("sum", "min", "max", "n", "mean")])
