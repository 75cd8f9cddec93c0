"""Trapezoidal integrals and time-weighted averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.schema import MeasurementSchema
from pointmill.functions.timerange import TimeRange
from pointmill.operators.neighbours import BUCKET


def integrate(df: DataFrame, fields=("*",), t0=None, t1=None) -> DataFrame:
    """(series, t0_ns, t1_ns, <f>_integral, <f>_average ...): value times seconds over [t0, t1].

    t0_ns and t1_ns are the first and last point in range. A NULL in range makes the field's result NULL.
    One point integrates to its own value and has no average. A series without points has no row.
    """
    schema = MeasurementSchema.of(df)
    names = schema.resolve(fields)
    number = lambda n: (F.col(f"`{n}`").cast("int") if schema.kinds[n] == "bool" else F.col(f"`{n}`")).cast("double").alias(n)
    d = TimeRange.between(t0, t1).apply(df).select("series", "time_ns", *[number(n) for n in names])
    keep = F.struct("time_ns", *[F.col(f"`{n}`") for n in names])
    d = d.withColumn("__b", F.floor(F.col("time_ns") / F.lit(BUCKET)).cast("long"))
    d = d.withColumn("__prev", F.lag(keep).over(Window.partitionBy("series", "__b").orderBy("time_ns")))
    area = lambda p, q, n: (p[n] + q[n]) * (q["time_ns"] - p["time_ns"]).cast("double") / F.lit(2e9)
    # a row per bucket, whose points are together already: its own area, its ends, and what is known in it
    days = d.groupBy("series", "__b").agg(
        F.min_by(keep, "time_ns").alias("__first"), F.max_by(keep, "time_ns").alias("__last"), F.count(F.lit(1)).alias("__k"),
        *[F.sum(area(F.col("__prev"), keep, n)).alias(f"__i_{n}") for n in names], *[F.count(F.col(f"`{n}`")).alias(f"__c_{n}") for n in names],
    )
    days = days.withColumn("__prev", F.lag("__last").over(Window.partitionBy("series").orderBy("__b")))
    aggregates = [F.min("__first.time_ns").alias("t0_ns"), F.max("__last.time_ns").alias("t1_ns"), F.sum("__k").alias("__n")]
    for n in names:
        total = F.coalesce(F.col(f"`__i_{n}`"), F.lit(0.0)) + F.coalesce(area(F.col("__prev"), F.col("__first"), n), F.lit(0.0))
        aggregates += [F.sum(total).alias(f"__i_{n}"), F.sum(F.col(f"`__c_{n}`")).alias(f"__c_{n}"), F.first(F.col("__first")[n], ignorenulls=True).alias(f"__f_{n}")]
    d = days.groupBy("series").agg(*aggregates)
    out = ["series", "t0_ns", "t1_ns"]
    length = (F.col("t1_ns") - F.col("t0_ns")).cast("double") / F.lit(1e9)
    for n in names:
        i = F.when(F.col(f"`__c_{n}`") < F.col("__n"), F.lit(None)).when(F.col("__n") == 1, F.col(f"`__f_{n}`")).otherwise(F.col(f"`__i_{n}`"))
        out += [i.alias(f"{n}_integral"), F.when(F.col("__n") > 1, i / F.when(length > 0, length)).alias(f"{n}_average")]
    return d.select(*out)
