"""The point before each point, without putting a whole series in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets in which neighbours are sought, ns: a day.
BUCKET = 86_400 * 10**9


def with_previous(df: DataFrame, columns: list[str], bucket_ns: int = BUCKET, order: tuple[str, ...] = ()) -> DataFrame:
    """df with __prev, a struct of time_ns and `columns` of the point before in the same series, or NULL.

    Points of one time are in the order of the columns `order`; without these it is left open. Rows are
    sorted within (series, bucket). The last row of each bucket is passed on to the first of the next bucket
    that has any; only these, a row per bucket, are ordered by series.
    """
    keep = F.struct("time_ns", *[F.col(f"`{c}`") for c in columns])
    d = df.withColumn("__b", F.floor(F.col("time_ns") / F.lit(bucket_ns)).cast("long"))
    inner = Window.partitionBy("series", "__b").orderBy("time_ns", *order)
    d = d.withColumn("__in", F.lag(keep).over(inner))
    ends = d.groupBy("series", "__b").agg(F.max_by(keep, F.struct("time_ns", *order)).alias("__last"))
    handed = ends.withColumn("__carry", F.lag("__last").over(Window.partitionBy("series").orderBy("__b"))).select("series", "__b", "__carry")
    return d.join(handed, ["series", "__b"]).withColumn("__prev", F.coalesce("__in", "__carry")).drop("__b", "__in", "__carry")
