"""A client with one method per request: the store's points of one series, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.errors import EngineError
from pointmill.functions.schema import MeasurementSchema
from pointmill.operators import integral, scan, windows
from pointmill.sources.store import VERSION, Store, StoreOptions


class Client:
    def __init__(self, spark: SparkSession, root: str, options: StoreOptions | None = None):
        self.spark, self.store = spark, Store(spark, root, options)

    # catalogue

    def create_database(self, db: str) -> None:
        self.store.create_database(db)

    def create_measurement(self, db: str, measurement: str, schema: str | MeasurementSchema) -> None:
        self.store.create_measurement(db, measurement, schema)

    def list_databases(self) -> list[str]:
        return self.store.list_databases()

    def list_measurements(self, db: str) -> list[str]:
        return self.store.list_measurements(db)

    def get_schema(self, db: str, measurement: str) -> DataFrame:
        """(position, name, type)"""
        rows = [(i, n, k) for i, (n, k) in enumerate(self.store.schema(db, measurement).fields)]
        return self.spark.createDataFrame(rows, "position int, name string, type string")

    def list_series(self, db: str, measurement: str) -> DataFrame:
        return self.store.series(db, measurement).orderBy("series")

    def list_active_series(self, db: str, measurement: str, t0=None, t1=None) -> DataFrame:
        return scan.active_series(self.store.points(db, measurement), t0, t1)

    def get_version_info(self) -> str:
        return VERSION

    def nop(self) -> None:
        """Does nothing, successfully."""

    # points

    def _series(self, db: str, measurement: str, series: str) -> DataFrame:
        self.store.need_series(db, measurement, series)
        return self.store.points(db, measurement).where(F.col("series") == series)

    def write_points(self, db: str, measurement: str, series: str, points: list[dict] | DataFrame) -> int:
        """Dicts with time_ns and every field (others are ignored; a missing one is a KeyError), in the
        order sent, or a frame."""
        schema = self.store.schema(db, measurement)
        if isinstance(points, DataFrame):
            return self.store.append(db, measurement, points.withColumn("series", F.lit(series)))
        rows = [(series, p["time_ns"], *[p[n] for n, _ in schema.fields], i) for i, p in enumerate(points)]
        if not rows:
            return 0
        struct = schema.struct().add("__sent", "long")
        kinds = [k for _, k in schema.fields]
        fit = {"u64": lambda v: __import__("decimal").Decimal(v), "f32": float, "f64": float, "bool": bool}
        rows = [(*r[:2], *[v if v is None else fit.get(k, int)(v) for v, k in zip(r[2:-1], kinds)], r[-1]) for r in rows]
        return self.store.append(db, measurement, self.spark.createDataFrame(rows, struct), order="__sent")

    def delete_points(self, db: str, measurement: str, series: str, t: int) -> None:
        self.store.delete_until(db, measurement, series, t)

    def select_points(self, db, measurement, series, fields=("*",), t0=None, t1=None, n: int | None = None) -> DataFrame:
        return scan.select_series(self._series(db, measurement, series), series, fields, t0, t1, first=n)

    def select_last_points(self, db, measurement, series, fields=("*",), t0=None, t1=None, n: int = 1) -> DataFrame:
        return scan.select_series(self._series(db, measurement, series), series, fields, t0, t1, last=n)

    def compute_points(self, db, measurement, series, formula: str, t0=None, t1=None, n: int | None = None) -> DataFrame:
        return scan.compute(self._series(db, measurement, series), formula, t0, t1, first=n).orderBy("time_ns")

    def compute_last_points(self, db, measurement, series, formula: str, t0=None, t1=None, n: int = 1) -> DataFrame:
        return scan.compute(self._series(db, measurement, series), formula, t0, t1, last=n).orderBy("time_ns")

    def count_points(self, db, measurement, series, t0=None, t1=None) -> DataFrame:
        one = self.spark.createDataFrame([(series,)], "series string")
        return scan.count_points(self._series(db, measurement, series), t0, t1, one)

    def count_committed_points(self, db: str, measurement: str) -> DataFrame:
        """(series, npoints) in the base alone."""
        return self.store.count(db, measurement, ("base",))

    def count_tail_points(self, db: str, measurement: str) -> DataFrame:
        """(series, npoints) that are not committed to the base yet."""
        return self.store.count(db, measurement, ("tail",))

    def sum_points(self, db, measurement, series, fields=("*",), t0=None, t1=None, window_ns: int = 10**9) -> DataFrame:
        return windows.window_agg(self._series(db, measurement, series), fields, t0, t1, window_ns).orderBy("window_ns")

    def sum_compute_points(self, db, measurement, series, formula: str, t0=None, t1=None, window_ns: int = 10**9) -> DataFrame:
        return windows.window_compute(self._series(db, measurement, series), formula, t0, t1, window_ns).orderBy("window_ns")

    def integrate_points(self, db, measurement, series, fields=("*",), t0=None, t1=None) -> DataFrame:
        return integral.integrate(self._series(db, measurement, series), fields, t0, t1)

    def get_all_points_mean(self, db, measurement, fields=("*",), t0=None, t1=None, window_ns: int = 10**9, series: str | None = None) -> DataFrame:
        """Window means of all series, or of one, in one plan."""
        names = self.store.schema(db, measurement).resolve(fields)
        points = self.store.points(db, measurement) if series is None else self._series(db, measurement, series)
        w = windows.window_agg(points, fields, t0, t1, window_ns)
        return w.select("series", "window_ns", *[F.col(f"`{n}_mean`") for n in names])


def dashboard(points: DataFrame, series: str = "All", field: str | None = None, formula: str | None = None, alias: str | None = None, transform: str | None = None, t0=None, t1=None, **options) -> DataFrame:
    """(name, time_ns, value) for a panel: series is "All" (those active in range) or names joined by " + ".

    name is series.field, or alias with its first $series replaced. transform: Tare, Difference,
    Derivative/sec, Derivative/min or Derivative/hour, applied to what is drawn.
    """
    from pointmill.operators import transforms

    if series != "All":
        points = points.where(F.col("series").isin([s.strip() for s in series.split(" + ")]))
    d = transforms.downsample(points, field, t0, t1, formula=formula, **options)
    if transform:
        steps = {"Tare": transforms.tare, "Difference": transforms.difference} | {f"Derivative/{p}": lambda x, f, p=p: transforms.derivative(x, f, p) for p in transforms.PERIODS}
        if transform not in steps:
            raise EngineError("INVALID_ARGUMENT", transform)
        d = steps[transform](d, "value")
    if alias and "$series" in alias:
        head, tail = alias.split("$series", 1)
        name = F.concat(F.lit(head), F.col("series"), F.lit(tail))
    else:
        name = F.lit(alias) if alias else F.concat_ws(".", F.col("series"), F.lit(field or ""))
    return d.select(name.alias("name"), "time_ns", "value")
