"""An append-only store of measurements on Parquet, with validated appends and front deletion.

Layout below the root: databases/<db>/<measurement>/ holds schema.json, manifest-<n>.json and data
folders. A manifest names the folders that are live: `base`, sorted by time, `tail`, recent small appends,
`deletes`, watermarks, and `state`, a row per series with its newest time stamp, from which appends are
checked without a look at stored points. The newest manifest is the state of the measurement; giving its
file, already written, its name, which fails if the name is taken, is the commit. A frame read from a
manifest is a snapshot. One writer per measurement is assumed; a second one fails at the commit instead of
overwriting. A tail that has grown is committed to the base by the append that finds it so.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.errors import EngineError
from pointmill.functions.schema import RANGES, MeasurementSchema, check_component

VERSION = "1"
#: Bytes of state files up to which rows per series are broadcast.
BROADCAST = 8 * 2**20
_SUFFIX = {"": 1, "K": 2**10, "M": 2**20, "G": 2**30, "T": 2**40}


@dataclass(frozen=True)
class StoreOptions:
    """chunk_size in bytes of 8-byte time stamps (a power of two, 128 or more) sets rows per file;
    wal_max_entries is the largest append that goes to the tail, and how many points or, a sixteenth of it,
    folders the tail holds before it is committed; write_throttle_ns spaces stream triggers; ties lets a
    batch without an order hold several points of a series at one time, as events do: all are kept."""

    chunk_size: int = 2 * 2**20
    wal_max_entries: int = 128
    write_throttle_ns: int = 0
    compression: str = "zstd"
    ties: bool = False

    def __post_init__(self):
        if self.chunk_size < 128 or self.chunk_size & (self.chunk_size - 1):
            raise EngineError("INVALID_CHUNK_SIZE", str(self.chunk_size))

    @classmethod
    def parse(cls, text: str) -> "StoreOptions":
        """From lines `key value`, values with an optional K, M, G or T; # begins a comment."""
        found = {}
        for line in text.splitlines():
            if not (line := line.split("#")[0].strip()):
                continue
            m = re.fullmatch(r"(chunk_size|wal_max_entries|write_throttle_ns)\s*[=\s]\s*(\d+)([KMGT]?)", line)
            if not m:
                raise EngineError("INVALID_CONFIG_FILE", line)
            found[m[1]] = int(m[2]) * _SUFFIX[m[3]]
        return cls(**found)


class Store:
    def __init__(self, spark: SparkSession, root: str, options: StoreOptions | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or StoreOptions()
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _read(self, p: str) -> dict:
        f = self._fs.open(self._path(p))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def _create(self, p: str, what: dict, error: str) -> None:
        """A file that is there whole or not at all: written under another name, then renamed, which fails if p exists."""
        hadoop, written = self._jvm.org.apache.hadoop.fs, self._path(f"{p}.{uuid.uuid4().hex}.new")
        f = self._fs.create(written, False)
        try:
            f.write(bytearray(json.dumps(what).encode()))
        finally:
            f.close()
        files = hadoop.FileContext.getFileContext(written.toUri() if "://" in p else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(written), self._fs.makeQualified(self._path(p)), self.spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(written, False)
            raise EngineError(error, p) from e

    def _names(self, p: str) -> list[str]:
        if not self._fs.exists(self._path(p)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(p)))

    # catalogue

    def create_database(self, db: str) -> None:
        check_component(db, "CREATE_DATABASE_ERROR")
        self._fs.mkdirs(self._path(f"{self.root}/databases/{db}"))

    def list_databases(self) -> list[str]:
        return self._names(f"{self.root}/databases")

    def database_exists(self, db: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/databases/{db}"))

    def create_measurement(self, db: str, measurement: str, schema: str | MeasurementSchema) -> MeasurementSchema:
        """Same fields again: nothing happens. Others: MEASUREMENT_EXISTS."""
        self._need_database(db)
        check_component(measurement, "INVALID_MEASUREMENT")
        schema = MeasurementSchema.parse(schema) if isinstance(schema, str) else schema
        p = self._measurement(db, measurement)
        if self._fs.exists(self._path(f"{p}/schema.json")):
            if self.schema(db, measurement) != schema:
                raise EngineError("MEASUREMENT_EXISTS", f"{db}/{measurement}")
            return schema
        self._create(f"{p}/schema.json", {"fields": schema.fields}, "CREATE_MEASUREMENT_ERROR")
        return schema

    def list_measurements(self, db: str) -> list[str]:
        self._need_database(db)
        return self._names(f"{self.root}/databases/{db}")

    def schema(self, db: str, measurement: str) -> MeasurementSchema:
        self._need_database(db)
        p = f"{self._measurement(db, measurement)}/schema.json"
        if not self._fs.exists(self._path(p)):
            raise EngineError("NO_SUCH_MEASUREMENT", f"{db}/{measurement}")
        return MeasurementSchema(tuple((n, k) for n, k in self._read(p)["fields"]))

    def _need_database(self, db: str) -> None:
        if not self.database_exists(db):
            raise EngineError("NO_SUCH_DATABASE", db)

    def _measurement(self, db: str, measurement: str) -> str:
        return f"{self.root}/databases/{db}/{measurement}"

    # manifests

    def _manifest(self, db: str, measurement: str) -> tuple[int, dict]:
        p = self._measurement(db, measurement)
        numbers = [int(m[1]) for x in self._names(p) if (m := re.fullmatch(r"manifest-(\d+)\.json", x))]
        if not numbers:
            return 0, {"base": [], "tail": [], "deletes": [], "state": []}
        return max(numbers), self._read(f"{p}/manifest-{max(numbers)}.json")

    def _commit(self, db: str, measurement: str, after: int, manifest: dict) -> None:
        p = self._measurement(db, measurement)
        self._create(f"{p}/manifest-{after + 1}.json", manifest, "INVALID_MEASUREMENT")
        if after > 8:
            self._fs.delete(self._path(f"{p}/manifest-{after - 8}.json"), False)

    # reading

    def _load(self, db: str, measurement: str, manifest: dict, tiers: tuple[str, ...] = ("base", "tail")) -> DataFrame:
        schema, p = self.schema(db, measurement), self._measurement(db, measurement)
        folders = [f"{p}/{x}" for tier in tiers for x in manifest[tier]]
        # one scan over all folders: their names are partition values, like the series below them
        out = self.spark.read.schema(schema.struct()).option("basePath", p).parquet(*folders) if folders else self.spark.createDataFrame([], schema.struct())
        # names of the seven kinds are lost in files; put them back
        return out.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f.name) for f in schema.struct()])

    def _state(self, db: str, measurement: str, manifest: dict) -> DataFrame:
        """(series, newest): every series ever written, with its newest time stamp, deleted or not."""
        if not manifest["state"]:
            return self.spark.createDataFrame([], "series string, newest long")
        p = self._measurement(db, measurement)
        return self.spark.read.schema("series string, newest long").parquet(*[f"{p}/{x}" for x in manifest["state"]])

    def series(self, db: str, measurement: str) -> DataFrame:
        """Names of all series, those too whose points are all deleted, without a look at points."""
        self.schema(db, measurement)
        return self._state(db, measurement, self._manifest(db, measurement)[1]).select("series")

    def need_series(self, db: str, measurement: str, series: str) -> None:
        if self.series(db, measurement).where(F.col("series") == series).isEmpty():
            raise EngineError("NO_SUCH_SERIES", f"{db}/{measurement}/{series}")

    def count(self, db: str, measurement: str, tiers: tuple[str, ...] = ("base", "tail")) -> DataFrame:
        """(series, npoints): live points in the tiers named: `base` is what is committed, `tail` what isn't yet."""
        return self.points(db, measurement, tiers).groupBy("series").agg(F.count(F.lit(1)).alias("npoints"))

    def watermarks(self, db: str, measurement: str, manifest: dict | None = None) -> DataFrame:
        """(series, time_first): live points are not older."""
        manifest = manifest or self._manifest(db, measurement)[1]
        p = self._measurement(db, measurement)
        if not manifest["deletes"]:
            return self.spark.createDataFrame([], "series string, time_first long")
        d = self.spark.read.schema("series string, time_first long").parquet(*[f"{p}/{x}" for x in manifest["deletes"]])
        return d.groupBy("series").agg(F.max("time_first").alias("time_first"))

    def points(self, db: str, measurement: str, tiers: tuple[str, ...] = ("base", "tail")) -> DataFrame:
        """Live points: base and tail, less what was deleted. A snapshot of the newest manifest."""
        return self._live(db, measurement, self._manifest(db, measurement)[1], tiers)

    def _live(self, db: str, measurement: str, manifest: dict, tiers=("base", "tail")) -> DataFrame:
        d = self._load(db, measurement, manifest, tiers)
        if not manifest["deletes"]:
            return d
        w = self.watermarks(db, measurement, manifest).withColumnRenamed("series", "__s")
        return d.join(w, d.series == w["__s"], "left").where("time_first is null or time_ns >= time_first").select(*d.columns)

    # writing

    def append(self, db: str, measurement: str, points: DataFrame, order: str | None = None) -> int:
        """Append a batch of points of any number of series; returns how many were new.

        Points below their series' watermark are dropped. Points not after the series' newest stored one
        must repeat stored points exactly, all that lie between the first and last of them, and are then
        dropped; else the whole batch is refused. `order` names a column that numbers the points as
        sent: time must rise with it. Without it, only repeated time stamps are out of order, and in a
        store with ties not even these: points of one time are repeated together, each as often as it is
        stored, and only at the series' newest time may a batch bring more of them, which are new.
        """
        schema = self.schema(db, measurement)
        n, manifest = self._manifest(db, measurement)
        missing = [f.name for f in schema.struct() if f.name not in points.columns]
        if missing:
            raise EngineError("NO_SUCH_FIELD", ", ".join(missing))
        batch = points.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.struct()], *([F.col(order).alias("__order")] if order else []))
        # the batch is read several times; once it is written, all readers see the same rows
        hold = f"{self._measurement(db, measurement)}/held-{uuid.uuid4().hex}"
        batch.write.parquet(hold)
        try:
            return self._append(db, measurement, schema, n, manifest, self.spark.read.schema(batch.schema).parquet(hold), bool(order))
        finally:
            self._fs.delete(self._path(hold), True)

    def _append(self, db, measurement, schema, n, manifest, batch, ordered) -> int:
        bad = F.col("series").isNull() | F.col("time_ns").isNull() | (F.col("time_ns") < 0) | (F.length("series") == 0) | F.col("series").rlike(r"[\s/\\]")
        wide = F.lit(False)
        for f, k in schema.fields:
            if k in RANGES:
                wide = wide | F.coalesce((F.col(f"`{f}`") < 0) | (F.col(f"`{f}`") > F.lit(str(RANGES[k][1])).cast("decimal(20,0)")), F.lit(False))
        seen = batch.agg(F.count(F.lit(1)), F.max(bad.cast("int")), F.max(wide.cast("int"))).first()
        if not seen[0]:
            return 0
        if seen[1]:
            raise EngineError("INVALID_SERIES")
        if seen[2]:
            raise EngineError("INVALID_ARGUMENT", "value out of its type's range")
        ties = self.options.ties and not ordered
        if not ties and not batch.groupBy("series", "time_ns").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise EngineError("OUT_OF_ORDER_TIMESTAMPS")
        if ordered:
            from pyspark.sql import Window

            w = Window.partitionBy("series").orderBy("__order")
            if not batch.select((F.col("time_ns") <= F.lag("time_ns").over(w)).alias("x")).where("x").isEmpty():
                raise EngineError("OUT_OF_ORDER_TIMESTAMPS")
        fresh = batch.drop("__order")
        if manifest["deletes"]:
            w = self.watermarks(db, measurement, manifest).withColumnRenamed("series", "__s")
            fresh = fresh.join(w, fresh.series == w["__s"], "left").where("time_first is null or time_ns >= time_first").drop("__s", "time_first")
        state = self._state(db, measurement, manifest)
        span = fresh.groupBy("series").agg(F.min("time_ns").alias("b0"), F.max("time_ns").alias("b1"))
        span = span.join(state, "series", "left").select("series", "b0", F.least("b1", "newest").alias("b1"), "newest")
        span = span.where("b0 <= newest")  # of others no stored point is met
        low, high = span.agg(F.min("b0"), F.max("b1")).first()
        new = fresh.join(state, "series", "left").where("newest is null or time_ns > newest").drop("newest")
        if low is not None:  # only a batch that goes back before a series' newest point has stored ones to compare
            stored = self._live(db, measurement, manifest).where(F.col("time_ns").between(low, high))
            # rows per series; Spark can't tell that they are few, and would put all points of a series in one task
            self._compare(schema, fresh, F.broadcast(span) if self._few_series(db, measurement, manifest) else span, stored, ties)
            if ties:
                at_newest = lambda d: d.join(state, "series").where("time_ns = newest").select(*fresh.columns)
                new = new.unionByName(at_newest(fresh).exceptAll(at_newest(stored)))
        count = new.count()
        if not count:
            return 0
        tier = "base" if count > self.options.wal_max_entries else "tail"
        folder, marks, p = f"folder={tier}-{uuid.uuid4().hex}", f"state-{uuid.uuid4().hex}", self._measurement(db, measurement)
        self._write(new, f"{p}/{folder}")
        ends = state.unionByName(new.groupBy("series").agg(F.max("time_ns").alias("newest")))
        ends.groupBy("series").agg(F.max("newest").alias("newest")).coalesce(1).write.parquet(f"{p}/{marks}")
        now = manifest | {tier: manifest[tier] + [folder], "state": [marks]}
        self._commit(db, measurement, n, now)
        if tier == "tail":
            self._commit_full_tail(db, measurement, n + 1, now)
        return count

    def _commit_full_tail(self, db: str, measurement: str, n: int, manifest: dict) -> None:
        """Move the tail to the base when it holds more than it should; the base is not read."""
        most = self.options.wal_max_entries
        tail = self._live(db, measurement, manifest, ("tail",))
        if len(manifest["tail"]) > max(1, most // 16) or tail.count() > most:
            folder = f"folder=base-{uuid.uuid4().hex}"
            self._write(tail, f"{self._measurement(db, measurement)}/{folder}")
            self._commit(db, measurement, n, manifest | {"base": manifest["base"] + [folder], "tail": []})

    def _few_series(self, db: str, measurement: str, manifest: dict) -> bool:
        """Whether the state is small enough to be broadcast, by the size of its files."""
        p = self._measurement(db, measurement)
        return sum(self._fs.getContentSummary(self._path(f"{p}/{x}")).getLength() for x in manifest["state"]) <= BROADCAST

    def _compare(self, schema, fresh: DataFrame, span: DataFrame, stored: DataFrame, ties: bool) -> None:
        """Raise unless the points of the batch up to each series' newest one are all those stored in their range,
        and with ties as many, or more at the newest time."""
        names = [f for f, _ in schema.fields]
        both = fresh.join(span, "series").where("time_ns <= newest")
        stored = stored.join(span, "series").where("time_ns between b0 and b1")
        key = ["series", "time_ns"]
        fields = [F.col(f"`{f}`").alias(f"v_{f}") for f in names]
        end = (F.col("time_ns") == F.col("newest")).alias("__end")
        x = both.select(*key, end, *fields, F.lit(1).alias("__x"), F.lit(0).alias("__y"))
        y = stored.select(*key, end, *fields, F.lit(0).alias("__x"), F.lit(1).alias("__y"))
        # equal points are counted, then those of equal masks, then those of equal times, in one exchange
        off = (F.col("__y") > F.col("__x")) | (F.col("__x") > F.col("__y")) & ~(F.lit(ties) & F.col("__end"))
        counts = [F.sum("__x").alias("__x"), F.sum("__y").alias("__y")]
        mask = F.concat(*[F.col(f"`v_{f}`").isNull().cast("int").cast("string") for f in names]).alias("__mask")
        met = x.unionByName(y).repartition(*key).groupBy(*key, "__end", *[f"`v_{f}`" for f in names]).agg(*counts)
        met = met.select(*key, "__end", mask, "__x", "__y", F.when(off, 1).alias("__off"))
        met = met.groupBy(*key, "__end", "__mask").agg(*counts, F.max("__off").alias("__off"))
        met = met.withColumn("__off", F.when(off, 2).otherwise(F.col("__off")))
        met = met.groupBy(*key, "__end").agg(*counts, F.max("__off").alias("__off"))
        worst = met.agg(F.max(F.when(off, 3).otherwise(F.col("__off")))).first()[0]
        if worst:
            raise EngineError({3: "TIMESTAMP_OVERWRITE_MISMATCH", 2: "BITMAP_OVERWRITE_MISMATCH", 1: "FIELD_OVERWRITE_MISMATCH"}[worst])

    def _write(self, df: DataFrame, path: str) -> None:
        """A folder per series, sorted by time in each file, so that row groups have narrow time bounds."""
        rows = max(1, self.options.chunk_size // 8)
        slot = F.floor(F.col("time_ns") / F.lit(7 * 86_400 * 10**9))
        dealt = df.repartition("series", slot).sortWithinPartitions("series", "time_ns")
        dealt.write.option("maxRecordsPerFile", rows).option("compression", self.options.compression).partitionBy("series").parquet(path)

    def delete_until(self, db: str, measurement: str, series: str, t: int) -> None:
        """Delete points of a series with time_ns <= t, for good: later writes below are dropped too."""
        self.delete_all_until(db, measurement, self.spark.createDataFrame([(series, t)], "series string, t long"))

    def delete_all_until(self, db: str, measurement: str, ends: DataFrame) -> None:
        """delete_until for the rows (series, t) of a frame, in one commit."""
        self.schema(db, measurement)
        n, manifest = self._manifest(db, measurement)
        ends = ends.groupBy("series").agg(F.max("t").alias("t"))
        marks = self.watermarks(db, measurement, manifest).withColumnRenamed("time_first", "before")
        ends = ends.join(marks, "series", "left").where("before is null or before < t + 1")
        after = self._live(db, measurement, manifest).select("series", "time_ns").join(ends.select("series", "t"), "series").where("time_ns > t")
        after = after.groupBy("series").agg(F.min("time_ns").alias("after"))
        first = ends.join(after, "series", "left").select("series", F.greatest(F.coalesce("after", F.col("t") + 1), F.coalesce("before", F.lit(0).cast("long"))).alias("time_first"))
        folder = f"deletes-{uuid.uuid4().hex}"
        path = f"{self._measurement(db, measurement)}/{folder}"
        first.coalesce(1).write.parquet(path)
        if self.spark.read.schema("series string, time_first long").parquet(path).isEmpty():
            self._fs.delete(self._path(path), True)
            return
        self._commit(db, measurement, n, manifest | {"deletes": manifest["deletes"] + [folder]})

    def compact(self, db: str, measurement: str) -> None:
        """Rewrite all live points as one sorted base and drop what was deleted; readers keep their files
        until vacuum()."""
        n, manifest = self._manifest(db, measurement)
        folder, marks = f"folder=base-{uuid.uuid4().hex}", f"deletes-{uuid.uuid4().hex}"
        p = self._measurement(db, measurement)
        self._write(self._live(db, measurement, manifest), f"{p}/{folder}")
        if manifest["deletes"]:
            self.watermarks(db, measurement, manifest).coalesce(1).write.parquet(f"{p}/{marks}")
        self._commit(db, measurement, n, {"base": [folder], "tail": [], "deletes": [marks] if manifest["deletes"] else [], "state": manifest["state"]})

    def vacuum(self, db: str, measurement: str) -> None:
        """Delete data folders that the newest manifest doesn't name."""
        _, manifest = self._manifest(db, measurement)
        named = {x for v in manifest.values() for x in v}
        p = self._measurement(db, measurement)
        for x in self._names(p):
            if re.match(r"(folder=|deletes-|held-|state-)|.*\.new$", x) and x not in named:
                self._fs.delete(self._path(f"{p}/{x}"), True)
