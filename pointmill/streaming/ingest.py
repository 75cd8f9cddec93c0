"""Streaming ingestion, store-and-forward, and a buffered sink for producers."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointmill.errors import EngineError
from pointmill.sources.store import Store


def ingest(stream: DataFrame, store: Store, db: str, measurement: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append each micro-batch, validated. Late or conflicting points fail the query rather than vanish,
    so there is no watermark; a batch that runs again after a restart repeats stored points and adds none."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: store.append(db, measurement, batch)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif store.options.write_throttle_ns:
        writer = writer.trigger(processingTime=f"{max(1, store.options.write_throttle_ns // 10**6)} milliseconds")
    return writer.start()


class Reflector:
    """Store and forward: points go to `remote`; while that fails they are kept in `local` and sent later.

    databases maps local database names to remote ones. What was sent is deleted from the local store.
    """

    def __init__(self, local: Store, remote: Store, databases: dict[str, str] | None = None):
        self.local, self.remote, self.databases = local, remote, databases or {}
        self._one = threading.RLock()

    def _remote(self, db: str) -> str:
        return self.databases.get(db, db)

    def write(self, db: str, measurement: str, points: DataFrame) -> bool:
        """True if the points reached the remote store. A refused batch is an error, not a failure to send."""
        with self._one:
            return self._write(db, measurement, points)

    def _write(self, db: str, measurement: str, points: DataFrame) -> bool:
        if self.pending(db, measurement):
            self.local.append(db, measurement, points)
            return False
        try:
            self.remote.append(self._remote(db), measurement, points)
            return True
        except EngineError as e:
            if e.name not in ("NO_SUCH_DATABASE", "NO_SUCH_MEASUREMENT"):
                raise
        except OSError:
            pass
        except Exception as e:
            if "java.io" not in str(e) and "java.net" not in str(e):
                raise
        self.local.append(db, measurement, points)
        return False

    def pending(self, db: str, measurement: str) -> bool:
        return not self.local.points(db, measurement).isEmpty()

    def flush(self, db: str, measurement: str) -> int:
        """Send what is kept; then delete it locally, up to each series' last point sent, in one commit."""
        held = self.local.points(db, measurement)
        if held.isEmpty():
            return 0
        sent = self.remote.append(self._remote(db), measurement, held)
        self.local.delete_all_until(db, measurement, held.groupBy("series").agg(F.max("time_ns").alias("t")))
        return sent

    def every(self, db: str, measurement: str, seconds: float = 10.0) -> Callable[[], None]:
        """Flush each so many seconds, also while nothing comes in; returns what ends that. One flush and one write at a time."""
        done = threading.Event()

        def loop() -> None:
            while not done.wait(seconds):
                with self._one:
                    try:
                        self.flush(db, measurement)
                    except Exception as e:  # the remote store can't be reached now; what is kept stays, and is sent later
                        logging.getLogger(__name__).warning("flush: %s", e)

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        return lambda: (done.set(), thread.join())[0]

    def run(self, stream: DataFrame, db: str, measurement: str, checkpoint: str, **trigger) -> StreamingQuery:
        def step(batch: DataFrame, _: int) -> None:
            self.write(db, measurement, batch)
            if self.pending(db, measurement):
                try:
                    with self._one:
                        self.flush(db, measurement)
                except EngineError as e:
                    if e.name not in ("NO_SUCH_DATABASE", "NO_SUCH_MEASUREMENT"):
                        raise

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


class PushQueue:
    """Points of one series, collected and sent in order; what could not be sent is tried again."""

    def __init__(self, send: Callable[[list[dict]], object], most: int = 1000, retry_s: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.send, self.most, self.retry_s, self.clock = send, most, retry_s, clock
        self.points: list[dict] = []
        self._again = 0.0

    def append(self, point: dict) -> None:
        self.append_list([point])

    def append_list(self, points: list[dict]) -> None:
        self.points.extend(points)
        if len(self.points) >= self.most and self.clock() >= self._again:
            self.flush()

    def flush(self) -> bool:
        """Send all; False, and a pause before append sends again, if that failed. Refused points raise."""
        if not self.points:
            return True
        try:
            self.send(list(self.points))
        except EngineError:
            raise
        except Exception:
            self._again = self.clock() + self.retry_s
            return False
        self.points.clear()
        return True


def windowed_stream(stream: DataFrame, ts: str, field: str, width: str, late: str) -> DataFrame:
    """Extension: running sum, min, max and count per series and tumbling window, final once `late` has passed."""
    v = F.col(field)
    d = stream.withWatermark(ts, late).groupBy("series", F.window(ts, width).alias("w"))
    d = d.agg(F.sum(v.cast("double")).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    return d.select("series", F.col("w.start").alias("start"), "sum", "min", "max", "n")
