"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What contracts call a word: a run of bytes other than space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])
#: Odd multipliers of two rolling hashes, and the inverses of both modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's path has it."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    # Arrow buffers lie outside the heap; ten thousand whole texts a batch is more than they need to hold
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own, else, on one machine only, a new one."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pointmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Lets Spark drop an execution's shuffle files when it ends; staged tables are read from the shared folder.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold more than one in so many of a table's rows are hot; there are at most as many of them.
HOT = 1000


def join_skewed(big: DataFrame, small: DataFrame, keys: list[str], held: str, how: str = "inner") -> DataFrame:
    """big joined (inner or left_semi) with small, a staged table with one row a key; `held`, dropped, counts big's rows of a key.

    A hot key's rows stay where they are and meet a broadcast of small's hot rows, of which there are
    at most HOT by count; all other keys are joined as Spark sees fit. big is staged, as it is read again."""
    hot = small.where(F.col(held) > F.lit(max(big.count() // HOT, HOT)))
    if hot.isEmpty():
        return big.join(small.drop(held), keys, how)
    cold = small.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot.drop(held)), keys, how).unionByName(rest.join(cold.drop(held), keys, how))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where a count shows that df has at most so many rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_of_id(column: str | Column, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


#: Bytes of a slice that map_arrow aims at.
SLICE_BYTES = 4 << 20


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of few rows and bytes, so that a batch of very long texts stays small in Python."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(512, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield from fn(batch.slice(at, step))

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets when it has grown large."""

    def __init__(self, seed: int = 0, most: int = 250_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; fewer words than k make one run of them all."""
    n = len(h)
    k = min(k, n)
    if not n:
        return h
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j, p in enumerate(powers(BASES[0], k)):
        out += h[j : n - k + 1 + j] * p
    return mix(out + np.uint64(k))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels (id, label) of all ids on edges: label is the smallest id reachable.

    Each round links every node's larger neighbours to its smallest one (large star), then its smaller
    neighbours to the smallest (small star), until edges form stars. Rounds are written to the shared
    folder; nothing is collected but a count.
    """
    e = staged(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    )
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        m = both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("mu"), F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(m, F.col("u") == F.col("mu")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("mh"), "m")
        small = large.join(least, F.col("hi") == F.col("mh"))
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo")))
        last, e = e, staged(small.where("lo <> hi").distinct().select("lo", "hi"))
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = e.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("label")).union(own)
