"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import connected_components, map_arrow, ship, staged


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """tables of keys: each joins a full cross-polytope hash and one over `coarse` rotated coordinates."""

    def __init__(self, tables: int, coarse: int, seed: int = 7):
        self.tables, self.coarse, self.seed = tables, coarse, seed

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best key and first probe of each row in each table: (rows, tables) twice.

        The probe changes the hash whose two largest coordinates are closer to each other."""
        n, d = x.shape
        full = 1 << max(0, int(d - 1).bit_length())
        x = np.pad(x, ((0, 0), (0, full - d)))
        best, probe = np.empty((n, self.tables), np.int64), np.empty((n, self.tables), np.int64)
        for t in range(self.tables):
            rng = np.random.default_rng((self.seed, t, full))
            a = self._closest(self._turn(x, rng))
            b = self._closest(self._turn(x, rng)[:, : self.coarse]) if self.coarse else (np.zeros(n, np.int64),) * 2 + (np.full(n, np.inf),)
            key = lambda p, q: p * 4096 + q
            best[:, t] = key(a[0], b[0])
            probe[:, t] = np.where(a[2] <= b[2], key(a[1], b[0]), key(a[0], b[1]))
        return best, probe

    @staticmethod
    def _turn(x: np.ndarray, rng) -> np.ndarray:
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
        return x

    @staticmethod
    def _closest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the vertices closest and second to each row, and how much closer the first is."""
        rows = np.arange(len(x))
        size = np.abs(x)
        first = size.argmax(1)
        top = size[rows, first]
        code = lambda at: at * 2 + (x[rows, at] < 0)
        if x.shape[1] == 1:
            return code(first), code(first) ^ 1, 2 * top
        size[rows, first] = -1
        second = size.argmax(1)
        return code(first), code(second), top - size[rows, second]


def usable(column: str):
    """Vectors that link: no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False))


def _compare(t: pa.Table, threshold: float) -> pa.Table:
    """Links of one part of a bucket, counted per vector, and edges that connect them.

    A pair counts where it first meets: in no earlier table do their keys meet, and of two buckets of one
    table the smaller is taken."""
    table, bucket, one, two = (t.column(c)[0].as_py() for c in ("t", "bucket", "one", "two"))
    ids, block, role = t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("role").to_numpy()
    m = t.column("many").to_numpy()
    wide = lambda c: np.array(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
    x, best, probe = wide("v").astype(float), wide("best"), wide("probe")
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    left = np.flatnonzero(block == one)
    right = np.flatnonzero(block == two)
    cos = x[left] @ x[right].T
    i, j = np.nonzero(cos >= threshold)
    i, j = left[i], right[j]
    if one == two:
        i, j = i[i < j], j[i < j]
    keep = (role[i] == 0) | (role[j] == 0)
    bi, bj, pi, pj = best[i], best[j], probe[i], probe[j]
    met = (bi == bj) | (bi == pj) | (pi == bj)
    keep &= ~met[:, :table].any(1)
    both = (bi[:, table] == pj[:, table]) & (pi[:, table] == bj[:, table]) & (bi[:, table] != bj[:, table])
    keep &= np.where(bi[:, table] == bj[:, table], bi[:, table] == bucket, ~both | (bucket == np.minimum(bi[:, table], bj[:, table])))
    keep &= ids[i] != ids[j]
    i, j = i[keep], j[keep]
    n_links = np.bincount(i, weights=m[j], minlength=len(ids)) + np.bincount(j, weights=m[i], minlength=len(ids))
    low = ids.copy()
    while True:
        least = low.copy()
        np.minimum.at(least, i, low[j])
        np.minimum.at(least, j, low[i])
        if (least == low).all():
            break
        low = least
    some = n_links > 0
    return pa.table({"id": ids[some], "n": n_links[some].astype(np.int64), "low": low[some]})


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding",
    tables: int = 10, per_bucket: int = 32, block: int = 768, seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Pairs are those found in a common bucket and verified by cosine in double precision; every bucket is
    compared whole, large ones in pairs of blocks. Equal vectors are one entry with a count. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; only vectors of equal
    length link. component_id is the smallest id reachable, itself included. Rows with a null id take no
    part and come back with 0 links. Rows that repeat an id and a vector count as two vectors, linked.
    Columns of any other name are left out; an empty table gives no rows.
    """
    ship(vectors.sparkSession)
    # components travel as they are stored; they are compared in double precision
    kind = "float" if dict(vectors.dtypes)[column] == "array<float>" else "double"
    base = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast(f"array<{kind}>").alias("v"))
    ok = base.where(usable("v") & F.col("id").isNotNull())
    one = staged(ok.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many")))
    n = one.count()
    coarse = next((c for c in (0, 1, 2, 4, 8, 16, 32, 64) if 128 * max(1, 2 * c) * per_bucket >= n), 64)
    hasher = CrossPolytope(tables, coarse, seed)

    def hashed(batch: pa.RecordBatch):
        v = batch.column("v")
        rows = v.to_pylist()
        best, probe = np.empty((len(rows), tables), np.int64), np.empty((len(rows), tables), np.int64)
        length = np.array([len(r) for r in rows])
        for d in np.unique(length):
            at = np.flatnonzero(length == d)
            x = np.array([rows[i] for i in at], float)
            scale = np.abs(x).max(1, keepdims=True)
            best[at], probe[at] = hasher.codes(x / scale / np.sqrt(((x / scale) ** 2).sum(1, keepdims=True)))
        wide = lambda a: pa.array(list(a), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), v, batch.column("many"), wide(best), wide(probe)], names=["id", "v", "many", "best", "probe"])

    h = staged(map_arrow(one.select("id", "v", "many"), hashed, f"id long, v array<{kind}>, many long, best array<long>, probe array<long>"))
    entry = h.select("id", F.size("v").alias("d"), F.explode(F.flatten(F.array(
        F.transform("best", lambda k, t: F.struct(t.alias("t"), k.alias("bucket"), F.lit(0).alias("role"))),
        F.transform("probe", lambda k, t: F.struct(t.alias("t"), k.alias("bucket"), F.lit(1).alias("role"))),
    ))).alias("e")).select("id", "d", "e.*")
    size = entry.groupBy("d", "t", "bucket").agg(F.count(F.lit(1)).alias("held"), F.min("role").alias("role0"))
    size = size.where("held > 1 and role0 = 0").select("d", "t", "bucket", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    met = entry.join(size, ["d", "t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("*", other).select("id", "d", "t", "bucket", "role", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    met = met.join(h, "id")
    found = met.groupBy("d", "t", "bucket", "one", "two").applyInArrow(lambda t: _compare(t, threshold), "id long, n long, low long")
    found = staged(found)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    label = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    per = one.join(links, "id", "left").join(label, "id", "left")
    per = per.select(F.col("v").alias("pv"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    keyed = base.withColumn("pv", F.when(usable("v") & F.col("id").isNotNull(), F.col("v")))
    out = keyed.join(per, "pv", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
