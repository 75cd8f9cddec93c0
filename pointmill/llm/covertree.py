"""Exact top-k inner products by dual-tree search over cover trees of queries and candidates.

Candidates are dealt to cells around pivots, cells to blocks of bounded size. Each query first meets one
block of its most promising cell; its kth score there then rules out all cells whose covering radius
can't lift a candidate to it, and only what is left is met, again by dual-tree search. All scores are
exact whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import discard, ship, staged

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def far_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, gaps, own): points picked one after the other, each the farthest from those before, and how
    far it was; and for each row of x the pick it is nearest to. Ends when nothing is left but repeats."""
    norms = (x * x).sum(1)
    near, own = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    rows, gaps, at = [], [], 0
    while len(rows) < most:
        if rows and near[at] <= 0:
            break
        gaps.append(np.inf if not rows else float(np.sqrt(near[at])))
        d = np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0)
        d[at] = 0
        closer = d < near
        own[closer], near = len(rows), np.minimum(near, d)
        rows.append(at)
        at = int(near.argmax())
    return np.array(rows), np.array(gaps), own


class Node:
    __slots__ = ("center", "radius", "rows", "children", "norm", "worst", "parent")

    def __init__(self, center, radius, rows, children):
        self.center, self.radius, self.rows, self.children = center, radius, rows, children
        self.norm, self.worst, self.parent = float(np.sqrt(center @ center)), -np.inf, None
        for c in children:
            c.parent = self


class CoverTree:
    """Levels of nested nets of points: at the level of scale s, centres are farther than s apart, and each
    point of the level below is within s of the centre it hangs from. Leaves hold about `leaf` rows, those
    nearest to a centre of the lowest level. `radius` is the distance to the farthest row below a node."""

    def __init__(self, x: np.ndarray, leaf: int = 64, base: float = 1.6):
        self.x = x
        picks, gaps, own = far_first(x, max(1, -(-len(x) // leaf)))
        self.levels: list[tuple[float, np.ndarray]] = []
        nodes = {}
        for i, p in enumerate(picks):
            rows = np.flatnonzero(own == i)
            nodes[i] = self._node(p, rows, rows, ())
        held = {i: n.rows for i, n in nodes.items()}
        scale = gaps[-1] if len(gaps) > 1 else 0.0
        alive = len(picks)
        while alive > 1:
            scale = max(scale * base, gaps[alive - 1])
            keep = int((gaps > scale).sum())  # gaps never rise, so a level is the picks up to some place
            if keep == alive:
                continue
            self.levels.append((scale, picks[:keep]))
            up = picks[:keep]
            below: dict[int, list[int]] = {i: [i] for i in range(keep)}
            for i in range(keep, alive):
                d = ((x[up] - x[picks[i]]) ** 2).sum(1)
                below[int(d.argmin())].append(i)
            for i, members in below.items():
                if len(members) > 1:
                    held[i] = np.concatenate([held[m] for m in members])
                    nodes[i] = self._node(picks[i], held[i], None, [nodes[m] for m in members])
            alive = keep
        self.root = nodes[0]

    def _node(self, at, under, rows, children) -> Node:
        d = self.x[under] - self.x[at]
        return Node(self.x[at], float(np.sqrt((d * d).sum(1).max())) * (1 + 1e-12), rows, children)

    def leaves(self, node: Node | None = None):
        node = node or self.root
        if node.rows is not None:
            yield node
        for c in node.children:
            yield from self.leaves(c)


def bound(q: Node, r: Node) -> float:
    """No inner product of a vector under q with one under r exceeds this, rounding allowed for."""
    a, b = q.norm + q.radius, r.norm + r.radius
    return float(q.center @ r.center) + q.norm * r.radius + r.norm * q.radius + q.radius * r.radius + 1e-10 * a * b + 1e-6


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles or longs where no sum can leave them, else in Python's own
    whole numbers, which then stop at the ends of a long."""
    high = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if high < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if high < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), _LOW + 1, _HIGH).astype(np.int64)


class Search:
    """Dual-tree search of the k best (score, id) of each query, ties to smaller ids, the query's own id left out.

    floor: a score per query that a result must reach. met and pruned count node pairs, inner_pruned those
    of them whose query node is not a leaf."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, leaf: int = 64):
        n = len(queries)
        self.queries, self.query_ids, self.x, self.ids, self.k = queries, query_ids, x, ids, k
        self.scores, self.found = np.full((n, k), _LOW), np.full((n, k), _HIGH)
        self.floor = np.full(n, _LOW) if floor is None else floor
        self.met = self.pruned = self.inner_pruned = 0
        self.qt, self.rt = CoverTree(queries.astype(float), leaf // 2), CoverTree(x.astype(float), leaf)
        done: dict[int, int] = {}
        for q in self.qt.leaves():  # one promising leaf for each query leaf, so that the search starts with good scores
            r = self.rt.root
            while r.rows is None:
                r = max(r.children, key=lambda c: bound(q, c))
            self._compare(q, r)
            done[id(q)] = id(r)
        self.done = done
        self._visit(self.qt.root, self.rt.root)

    def _visit(self, q: Node, r: Node) -> None:
        stack = [(q, r)]
        while stack:
            q, r = stack.pop()
            self.met += 1
            if bound(q, r) < q.worst:  # no candidate under r reaches the worst kth score under q
                self.pruned += 1
                self.inner_pruned += q.rows is None
            elif q.rows is not None and r.rows is not None:
                if self.done.get(id(q)) != id(r):
                    self._compare(q, r)
            elif r.rows is None and (q.rows is not None or r.radius >= q.radius):
                stack += sorted(((q, c) for c in r.children), key=lambda p: bound(*p))
            else:
                stack += [(c, r) for c in q.children]

    def _compare(self, q: Node, r: Node) -> None:
        s = exact_products(self.queries[q.rows], self.x[r.rows])
        own = self.query_ids[q.rows][:, None] == self.ids[r.rows][None, :]
        kth = np.maximum(self.scores[q.rows, -1], self.floor[q.rows])
        good = (s >= kth[:, None]) & ~own
        better = np.flatnonzero(good.any(1))
        if len(better):
            at = q.rows[better]
            all_s = np.concatenate([self.scores[at], np.where(good[better], s[better], _LOW)], 1)
            all_i = np.concatenate([self.found[at], np.where(good[better], self.ids[r.rows][None, :], _HIGH)], 1)
            order = np.lexsort((all_i, ~all_s), axis=1)[:, : self.k]
            self.scores[at] = np.take_along_axis(all_s, order, 1)
            self.found[at] = np.take_along_axis(all_i, order, 1)
        worst = float(np.maximum(self.scores[q.rows, -1], self.floor[q.rows]).min())
        q.worst = worst if worst > _LOW else -np.inf
        while (up := q.parent) is not None:
            now = min(c.worst for c in up.children)
            if now <= up.worst:
                break
            up.worst, q = now, up


def _wide(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


OUT = "query_id long, vec_id long, score long"


def _search_block(t: pa.Table, k: int) -> pa.Table:
    side = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
    out_q, out_i, out_s = [], [], []
    q, c = t.filter(pa.array(side)), t.filter(pa.array(~side))
    if len(q) and len(c):
        ids, floor = q.column("id").to_numpy(), q.column("floor").to_numpy()
        s = Search(_wide(q.column("v"), len(q)), ids, _wide(c.column("v"), len(c)), c.column("id").to_numpy(), k, floor)
        hit = s.found < _HIGH
        out_q.append(np.broadcast_to(ids[:, None], hit.shape)[hit]), out_i.append(s.found[hit]), out_s.append(s.scores[hit])
    flat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return pa.table({"query_id": flat(out_q), "vec_id": flat(out_i), "score": flat(out_s)})


def _cells(v: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """v with its cell, the nearest pivot of its length, and its distance from it; cell 0 at distance -1 where its length has no pivots."""

    def run(batches):
        for b in batches:
            vs, lengths = b.column("v"), b.column("d").to_numpy()
            cell, far = np.zeros(len(lengths), np.int32), np.full(len(lengths), -1.0)
            for d in np.unique(lengths):
                if int(d) in pivots:
                    at = np.flatnonzero(lengths == d)
                    x, p = _wide(pa.chunked_array([vs.take(pa.array(at))]), len(at)).astype(float), pivots[int(d)]
                    near = ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
                    cell[at], far[at] = near, np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["id", "v", "d", "query", "cell", "far"])

    return v.select("id", "v", "d", "query").mapInArrow(run, "id long, v array<long>, d int, query boolean, cell int, far double")


def _targets(q: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """q with a row for each cell to meet: the one of the highest bound, or all others whose bound reaches `floor`."""

    def run(batches):
        for b in batches:
            vs, lengths, floor, skip = b.column("v"), b.column("d").to_numpy(), b.column("floor").to_numpy(), b.column("seed").to_numpy()
            rows, to = [], []
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = _wide(pa.chunked_array([vs.take(pa.array(at))]), len(at)).astype(float)
                no, pivot, radius = cells[int(d)]
                norm = np.sqrt((x * x).sum(1))[:, None]
                high = (x @ pivot.T if pivot.size else np.zeros((len(x), len(no)))) + norm * radius[None, :] * (1 + 1e-10) + 1e-6
                if pivot.size:
                    high += 1e-10 * norm * np.sqrt((pivot * pivot).sum(1))[None, :]
                if first:
                    rows.append(at), to.append(no[high.argmax(1)])
                else:
                    i, j = np.nonzero(high >= floor[at][:, None].astype(float))
                    rows.append(at[i]), to.append(no[j])
            rows, to = np.concatenate(rows), np.concatenate(to)
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("id", "v", "d", "floor", "seed")), pa.array(to.astype(np.int32))], names=["id", "v", "d", "floor", "seed", "cell"])

    return q.select("id", "v", "d", "floor", "seed").mapInArrow(run, "id long, v array<long>, d int, floor long, seed int, cell int")


def _meet(c: DataFrame, q: DataFrame, k: int, most: int) -> DataFrame:
    """Results of dual-tree searches of queries (id, v, d, floor, cell, sub) in the blocks of candidates (id, v, d, cell, sub).

    Where more than `most` queries meet a block, they do so in parts."""
    key = ["d", "cell", "sub"]
    parts = q.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts"))
    q = q.join(parts, key).select(*key, "id", "v", "floor", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"))
    c = c.join(parts, key).select(*key, "id", "v", F.lit(0).cast("long").alias("floor"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    return c.unionByName(q).groupBy(*key, "part").applyInArrow(lambda t: _search_block(t, k), OUT)


def top_k(
    vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0,
    block: int = 16384, most_cells: int = 1024, sample: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): exact, over vectors of whole numbers floor(scale * x).

    is_query: a Column over `id`. Pivots are picked from at most `sample` vectors, which only decides where
    cells lie: every vector belongs to a cell. Cells of more than `block` vectors are several blocks, as
    many as it takes. Scores that a long can't hold stop at its ends, as do components; ties go to the
    smaller id. Vectors that are null or hold null or non-finite components take no part; vectors of
    unequal length don't meet; empty ones meet with score 0. A query skips candidates of its own id, so
    rows that repeat an id skip each other. Null ids take no part. Other columns, of any name, are left
    out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", bad))
    v = v.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"), F.size("v").alias("d"))
    v = staged(v.withColumn("query", F.coalesce(is_query, F.lit(False))))
    n = v.count()
    some: dict[int, list] = {}
    for r in v.where("d > 0").select("v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("v").to_pylist() if n else []:
        some.setdefault(len(r), []).append(r)
    pivots = {}
    for d, rows in some.items():
        x = np.array(rows, float)
        share = max(1, min(most_cells, n * len(rows) // (sum(map(len, some.values())) * block)))
        pivots[d] = x[far_first(x, share)[0]]
    every = staged(_cells(v, pivots))
    discard(v)
    # a row a cell: at most most_cells of each length that has pivots, one of any other
    stats = every.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    stats = staged(stats.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")))
    cells = {}
    for d in [r.d for r in stats.select("d").distinct().collect()]:
        rows = stats.where(F.col("d") == d).collect()
        no = np.array([r.cell for r in rows])
        cells[d] = (no, pivots[d][no], np.array([r.radius for r in rows])) if d in pivots else (no, np.zeros((0, 0)), np.full(len(no), np.inf))
    join = ["d", "cell"]
    c = every.join(F.broadcast(stats.select(*join, "blocks")), join).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    c = staged(c.select("id", "v", "d", "cell", "sub"))
    q = every.where("query").select("id", "v", "d", F.lit(_LOW).cast("long").alias("floor"), F.lit(-1).alias("seed"))
    blocks = F.broadcast(stats.select(*join, "blocks"))
    seeds = _targets(q, cells, True).join(blocks, join)
    seeds = seeds.withColumn("sub", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("blocks")).cast("int"))
    seeds = staged(seeds.select("id", "v", "d", "cell", "sub"))
    found = staged(_meet(c, seeds.withColumn("floor", F.lit(_LOW).cast("long")), k, block))
    kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    q = seeds.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "d", F.coalesce("kth", F.lit(_LOW)).cast("long").alias("floor"), F.col("cell").alias("seed"))
    rest = _targets(q, cells, False).join(blocks, join).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = (F.col("cell") == F.col("seed")) & (F.col("sub") == F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("blocks")))
    rest = staged(rest.where(~met).select("id", "v", "d", "floor", "cell", "sub"))
    more = _meet(c, rest, k, block)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
