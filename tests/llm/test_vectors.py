"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import covertree, lsh

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    for i in range(120):  # near copies at many angles
        x[400 + i] = x[i % 15] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2, 0.35])
    return [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]


ODD = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [NAN] + [1.0] * 23), (1004, [INF] * 24), (1005, [None] + [1.0] * 23), (1006, [1.0, 2.0]), (1007, [1.0, 2.0]), (1008, [2.0, 4.1]), (None, [1.0] * 24)]


def test_links_recall_and_components(spark, vectors):
    got = {r.vec_id: r for r in lsh.link_vectors(frame(spark, vectors + ODD).withColumn("label", F.lit(1)), block=16).collect()}
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i, _ in vectors)
    assert found <= near.sum() and found >= 0.95 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i, _ in vectors)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    same = sum(got[i].component_id == label[i] for i in range(len(x)))
    assert same >= 0.98 * len(x)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert [(got[i].n_links, got[i].component_id) for i in (1006, 1007, 1008)] == [(2, 1006)] * 3
    assert got[None].n_links == 0 and lsh.link_vectors(frame(spark, [])).count() == 0


def test_block_pairs_count_each_link_once(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=16)
    rows = [(i, [float(v) for v in c + rng.normal(size=16) * 0.01]) for i in range(90)] + [(100 + i, [float(v) for v in c]) for i in range(5)]
    for r in lsh.link_vectors(frame(spark, rows), block=8).collect():
        assert (r.n_links, r.component_id) == (94, 0)


def test_hashes_keep_angles():
    h = lsh.CrossPolytope(40, 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.03
    a, b, z = h.codes(x)[0], h.codes(y)[0], h.codes(rng.normal(size=x.shape))[0]
    assert (a == b).mean() > 0.3 > 0.02 > (a == z).mean()
    assert np.allclose(np.linalg.norm(lsh.hadamard(x), axis=1), 1)


def brute_top(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(-s, i) for s, i in best[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("block", [64, 10**6])
def test_top_k_is_exact(spark, vectors, block):
    rows = vectors + ODD + [(2000 + i, vectors[0][1]) for i in range(9)]  # ties
    got = {}
    odd = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "d", "cell", "query", "floor")})
    for r in covertree.top_k(odd, F.col("id") % 50 == 0, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute_top(rows)


def test_top_k_edges(spark):
    assert covertree.top_k(frame(spark, []), F.col("id") % 50 == 0).count() == 0
    assert [(r.query_id, r.vec_id) for r in covertree.top_k(frame(spark, [(0, [1.0]), (7, [1.0])]), F.col("id") % 50 == 0).collect()] == [(0, 7)]


def test_top_k_above_doubles(spark):
    """Sums that doubles can't tell apart."""
    big = float(2**30)
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [big, 3.0]), (None, [big, 9.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in covertree.top_k(d, F.col("id") == 0, scale=1.0).orderBy("rank").collect()]
    assert got == [(3, 2**60 + 3), (2, 2**60 + 2), (1, 2**60 + 1)]
    assert covertree.exact_products(np.array([[2**40, 5]]), np.array([[2**40, 1]])).tolist() == [[np.iinfo(np.int64).max]]


def test_inner_query_nodes_prune():
    """Clusters: pairs of whole nodes are ruled out above the leaves, and results stay those of brute force."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(400, 16)) * 6 for c in centres])).astype(np.int64)
    q = x[::7]
    s = covertree.Search(q, np.arange(len(x))[::7], x, np.arange(len(x)), 5, leaf=32)
    full = q @ x.T
    full[np.arange(len(q)), np.arange(len(x))[::7]] = np.iinfo(np.int64).min
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), full.shape), ~full), axis=1)[:, :5]
    assert (s.found == order).all() and s.inner_pruned > 0 and s.met < 0.2 * (len(q) / 16) * (len(x) / 32)


def test_cover_tree_levels():
    x = np.random.default_rng(3).normal(size=(700, 6))
    t = covertree.CoverTree(x, leaf=16)

    def walk(n):
        own = n.rows if n.rows is not None else np.concatenate([walk(c) for c in n.children])
        assert np.sqrt(((x[own] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        return own

    assert sorted(walk(t.root).tolist()) == list(range(700))
    before = None
    for scale, net in t.levels:
        apart = np.sqrt(((x[net][:, None] - x[net][None]) ** 2).sum(2))
        assert (apart[~np.eye(len(net), dtype=bool)] > scale).all()  # separation
        if before is not None:
            assert np.sqrt(((x[before][:, None] - x[net][None]) ** 2).sum(2)).min(1).max() <= scale  # covering
            assert set(net) <= set(before)  # nesting
        before = net
    repeats = covertree.CoverTree(np.ones((50, 3)), leaf=8)
    assert repeats.root.rows is not None and len(repeats.root.rows) == 50
