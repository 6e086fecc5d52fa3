import math
import random

from vitrine.llm import balltree


def brute(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = {}
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q and len(c) == len(v))
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, kind="float", **how):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    out = {}
    for r in balltree.top_k(table.withColumn("score", table.vec_id), **how).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def test_clusters_ties_and_copies(spark):
    r = random.Random(3)
    centers = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(1500):
        c = r.choice(centers)
        rows.append((i, [round(x + r.uniform(-0.2, 0.2), 1) for x in c]))  # rounded: many ties
    rows += [(2000 + i, rows[0][1]) for i in range(300)] + [rows[7], rows[7], rows[40]]
    assert run(spark, rows, "double", shard_rows=300, query_rows=25) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (100, []), (101, []), (-20, [0.5, -0.5]), (3, [1.0, 2.0, 3.0]), (5, [-1.0, 0.01]),
            (120, [2.0, 2.0, 2.0])]
    assert run(spark, rows, "double") == brute(rows)
    assert run(spark, []) == {}
    assert run(spark, [(20, [1.0])]) == {}


def test_large_components_are_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 2.0**24 for _ in range(3)]) for i in range(100)]
    assert run(spark, rows, "double") == brute(rows)
    huge = run(spark, [(0, [1e300]), (1, [-1e300]), (2, [1.0])], "double")
    assert huge == {0: [(1, 2, 64 * (2**63 - 1) if 64 * (2**63 - 1) < 2**63 else 2**63 - 1), (2, 1, -(2**63 - 1))]}


def test_bound_holds_for_every_node():
    import numpy as np
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 20, (700, 5)))
    tree = balltree.BallTree(x, leaf=16)
    q = np.floor(rng.normal(0, 20, (30, 5)))
    for node, (start, end) in enumerate(tree.rows):
        best = (q @ x[tree.order[start:end]].T).max(axis=1)
        assert (best <= q @ tree.center[node] + np.sqrt((q * q).sum(axis=1)) * tree.radius[node] + 1e-6).all()
