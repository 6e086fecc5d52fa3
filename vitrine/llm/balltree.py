"""Exact top-k inner products: ball-tree branch and bound per shard.

Vectors become integers, floor(64 x). Candidates are dealt by id hash to shards of
about ``SHARD_ROWS`` rows, queries to blocks of about ``QUERY_ROWS``; a task meets one
block with one shard. It builds one ball tree over the shard, and the block's queries go past it
in groups of ``TOGETHER``, as matrix products. The inner product of a query with any point of a ball is at
most ``q . center + |q| radius``. A group takes the nodes from a queue, greatest bound first: a node
whose bound is below a query's current kth score is left out for that query, an inner node puts its
children in the queue, a leaf is scanned at once. So good rows are met early, and the rest of the tree is
judged against the kth scores that they set.

The current kth scores are shared between shards, in waves: every block searches one shard, then two more,
then four, and so on, each wave with the kth scores of all that went before as its floor; a task
returns only rows that can still matter. Bounds are compared with a margin for rounding, and
ties of bound and kth score are visited, so the result is exact.

Work is blocks x shards: the stated query set against all rows, in blocks of bounded
size. Repeated rows are counted before they are dealt.

Defined cases: vectors that are null, empty of ids (null vec_id), or hold null or
non-finite components take no part; vectors of unlike lengths do not meet; rows with
the query's own id are its own and never its results; a query id that is repeated is
one query, with its least vector; repeated candidates are listed as often as they
occur; components beyond the range of a long saturate, and so do scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, ship_by_value

ship_by_value(__name__)

SCALE = 64
K = 20
EVERY = 20
SHARD_ROWS = 8192
QUERY_ROWS = 32_768
TOGETHER = 256
LEAF = 64
FOUND = "query_id long, vec_id long, score long"
LONG_MAX = 2**63 - 1


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))


class BallTree:
    """Nodes over rows that are reordered so that each node is a slice."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.rows: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(0, len(x), -1)]
        while todo:
            start, end, parent = todo.pop()
            points = x[self.order[start:end]]
            center = points.mean(axis=0)
            dist = np.sqrt(((points - center) ** 2).sum(axis=1))
            node = len(self.center)
            self.center.append(center)
            self.radius.append(float(dist.max()))
            self.rows.append((start, end))
            self.children.append(None)
            if parent >= 0:
                have = self.children[parent]
                self.children[parent] = (node, node) if have is None else (have[0], node)
            if end - start > leaf and self.radius[node] > 0:
                # split at the median along the line between two far points
                a = points[dist.argmax()]
                b = points[((points - a) ** 2).sum(axis=1).argmax()]
                along = np.argsort(points @ (b - a), kind="stable")
                self.order[start:end] = self.order[start:end][along]
                half = (start + end) // 2
                todo += [(half, end, node), (start, half, node)]

    def leaves(self) -> list[int]:
        return [node for node, children in enumerate(self.children) if not children]


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray,
           k: int = K) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's best k rows whose score is not below its floor."""
    big = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if big >= 2**52:  # beyond exact doubles: plain integers
        product = q.astype(object) @ x.astype(object).T
        scores = np.clip(product, -LONG_MAX, LONG_MAX).astype(np.int64)
        out = []
        for i in range(len(q)):
            fit = np.flatnonzero((ids != q_ids[i]) & (scores[i] >= floor[i]))
            best = fit[np.lexsort((ids[fit], -scores[i][fit]))[:k]]
            out += [(int(q_ids[i]), int(ids[j]), int(scores[i][j])) for j in best]
        return out
    x, q = x.astype(np.float64), q.astype(np.float64)
    tree = BallTree(x)
    x, ids = x[tree.order], ids[tree.order]
    margin = 1e-9 * (1 + big)
    out = []
    # queries that point the same way share most of their way through the tree
    near = np.argmax(q @ np.stack([tree.center[n] for n in tree.leaves()]).T, axis=1)
    for at in np.array_split(np.argsort(near, kind="stable"), max(1, -(-len(q) // TOGETHER))):
        top, top_ids = best_first(tree, x, ids, q[at], q_ids[at], floor[at].astype(np.float64), k, margin)
        found = (top > -np.inf) & (top >= floor[at][:, None])
        out += [(int(q_ids[at[i]]), int(top_ids[i, j]), int(top[i, j])) for i, j in zip(*np.nonzero(found))]
    return out


def best_first(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, k: int,
               margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best k rows; rows below its ``kth`` to begin with may be missing."""
    norm = np.sqrt((q * q).sum(axis=1))
    top = np.full((len(q), k), -np.inf)
    top_ids = np.full((len(q), k), LONG_MAX, dtype=np.int64)
    kth = kth.copy()
    queue: list[tuple] = []

    def offer(node: int, who: np.ndarray) -> None:
        upper = q[who] @ tree.center[node] + norm[who] * tree.radius[node] + margin
        live = upper >= kth[who]
        if live.any():
            heapq.heappush(queue, (-upper[live].max(), node, who[live], upper[live]))

    offer(0, np.arange(len(q)))
    while queue:
        _, node, who, upper = heapq.heappop(queue)
        who = who[upper >= kth[who]]  # the kth scores may have risen meanwhile
        if not len(who):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                offer(child, who)
            continue
        start, end = tree.rows[node]
        scores = q[who] @ x[start:end].T
        scores[q_ids[who][:, None] == ids[start:end][None, :]] = -np.inf
        better = scores.max(axis=1) >= kth[who]
        who, scores = who[better], scores[better]
        if not len(who):
            continue
        all_scores = np.concatenate([top[who], scores], axis=1)
        all_ids = np.concatenate([top_ids[who], np.broadcast_to(ids[start:end], scores.shape)], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
        top[who] = np.take_along_axis(all_scores, best, axis=1)
        top_ids[who] = np.take_along_axis(all_ids, best, axis=1)
        kth[who] = np.maximum(kth[who], top[who, -1])
    return top, top_ids


def _search_pair(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    found: list[tuple[int, int, int]] = []
    if len(queries) and len(rows):
        times = rows["times"].to_numpy()
        x = np.maximum(np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), -1), -LONG_MAX)
        x = np.repeat(x, times, axis=0)
        ids = np.repeat(rows["vec_id"].to_numpy(np.int64), times)
        q = np.maximum(np.array(queries["q"].tolist(), dtype=np.int64).reshape(len(queries), -1), -LONG_MAX)
        found = search(x, ids, q, queries["query_id"].to_numpy(np.int64), queries["floor"].to_numpy(np.float64))
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(table: DataFrame, every: int = EVERY, k: int = K, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    vectors = integer_vectors(table).groupBy("vec_id", "v").agg(
        F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    vectors = checkpointed(vectors.withColumn("dim", F.size("v")))
    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    blocks = max(1, -(-vectors.filter(is_query).count() // query_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    asked = (vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("q"))
             .select(F.col("vec_id").alias("query_id"), "q", F.size("q").alias("dim"), block.alias("block")))
    asked = checkpointed(asked.withColumn("first", F.pmod("block", F.lit(shards))))
    key = ["dim", "block", "shard"]
    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    # the turn of a shard for a block: its own shard first, then the others in order
    copies = dealt.select("vec_id", "v", "times", "dim", "shard", F.explode(every_block).alias("block")).withColumn(
        "turn", F.pmod(F.col("shard") - F.pmod("block", F.lit(shards)), F.lit(shards)))
    found = None
    turn, wave = 0, 1
    while turn < shards:
        turns = F.sequence(F.lit(turn), F.lit(min(turn + wave, shards) - 1))
        now = asked.select("query_id", "q", "dim", "block", "first", F.explode(turns).alias("turn")).withColumn(
            "shard", F.pmod(F.col("first") + F.col("turn"), F.lit(shards)).cast("int"))
        if found is None:
            now = now.withColumn("floor", F.lit(float("-inf")))
        else:
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            kth = kth.filter(F.col("n") >= k).select(F.col("query_id").alias("__id"), F.col("least").cast("double").alias("floor"))
            now = now.join(kth, F.col("query_id") == F.col("__id"), "left").withColumn(
                "floor", F.coalesce("floor", F.lit(float("-inf"))))
        rows = copies.filter(F.col("turn").between(turn, min(turn + wave, shards) - 1)).select("vec_id", "v", "times", *key)
        met = now.select("query_id", "q", "floor", *key).groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_search_pair, FOUND)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = (met if found is None else found.select("query_id", "vec_id", "score").unionByName(met)).withColumn(
            "rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = checkpointed(ranked)
        turn, wave = turn + wave, 2 * wave
    return found.select("query_id", "rank", "vec_id", "score")
