"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round points every node at the least label among its neighbours, first from
the larger neighbours, then from the smaller ones; a chain of n links takes a number
of rounds that grows with log n. The links of a hub are spread over salted join keys,
and minima are combined before they are shuffled. Every round is stored, so a
lost executor costs one round. Before the first round each task replaces its links by
stars that join the same nodes, so a few links need no round. The rounds end when every
node has one link at most to a lesser node, which has none itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import ship_by_value, stored

ship_by_value(__name__)

SALTS = 8
#: Links that a task joins at a time.
FLUSH = 200_000


def joined(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Per node that is not the least of its component of ``links``, the least one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while root in parent:
            root = parent[root]
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _joined_in_tasks(edges: DataFrame) -> DataFrame:
    """Links u, v (v < u) of the same components as ``edges`` (u, v) has."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            stars = joined(link for b in held for link in zip(b.column("u").to_pylist(), b.column("v").to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array(stars.keys(), pa.int64()), pa.array(stars.values(), pa.int64())],
                                              schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.mapInArrow(run, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has at most one link to a lesser node, and that one has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 OR up > 0 AND down > 0").count()


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its v's. ``pairs`` has u, v."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    least = least.select(F.col("u").alias("w"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col("u") == F.col("w")) & (F.col("s") == F.col("t"))).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b); the component is its least node."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(_joined_in_tasks(edges))
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct())
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
