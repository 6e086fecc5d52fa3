"""Skew-safe row numbering equals row_number() over the whole group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators.windows import in_slices, last_before, page_numbers, row_number_by_id, sum_before


def test_row_number_matches_window(spark):
    # one hot key holding most rows, spread over many buckets of width 7
    df = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 10 < 7, F.lit(1)).otherwise(F.col("id") % 13).alias("k"))
    for desc in (False, True):
        got = row_number_by_id(df, ["k"], descending=desc)
        order = F.col("id").desc() if desc else F.col("id").asc()
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(order)).cast("bigint"))
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_page_numbers(spark):
    df = spark.range(1, 13).select(F.col("id"), F.lit(5).alias("s"))
    pages = {r.id: (r.rn, r.page) for r in page_numbers(df, ["s"], 5).collect()}
    assert pages[12] == (1, 0) and pages[8] == (5, 0) and pages[7] == (6, 1) and pages[1] == (12, 2)


def test_null_keys_are_a_group_not_dropped(spark):
    df = spark.range(0, 500).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).cast("long").alias("k"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("x")).alias("s"))
    got = row_number_by_id(df, ["k", "s"])
    assert got.count() == 500
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k", "s").orderBy("id")).cast("bigint"))
    assert sorted(got.collect(), key=repr) == sorted(want.select(*got.columns).collect(), key=repr)


def _slices(spark):
    """Settings under which a few thousand rows make many slices."""
    return {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}


@pytest.fixture
def many_slices(spark):
    before = {k: spark.conf.get(k) for k in _slices(spark)}
    for k, v in _slices(spark).items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_sparse_and_clustered_ids(spark, many_slices):
    """63-bit random ids, dense ids and ids far apart, with one hot key: right numbers, small slices."""
    r = random.Random(7)
    ids = {r.getrandbits(62) - (1 << 61) for _ in range(1500)} | set(range(1500)) \
        | {(1 << 42) + k for k in range(1500)} | {1_000_003 * k + 10**9 for k in range(1500)}
    df = spark.createDataFrame([(i, 1 if r.random() < 0.9 else r.randint(2, 9)) for i in sorted(ids)], "id long, k long")
    for desc in (False, True):
        got = row_number_by_id(df, ["k"], descending=desc)
        order = F.col("id").desc() if desc else F.col("id").asc()
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(order)).cast("bigint"))
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    sizes = in_slices(df, ["k"], F.col("id")).groupBy("k", "__slice").count()
    assert sizes.filter("k = 1").count() > 20
    assert sizes.agg(F.max("count")).first()[0] <= 4 * len(ids) / 40


def test_last_before(spark, many_slices):
    r = random.Random(9)
    rows = [(i, r.choice((None, 1, 1, 1, 1, 2, 3)), r.choice((None, None, None, i))) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, k long, v long")
    got = {x["o"]: x["b"] for x in last_before(df, ["k"], "o", {"b": "v"}).collect()}
    seen = {}
    for o, k, v in rows:
        assert got[o] == seen.get(k)
        seen[k] = v if v is not None else seen.get(k)


def test_sum_before(spark, many_slices):
    r = random.Random(3)
    rows = [(i, r.choice((None, 1, 1, 1, 2)), r.randint(0, 3)) for i in range(2500)]
    got = {x["o"]: x["s"] for x in sum_before(spark.createDataFrame(rows, "o long, k long, v long"), ["k"], "o", "v", "s").collect()}
    sums = {}
    for o, k, v in rows:
        assert got[o] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


def test_no_keys_and_no_rows(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("id"))
    assert sorted(tuple(x) for x in row_number_by_id(df, []).collect()) == [(i, i + 1) for i in range(50)]
    assert row_number_by_id(df.limit(0), []).count() == 0
