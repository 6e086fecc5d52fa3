"""Summaries and the mart brought up to date equal the full rebuild, after random change sets."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.operators import increments, listing, summary
from vitrine.sources import parts, schemas


def _rows(r, ids):
    return [(i, r.randint(1, 12), "V", "[]", Decimal(r.choice(("0", "1.5", "2", "9"))), r.randint(0, 20), 0, None, r.random() < 0.3)
            for i in ids]


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_the_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    users = spark.createDataFrame([(s, "N", "P", f"s{s}@x.tn", "ROLE_FOURNISSEUR", "T", False) for s in (1, 2, 3, 4)], schemas.USERS)
    products = spark.createDataFrame([(i, f"P{i}", "D", None, Decimal("1"), 1 + i % 4, r.choice((False, False, None, True)))
                                      for i in range(1, 13)], schemas.PRODUCTS)
    now = {x[0]: x for x in _rows(r, range(60))}
    variations = spark.createDataFrame(list(now.values()), schemas.VARIATIONS)
    increments.write_state(variations, f"{tmp_path}/state-0")
    parts.write(listing.catalogue_mart(products, users, variations), f"{tmp_path}/mart-0", "fournisseur_id")
    for step in (1, 2, 3):
        changed = spark.createDataFrame(_rows(r, r.sample(range(70), r.choice((1, 4, 15)))), schemas.VARIATIONS)
        change = increments.delta(increments.rows_before(variations, changed), changed)
        increments.update_state(spark, f"{tmp_path}/state-{step - 1}", change, f"{tmp_path}/state-{step}")
        state = increments.read_state(spark, f"{tmp_path}/state-{step}")
        increments.update_mart(spark, f"{tmp_path}/mart-{step - 1}", products, users, state, change, f"{tmp_path}/mart-{step}")
        refreshed = increments.refreshed_summary(increments.read_state(spark, f"{tmp_path}/state-{step - 1}"), change).collect()
        now.update({x[0]: tuple(x) for x in changed.collect()})
        variations = spark.createDataFrame(list(now.values()), schemas.VARIATIONS)
        whole = {x["product_id"]: tuple(x) for x in summary.stock_summary(variations).select(
            "product_id", "stock_total", "has_price_supplement").collect()}
        assert {x["product_id"]: tuple(x) for x in increments.summary_of(state).collect()} == whole
        assert all(tuple(x) == whole.get(x["product_id"], (x["product_id"], 0, False)) for x in refreshed)
        mart = parts.read(spark, f"{tmp_path}/mart-{step}", "fournisseur_id")
        want = listing.catalogue_mart(products, users, variations).select(*mart.columns)
        assert sorted(map(str, mart.collect())) == sorted(map(str, want.collect()))


def test_only_touched_partitions_are_written(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    df = df.withColumn("k", F.when(F.col("k") == 4, F.lit(None)).otherwise(F.col("k")))
    parts.write(df, f"{tmp_path}/one", "k")
    touched = spark.createDataFrame([(1,), (None,)], "k long")
    parts.replace(spark, f"{tmp_path}/one", spark.createDataFrame([(7000, 1), (7001, 9)], "id long, k long"), f"{tmp_path}/two", "k", touched)
    assert {p.name for p in (tmp_path / "two" / "data").iterdir() if p.is_dir()} == {"k=1", "k=9"}
    got = sorted(map(tuple, parts.read(spark, f"{tmp_path}/two", "k").select("id", "k").collect()))
    assert got == sorted([(i, i % 5) for i in range(100) if i % 5 not in (1, 4)] + [(7000, 1), (7001, 9)])
    assert parts.read(spark, f"{tmp_path}/one", "k").count() == 100
    assert parts.read(spark, f"{tmp_path}/two", "k", spark.createDataFrame([(2,)], "k long")).count() == 20
