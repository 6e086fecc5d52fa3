"""Pages far from the start are the same rows, from one id range."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import listing, membership, quality
from vitrine.sources import schemas


def _ids(kind, r):
    if kind == "dense":
        return list(range(1, 6001))
    if kind == "random":
        return sorted({r.getrandbits(62) for _ in range(6000)})
    return sorted({*range(3000), *(10 ** 15 + 7 * k for k in range(3000))})  # two dense runs, far apart


@pytest.mark.parametrize("kind", ["dense", "random", "apart"])
def test_deep_pages(spark, kind):
    ids = _ids(kind, random.Random(2))
    df = spark.createDataFrame([(i, f"row {i}") for i in random.Random(3).sample(ids, len(ids))], "id long, libelle string")
    newest = sorted(ids, reverse=True)
    for start in (0, 999, 1000, 2998, 3001, len(ids) // 2, len(ids) - 3, len(ids) - 1, len(ids), 10 ** 6):
        page = listing.newest_first(df, start, 5)
        assert [x.id for x in page.collect()] == newest[start:start + 5], start
    assert listing.newest_first(df.limit(0), 5000, 5).count() == 0


def test_a_deep_page_keeps_few_rows(spark):
    df = spark.range(0, 50_000, 1, 8).withColumn("libelle", F.lit("x"))
    plan = listing.newest_first(df, 40_000, 5)._jdf.queryExecution().executedPlan().toString()
    limit = int(plan.split("TakeOrderedAndProject(limit=", 1)[1].split(",", 1)[0])
    assert limit <= listing.SHALLOW + 5 and "id#" in plan


def test_only_possible_holders_are_shuffled(spark, tmp_path):
    users = spark.createDataFrame([(i, "N", "P", f"u{i}@x.tn", "ROLE_ADMIN", None, False) for i in range(5000)], schemas.USERS)
    users.write.parquet(f"{tmp_path}/users")
    stored = spark.read.schema(schemas.USERS).parquet(f"{tmp_path}/users")
    batch = spark.createDataFrame([(1, "U7@x.tn"), (7, "u7@x.tn"), (None, "free@x.tn"), (9, None)], "id long, email string")
    got = {(r.id, r.email): r.email_taken for r in quality.email_usage(batch, stored).collect()}
    assert got == {(1, "U7@x.tn"): True, (7, "u7@x.tn"): False, (None, "free@x.tn"): False, (9, None): False}
    plan = quality.email_usage(batch, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan
    held = membership.possible(stored.select("id", "email"), "email", batch, "email")
    assert 1 <= held.count() <= 5 and {r.email for r in held.collect()} >= {"u7@x.tn"}
    # every bit set: nothing is lost
    every = spark.range(5000).select((F.col("id")).alias("k"))
    assert membership.possible(every, "k", every, "k").count() == 5000


def test_clashing_references_of_a_batch(spark):
    rows = [(i, 1, "v", "[]", None, 1, 0, f"REF-{i % 50}" if i < 100 else f"OWN-{i}", False) for i in range(300)]
    variations = spark.createDataFrame(rows, schemas.VARIATIONS)
    batch = spark.createDataFrame([(1000, "ref-3 "), (1001, "NEW"), (1002, "new"), (150, "OWN-150"), (1003, "OWN-151"), (1004, None)],
                                  "id long, reference string")
    got = {r.id: r.n_rows for r in quality.clashing_references(batch, variations).collect()}
    assert got == {1000: 3, 1001: 2, 1002: 2, 1003: 2}
