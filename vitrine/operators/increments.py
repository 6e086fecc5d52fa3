"""Summaries and the mart kept up to date from what a batch changed (AGG-6, AGG-9, SNK-4).

The summary's state counts a product's active variations by supplement: ``product_id, prix_supplement, n, stock``. A change
takes the old row's share out and puts the new row's in, as signed sums; when the last variation with the greatest
supplement goes, the next one is in the state already, so no variation is read again. State and mart are stored in
partitions (``sources.parts``); a batch rewrites those that it touches and refers to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import filters, listing, membership
from vitrine.session import materialise
from vitrine.sources import parts

#: Partitions of a stored state.
BUCKETS = 64


def summary_state(variations: DataFrame) -> DataFrame:
    """The state of all products with active variations."""
    return (filters.active_strict(variations).groupBy("product_id", "prix_supplement")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("stock"), F.lit(0)).cast("bigint").alias("stock")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed state of a change set: its rows as they were stored, and as they are now. Values that do not move are left out."""
    both = summary_state(after).unionByName(summary_state(before).select(
        "product_id", "prix_supplement", (-F.col("n")).alias("n"), (-F.col("stock")).alias("stock")))
    return _summed(both).filter((F.col("n") != 0) | (F.col("stock") != 0))


def _summed(state: DataFrame) -> DataFrame:
    return state.groupBy("product_id", "prix_supplement").agg(F.sum("n").alias("n"), F.sum("stock").alias("stock"))


def merged(state: DataFrame, change: DataFrame) -> DataFrame:
    """The state after a change; values that no variation has any more are gone."""
    return _summed(state.unionByName(change)).filter("n > 0")


def summary_of(state: DataFrame) -> DataFrame:
    """``summary.stock_summary`` from the state."""
    return state.groupBy("product_id").agg(
        F.sum("stock").cast("bigint").alias("stock_total"),
        F.coalesce(F.max("prix_supplement").cast("double") > 0, F.lit(False)).alias("has_price_supplement"))


def rows_before(variations: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored rows of the changed ids."""
    return membership.possible(variations, "id", changed, "id").join(changed.select("id"), "id", "left_semi")


def _bucketed(state: DataFrame) -> DataFrame:
    return state.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(BUCKETS)).cast("int"))


def write_state(variations: DataFrame, root: str) -> None:
    parts.write(_bucketed(summary_state(variations)), root, "bucket")


def read_state(spark, root: str) -> DataFrame:
    return parts.read(spark, root, "bucket").drop("bucket")


def update_state(spark, root: str, change: DataFrame, new_root: str) -> None:
    """The next version of a stored state: buckets with a changed product are rewritten."""
    change = _bucketed(change)
    touched = change.select("bucket").distinct()
    near = parts.read(spark, root, "bucket", touched)
    columns = ["product_id", "prix_supplement", "n", "stock"]
    parts.replace(spark, root, _bucketed(merged(near.select(columns), change.select(columns))), new_root, "bucket", touched)


def update_mart(spark, root: str, products: DataFrame, users: DataFrame, state: DataFrame, changed_products: DataFrame,
                new_root: str) -> None:
    """The next version of a stored mart: suppliers with a changed product (``product_id``) are rewritten, from the new state."""
    ids = changed_products.select("product_id").distinct()
    owned = products.join(ids, products.id == ids.product_id, "left_semi")
    touched = materialise(filters.active_strict(owned).select("fournisseur_id").distinct())
    mine = products.join(touched, "fournisseur_id", "left_semi").select(*products.columns)
    near = membership.possible(state, "product_id", mine, "id")
    rows = listing.mart_rows(listing.product_listing(mine, users), summary_of(near))
    parts.replace(spark, root, rows, new_root, "fournisseur_id", touched)


def refreshed_summary(state: DataFrame, change: DataFrame) -> DataFrame:
    """AGG-9 after a change set: stock and supplement flag of the touched products, 0 and false without active variation."""
    touched = materialise(change.select("product_id").distinct())
    near = membership.possible(state, "product_id", touched, "product_id").join(touched, "product_id", "left_semi")
    now = summary_of(merged(near, change))
    return touched.join(now, "product_id", "left").select(
        "product_id", F.coalesce("stock_total", F.lit(0)).cast("bigint").alias("stock_total"),
        F.coalesce("has_price_supplement", F.lit(False)).alias("has_price_supplement"))


