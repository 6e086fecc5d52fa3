"""Aggregations (AGG-1..9).

Every aggregation is a hash aggregate with a map-side partial step, so a product
or supplier holding a third of all rows is pre-summed in each task before the
shuffle and never lands in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import filters


def stock_summary(variations: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """Per product: stock of active variations and whether any costs extra.

    ``product_ids`` (a DataFrame with an ``id`` column) restricts the summary to
    those products first, the way the listing only summarises its page.
    Output: ``product_id, stock_total, has_price_supplement``.
    """
    return stock_and_supplement(variations, product_ids).drop("max_supplement")


def stock_and_supplement(variations: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """``stock_summary`` with the greatest supplement itself, from the same aggregation."""
    v = filters.active_strict(variations)
    if product_ids is not None:
        v = filters.by_keys(v, product_ids, column="product_id")
    return (v.groupBy("product_id")
            .agg(F.coalesce(F.sum("stock"), F.lit(0)).cast("bigint").alias("stock_total"),
                 F.max("prix_supplement").alias("max_supplement"))
            .select("product_id", "stock_total", "max_supplement",
                    F.coalesce(F.col("max_supplement").cast("double") > 0, F.lit(False))
                     .alias("has_price_supplement")))


def total_stock(variations: DataFrame, product_id: int) -> DataFrame:
    """``COALESCE(SUM(stock), 0)`` of one product's active variations (one row)."""
    v = filters.active_strict(filters.of_parent(variations, product_id))
    return v.agg(F.coalesce(F.sum("stock"), F.lit(0)).cast("bigint").alias("stock_total"))


def stock_totals(products: DataFrame, variations: DataFrame) -> DataFrame:
    """``total_stock`` of every product."""
    s = stock_summary(variations)
    p = products.select("id")
    return (p.join(s, p.id == s.product_id, "left")
            .select(F.col("id").alias("product_id"),
                    F.coalesce(F.col("stock_total"), F.lit(0)).cast("bigint").alias("stock_total")))


def count_active_products(products: DataFrame, supplier_id: int | None = None) -> DataFrame:
    p = filters.for_supplier(filters.active_strict(products), supplier_id)
    return p.agg(F.count("id").alias("records_total"))


def count_products_by_supplier(products: DataFrame) -> DataFrame:
    return (filters.active_strict(products).groupBy("fournisseur_id")
            .agg(F.count("id").alias("records_total")))


def total_and_filtered(df: DataFrame, match: Column | None, keys: list[str] | None = None) -> DataFrame:
    """Total rows and rows passing ``match`` in one pass (no second job).

    A blank search (``match`` None) makes the filtered count equal the total.
    """
    filtered = F.count(F.lit(1)) if match is None else F.count_if(F.coalesce(match, F.lit(False)))
    aggs = [F.count(F.lit(1)).alias("records_total"), filtered.cast("bigint").alias("records_filtered")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def refreshed_stock(variations: DataFrame, changed: DataFrame) -> DataFrame:
    """Stock totals of the products touched by a change set, after the change.

    ``changed`` holds the changed variation rows (``product_id`` column); the
    summary is restricted to those products by a semi join. Products left with
    no active variation report 0.
    """
    touched = changed.select(F.col("product_id").alias("id")).distinct()
    summary = stock_summary(variations, touched)
    return (touched.join(summary, touched.id == summary.product_id, "left")
            .select(F.col("id").alias("product_id"),
                    F.coalesce(F.col("stock_total"), F.lit(0)).cast("bigint").alias("stock_total")))
