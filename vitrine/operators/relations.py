"""Parent/child relations and access (JOIN-3..6, FLT-4, AGG-8, UDF-1).

The reference loads a product with its whole variation collection. A product
may hold a third of all variations, so the collection is never built as one
array per product here: the one-to-many relation stays flat, one row per
(product, variation), with the variation's position in id order computed by
the skew-safe numbering of ``windows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import images
from vitrine.operators import filters
from vitrine.operators.windows import row_number_by_id

VARIATION_COLUMNS = ["libelle", "attributs", "prix_supplement", "stock", "stock_utilise", "reference", "is_deleted"]


def products_with_variations(products: DataFrame, variations: DataFrame) -> DataFrame:
    """JOIN-3: every product with its variations in id order (flat; ``position`` 1-based).

    A product without variation appears once with NULL variation columns. The
    outer join is written as an inner join (variations on the streamed side,
    so AQE can split a product with a huge number of variations) plus the
    products that have none (anti join), instead of a left outer join whose
    skewed side could not be split.
    """
    numbered = row_number_by_id(variations, ["product_id"], out_col="position")
    v = numbered.select(F.col("product_id"), F.col("id").alias("variation_id"), "position",
                        *[F.col(c).alias("v_" + c) for c in VARIATION_COLUMNS])
    p = products.select(F.col("id").alias("product_id"), F.col("libelle").alias("product_libelle"),
                        F.col("is_deleted").alias("product_is_deleted"))
    matched = v.join(p, "product_id", "inner")
    lonely = p.join(variations.select("product_id").distinct(), "product_id", "left_anti")
    for field in v.schema.fields:
        if field.name != "product_id":
            lonely = lonely.withColumn(field.name, F.lit(None).cast(field.dataType))
    return matched.unionByName(lonely)


def products_with_plain_variations(products: DataFrame, variations: DataFrame) -> DataFrame:
    """The relation without positions, for uses that only sum or filter it."""
    v = variations.select("product_id", *[F.col(c).alias("v_" + c) for c in ("stock", "is_deleted")])
    p = products.select(F.col("id").alias("__pid"))
    matched = v.join(p, v.product_id == p["__pid"], "left_semi")
    none = p.select(F.col("__pid").alias("product_id"), F.lit(None).cast("bigint").alias("v_stock"),
                    F.lit(None).cast("boolean").alias("v_is_deleted"))
    return matched.unionByName(none)


def nested_stock_total(nested: DataFrame) -> DataFrame:
    """AGG-8: per product, stock of the variations that are not deleted (0 when none)."""
    active_stock = F.when(~F.coalesce(F.col("v_is_deleted"), F.lit(True)), F.col("v_stock"))
    return (nested.groupBy("product_id")
            .agg(F.coalesce(F.sum(active_stock), F.lit(0)).cast("bigint").alias("stock_total")))


def nested_active_variations(nested: DataFrame) -> DataFrame:
    """UDF-1: the collection filtered to variations that are not deleted."""
    return nested.filter(F.col("variation_id").isNotNull() & ~F.col("v_is_deleted"))


def manageable_variations(variations: DataFrame, products: DataFrame) -> DataFrame:
    """JOIN-4: active variations whose product exists and is active (lenient)."""
    p = filters.active_lenient(products).select(F.col("id").alias("__pid"), F.col("fournisseur_id"))
    v = filters.active_lenient(variations)
    return v.join(p, v.product_id == p.__pid, "inner").drop("__pid")


def products_invalid_supplier(products: DataFrame, users: DataFrame) -> DataFrame:
    """JOIN-5 / DQ-16: products whose supplier is not an active supplier account."""
    ok = filters.active_suppliers(users).select(F.col("id").alias("__sid"))
    return products.join(ok, products.fournisseur_id == ok.__sid, "left_anti")


def orphan_variations(variations: DataFrame, products: DataFrame) -> DataFrame:
    """DQ-17: variations whose product id resolves to no product."""
    p = products.select(F.col("id").alias("__pid"))
    return variations.join(p, variations.product_id == p.__pid, "left_anti")


def orphan_images(assets: DataFrame, products: DataFrame) -> DataFrame:
    """JOIN-6: stored image files no product refers to any more.

    Product keys are compared without the legacy ``uploads/products/`` prefix.
    """
    used = (products.filter(F.col("image").isNotNull())
            .select(images.strip_legacy_prefix(F.col("image")).alias("__key")))
    return assets.join(used, assets.image_key == used.__key, "left_anti")


def access_matrix(requests: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """FLT-4: may the user of each request manage the requested product?

    Admins may manage every product; a supplier only its own. A request for a
    missing product or from a missing user is not allowed.
    """
    p = products.select(F.col("id").alias("__pid"), F.col("fournisseur_id"))
    u = users.select(F.col("id").alias("__uid"), F.col("role"))
    joined = (requests.join(p, requests.product_id == p.__pid, "left")
              .join(u, requests.user_id == u.__uid, "left"))
    allowed = (F.col("__pid").isNotNull() & F.col("__uid").isNotNull()
               & ((F.col("role") == filters.ROLE_ADMIN) | F.col("fournisseur_id").eqNullSafe(F.col("user_id"))))
    return joined.select("event_id", "user_id", "product_id", allowed.alias("allowed"))


def stale_products(products: DataFrame, users: DataFrame) -> DataFrame:
    """DQ-23: active products whose supplier account is deleted (still listed, T11)."""
    deleted = users.filter(F.col("is_deleted") == True).select(F.col("id").alias("__sid"))  # noqa: E712
    p = filters.active_strict(products)
    return p.join(deleted, p.fournisseur_id == deleted.__sid, "left_semi")


def stale_variations(variations: DataFrame, products: DataFrame) -> DataFrame:
    """DQ-23: active variations whose product is deleted (no cascade, T11)."""
    deleted = products.filter(F.col("is_deleted") == True).select(F.col("id").alias("__pid"))  # noqa: E712
    v = filters.active_strict(variations)
    return v.join(deleted, v.product_id == deleted.__pid, "left_semi")
