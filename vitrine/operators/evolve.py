"""Schema evolution and backfills of stored snapshots (EVO-1..5).

Each migration is a projection over the old snapshot, so it runs as one
map-only stage; the result is written to a new snapshot directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import images
from vitrine.sources.schemas import PRICE


def add_user_deleted_flag(users_v1: DataFrame) -> DataFrame:
    """EVO-1: ``is_deleted`` added to users, false for every existing row."""
    return users_v1.withColumn("is_deleted", F.lit(False))


def price_to_decimal(products_v1: DataFrame, column: str = "prix") -> DataFrame:
    """EVO-3: DOUBLE price -> decimal(10,3); values that do not fit become NULL
    and are flagged instead of failing the job."""
    dec = F.col(column).try_cast(PRICE)
    return (products_v1.withColumn("prix_overflow", F.col(column).isNotNull() & dec.isNull())
            .withColumn(column, dec))


def add_used_stock(variations_v1: DataFrame) -> DataFrame:
    """EVO-4: ``stock_utilise`` added with its default 0."""
    return variations_v1.withColumn("stock_utilise", F.lit(0).cast("bigint"))


def strip_image_prefix(products: DataFrame) -> DataFrame:
    """EVO-5 up: image keys lose the ``uploads/products/`` prefix."""
    return products.withColumn("image", images.strip_legacy_prefix(F.col("image")))


def restore_image_prefix(products: DataFrame) -> DataFrame:
    """EVO-5 down: the prefix is put back on non-NULL keys without it."""
    return products.withColumn("image", images.restore_legacy_prefix(F.col("image")))
