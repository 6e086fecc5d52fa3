"""Image key expressions (SCL-6, SCL-7, SCL-8, DQ-20..22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import fold

# Public path of product images, the placeholder shown when a
# product has none, the prefix older rows stored in the key, the accepted
# upload types and extensions, and the upload size limit (5 MiB).
IMAGE_BASE = "uploads/products"
PLACEHOLDER = "images/product-placeholder.jpg"
LEGACY_PREFIX = "uploads/products/"
ALLOWED_MIME = ("image/jpeg", "image/png", "image/webp")
ALLOWED_EXT = ("jpg", "jpeg", "png", "webp")
MAX_BYTES = 5 * 1024 * 1024

# Shape of a key made at upload: "<supplier id>/<32 hex chars>.<ext>".
KEY_PATTERN = r"^[0-9]+/[0-9a-f]{32}\.(jpg|jpeg|png|webp)$"
# A ".." path segment anywhere in the key.
PARENT_SEGMENT = r"(^|/)\.\.(/|$)"


def image_url(image: Column, base: str = IMAGE_BASE, placeholder: str = PLACEHOLDER) -> Column:
    """Base without trailing '/' + '/' + key without leading '/'; placeholder when NULL or ''."""
    base = base.rstrip("/")
    return (F.when(image.isNull() | (image == ""), F.lit(placeholder))
            .otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(image, "^/", ""))))


def has_legacy_prefix(image: Column) -> Column:
    """``image LIKE 'uploads/products/%'`` under the case/accent-insensitive collation."""
    return F.startswith(fold(image), F.lit(LEGACY_PREFIX))


def strip_legacy_prefix(image: Column) -> Column:
    """``SUBSTRING(image, 18)`` for keys with the old prefix; others unchanged."""
    return F.when(has_legacy_prefix(image), F.substring(image, len(LEGACY_PREFIX) + 1, 1 << 30)).otherwise(image)


def restore_legacy_prefix(image: Column) -> Column:
    """``CONCAT(prefix, image)`` for non-NULL keys without the prefix."""
    return (F.when(image.isNotNull() & ~has_legacy_prefix(image), F.concat(F.lit(LEGACY_PREFIX), image))
            .otherwise(image))


def key_well_formed(image: Column) -> Column:
    return image.rlike(KEY_PATTERN)


def key_supplier(image: Column) -> Column:
    """Supplier id written in the first path segment, NULL when not a number."""
    return F.split_part(image, F.lit("/"), F.lit(1)).try_cast("bigint")


def key_escapes_directory(image: Column) -> Column:
    return image.rlike(PARENT_SEGMENT) | F.startswith(image, F.lit("/"))


def key_extension(image: Column) -> Column:
    return F.lower(F.regexp_extract(image, r"\.([^./]*)$", 1))
