"""Row filters (FLT-1..12) and key lookups (SRC-4, SRC-5).

All are narrow transformations except the semi/anti joins, whose key side is a
DataFrame (never a driver-side list), so a lookup of millions of ids stays a
distributed join; Spark broadcasts that side only when its measured size is
under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.attributes import parse_attributes
from vitrine.functions.text import binary_like_predicate, search_predicate

ROLE_ADMIN = "ROLE_ADMIN"
ROLE_SUPPLIER = "ROLE_FOURNISSEUR"


def is_active_strict(c: Column = None) -> Column:
    """``is_deleted = false``: a NULL flag is not active (T1, query form)."""
    return (F.col("is_deleted") if c is None else c) == F.lit(False)


def is_active_lenient(c: Column = None) -> Column:
    """``!isDeleted()``: a NULL flag counts as active (T1, object form)."""
    return ~F.coalesce(F.col("is_deleted") if c is None else c, F.lit(False))


def active_strict(df: DataFrame) -> DataFrame:
    return df.filter(is_active_strict())


def active_lenient(df: DataFrame) -> DataFrame:
    return df.filter(is_active_lenient())


def for_supplier(products: DataFrame, supplier_id: int | None) -> DataFrame:
    """Admin scope (None) sees every product, a supplier only its own."""
    if supplier_id is None:
        return products
    return products.filter(F.col("fournisseur_id") == F.lit(supplier_id))


def of_parent(variations: DataFrame, product_id: int) -> DataFrame:
    return variations.filter(F.col("product_id") == F.lit(product_id))


def by_keys(df: DataFrame, keys: DataFrame | Iterable[int], column: str = "id",
            key_column: str = "id") -> DataFrame:
    """Rows whose ``column`` is among ``keys``; an empty literal list gives no rows.

    A literal list becomes an ``IN`` filter that reaches the Parquet scan; a
    DataFrame of keys becomes a left-semi join.
    """
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(key_column).alias("__key")), F.col(column) == F.col("__key"), "left_semi")
    keys = list(keys)
    if not keys:
        return df.limit(0)
    return df.filter(F.col(column).isin(keys))


def missing_keys(keys: DataFrame, df: DataFrame, key_column: str = "id", column: str = "id") -> DataFrame:
    """Requested keys with no row in ``df`` (a ``find`` that returned null)."""
    return keys.join(df.select(F.col(column).alias("__key")), F.col(key_column) == F.col("__key"), "left_anti")


def active_suppliers(users: DataFrame, supplier_id: int | None = None) -> DataFrame:
    """``findBy(role = supplier, isDeleted = false)``, optionally one id."""
    out = users.filter((F.col("role") == ROLE_SUPPLIER) & is_active_strict())
    if supplier_id is not None:
        out = out.filter(F.col("id") == F.lit(supplier_id))
    return out


def eligible_accounts(users: DataFrame) -> DataFrame:
    """Accounts allowed to sign in: not soft-deleted."""
    return users.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def search(df: DataFrame, columns: list[str], term: str | None, mode: str = "like") -> DataFrame:
    pred = search_predicate([F.col(c) for c in columns], term, mode)
    return df if pred is None else df.filter(pred)


# Columns the product search looks at: product label and description, supplier
# last name, first name and trade name.
PRODUCT_SEARCH_COLUMNS = ["libelle", "description", "u_nom", "u_prenom", "u_libelle"]
USER_SEARCH_COLUMNS = ["nom", "prenom", "email", "libelle"]


def product_search_predicate(term: str | None, mode: str = "like") -> Column | None:
    return search_predicate([F.col(c) for c in PRODUCT_SEARCH_COLUMNS], term, mode)


def variation_search_predicate(term: str | None, mode: str = "like", raw_json: bool = True) -> Column | None:
    """Label and reference under the table collation; attributes as raw JSON text,
    case-sensitive, as the reference stores them (T5). ``raw_json=False`` searches
    the parsed attribute names and values under the collation instead. The
    search text is trimmed first; blank means no filter."""
    term = (term or "").strip(" \t\n\r\0\x0b")
    if term == "":
        return None
    pred = search_predicate([F.col("libelle"), F.col("reference")], term, mode)
    if raw_json:
        return pred | binary_like_predicate(F.col("attributs"), term)
    entries = F.map_entries(parse_attributes(F.col("attributs")))
    in_map = F.exists(entries, lambda e: search_predicate([e["key"], e["value"]], term, mode))
    return pred | in_map


def user_search_predicate(term: str | None, mode: str = "like") -> Column | None:
    return search_predicate([F.col(c) for c in USER_SEARCH_COLUMNS], term, mode)
