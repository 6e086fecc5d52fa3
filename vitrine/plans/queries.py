"""The registered queries of SURVEY section 2, each with its DuckDB oracle.

Parameters (page bounds, search text, supplier scope) are fixed per query so the
Spark result and the oracle can be compared; every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import filters, listing, summary
from vitrine.plans.registry import register
from vitrine.sources import snapshots
from vitrine.sources.fixtures import Catalogue

# Request parameters used by the registered queries.
PAGE_START = 20
PAGE_LENGTH = 20
PRODUCT_SEARCH = "Red"
USER_SEARCH = "nation_1"
VARIATION_SEARCH = "ori"
SUPPLIER_ID = 3

U, P, V = "users", "products", "product_variations"

# SQL fragments shared by several oracles.
SUPPLIER_LABEL_SQL = ("CASE WHEN u.id IS NULL THEN '-' ELSE coalesce(u.prenom, '') || ' ' || "
                      "coalesce(u.nom, '') || ' (' || coalesce(u.libelle, '') || ')' END")
PRODUCT_SEARCH_SQL = ("(lower(strip_accents(p.libelle)) LIKE '%{t}%' OR lower(strip_accents(p.description)) LIKE '%{t}%'"
                      " OR lower(strip_accents(u.nom)) LIKE '%{t}%' OR lower(strip_accents(u.prenom)) LIKE '%{t}%'"
                      " OR lower(strip_accents(u.libelle)) LIKE '%{t}%')").format(t=PRODUCT_SEARCH.lower())
USER_SEARCH_SQL = ("(lower(strip_accents(nom)) LIKE '%{t}%' OR lower(strip_accents(prenom)) LIKE '%{t}%'"
                   " OR lower(strip_accents(email)) LIKE '%{t}%' OR lower(strip_accents(libelle)) LIKE '%{t}%')"
                   ).format(t=USER_SEARCH.lower())
VARIATION_SEARCH_SQL = ("(lower(strip_accents(libelle)) LIKE '%{t}%' OR lower(strip_accents(reference)) LIKE '%{t}%'"
                        " OR attributs LIKE '%{raw}%')").format(t=VARIATION_SEARCH.lower(), raw=VARIATION_SEARCH)
ROLE_SQL = ("CASE WHEN role = 'ROLE_ADMIN' THEN 'Administrateur' ELSE 'Fournisseur' END AS role_label, "
            "CASE WHEN role = 'ROLE_ADMIN' THEN 'role-admin' ELSE 'role-fournisseur' END AS role_class")
SUMMARY_SQL = """SELECT product_id, CAST(coalesce(sum(stock), 0) AS BIGINT) AS stock_total,
       coalesce(CAST(max(prix_supplement) AS DOUBLE) > 0, false) AS has_price_supplement
FROM product_variations WHERE is_deleted = false"""


def cat(spark: SparkSession, sf_dir: str):
    """The catalogue under ``sf_dir``: stored snapshots when it holds them, else the
    views derived from the driver's source tables."""
    if snapshots.is_snapshot_root(spark, sf_dir):
        return snapshots.SnapshotCatalogue(spark, sf_dir)
    return Catalogue(spark, sf_dir)


# ---------------------------------------------------------------- scans (SRC)

@register("scan_users", "SELECT * FROM users", [U])
def scan_users(spark, sf_dir) -> DataFrame:
    return cat(spark, sf_dir).users


@register("scan_products", "SELECT * FROM products", [P])
def scan_products(spark, sf_dir) -> DataFrame:
    return cat(spark, sf_dir).products


@register("scan_variations", "SELECT * FROM product_variations", [V])
def scan_variations(spark, sf_dir) -> DataFrame:
    return cat(spark, sf_dir).product_variations


@register("lookup_products_by_id",
          "SELECT * FROM products WHERE id IN (SELECT id FROM product_updates)",
          [P, "product_updates"])
def lookup_products_by_id(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return filters.by_keys(c.products, c.product_updates.select("id"))


@register("missing_product_ids",
          "SELECT a.product_id AS id FROM (SELECT DISTINCT product_id FROM product_variations) a "
          "WHERE a.product_id NOT IN (SELECT id FROM products)",
          [P, V])
def missing_product_ids(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    keys = c.product_variations.select(F.col("product_id").alias("id")).distinct()
    return filters.missing_keys(keys, c.products)


@register("active_suppliers",
          "SELECT * FROM users WHERE role = 'ROLE_FOURNISSEUR' AND is_deleted = false", [U])
def active_suppliers(spark, sf_dir) -> DataFrame:
    return filters.active_suppliers(cat(spark, sf_dir).users)


@register("eligible_accounts", "SELECT * FROM users WHERE NOT coalesce(is_deleted, false)", [U])
def eligible_accounts(spark, sf_dir) -> DataFrame:
    return filters.eligible_accounts(cat(spark, sf_dir).users)


# ------------------------------------------------------------- filters (FLT)

@register("active_products_strict", "SELECT * FROM products WHERE is_deleted = false", [P])
def active_products_strict(spark, sf_dir) -> DataFrame:
    return filters.active_strict(cat(spark, sf_dir).products)


@register("active_products_lenient", "SELECT * FROM products WHERE NOT coalesce(is_deleted, false)", [P])
def active_products_lenient(spark, sf_dir) -> DataFrame:
    return filters.active_lenient(cat(spark, sf_dir).products)


@register("products_for_supplier",
          f"SELECT * FROM products WHERE is_deleted = false AND fournisseur_id = {SUPPLIER_ID}", [P])
def products_for_supplier(spark, sf_dir) -> DataFrame:
    return filters.for_supplier(filters.active_strict(cat(spark, sf_dir).products), SUPPLIER_ID)


@register("search_products", f"""
SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id
WHERE p.is_deleted = false AND {PRODUCT_SEARCH_SQL}""", [U, P])
def search_products(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_rows(listing.product_listing(c.products, c.users, PRODUCT_SEARCH))


@register("search_users", f"""
SELECT id, nom, prenom, email, role, CASE WHEN libelle IS NULL OR libelle IN ('', '0') THEN '-' ELSE libelle END AS libelle
FROM users WHERE is_deleted = false AND {USER_SEARCH_SQL}""", [U])
def search_users(spark, sf_dir) -> DataFrame:
    return listing.user_rows(listing.user_listing(cat(spark, sf_dir).users, USER_SEARCH))


@register("search_variations", f"""
SELECT * FROM product_variations WHERE is_deleted = false AND {VARIATION_SEARCH_SQL}""", [V])
def search_variations(spark, sf_dir) -> DataFrame:
    return listing.variation_listing(cat(spark, sf_dir).product_variations, None, VARIATION_SEARCH)


# ---------------------------------------------------------- projections/joins

@register("product_supplier_join", """
SELECT p.*, u.id AS u_id, u.nom AS u_nom, u.prenom AS u_prenom, u.email AS u_email, u.role AS u_role,
       u.libelle AS u_libelle, u.is_deleted AS u_is_deleted
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id""", [U, P])
def product_supplier_join(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_supplier_join(c.products, c.users)


@register("product_rows", f"""
SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id WHERE p.is_deleted = false""", [U, P])
def product_rows(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_rows(listing.product_listing(c.products, c.users))


@register("user_rows", """
SELECT id, nom, prenom, email, role, CASE WHEN libelle IS NULL OR libelle IN ('', '0') THEN '-' ELSE libelle END AS libelle
FROM users WHERE is_deleted = false""", [U])
def user_rows(spark, sf_dir) -> DataFrame:
    return listing.user_rows(listing.user_listing(cat(spark, sf_dir).users))


@register("user_role_labels", """
SELECT id, role, CASE WHEN role = 'ROLE_ADMIN' THEN 'Administrateur' ELSE 'Fournisseur' END AS role_label,
       CASE WHEN role = 'ROLE_ADMIN' THEN 'role-admin' ELSE 'role-fournisseur' END AS role_class
FROM users""", [U])
def user_role_labels(spark, sf_dir) -> DataFrame:
    return listing.role_labels(cat(spark, sf_dir).users)


@register("supplier_options", """
SELECT id, CASE WHEN libelle IS NOT NULL AND libelle NOT IN ('', '0') THEN coalesce(nom, '') || ' ' || coalesce(prenom, '') || ' (' || libelle || ')'
                ELSE coalesce(nom, '') || ' ' || coalesce(prenom, '') END AS label
FROM users WHERE role = 'ROLE_FOURNISSEUR' AND is_deleted = false""", [U])
def supplier_options(spark, sf_dir) -> DataFrame:
    return listing.supplier_options(cat(spark, sf_dir).users)


# ------------------------------------------------------------ aggregations

@register("stock_summary", SUMMARY_SQL + " GROUP BY product_id", [V])
def stock_summary(spark, sf_dir) -> DataFrame:
    return summary.stock_summary(cat(spark, sf_dir).product_variations)


@register("summaries_for_ids", SUMMARY_SQL + """
  AND product_id IN (SELECT p.id FROM products p WHERE p.fournisseur_id = 3) GROUP BY product_id""", [P, V])
def summaries_for_ids(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    ids = filters.for_supplier(c.products, SUPPLIER_ID).select("id")
    return summary.stock_summary(c.product_variations, ids)


@register("products_with_summary", f"""
WITH s AS ({SUMMARY_SQL} GROUP BY product_id)
SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur,
       CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock, coalesce(s.has_price_supplement, false) AS has_price_supplement
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id LEFT JOIN s ON s.product_id = p.id
WHERE p.is_deleted = false""", [U, P, V])
def products_with_summary(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    rows = listing.product_rows(listing.product_listing(c.products, c.users))
    return listing.with_summary(rows, summary.stock_summary(c.product_variations))


@register("count_products", "SELECT count(id) AS records_total FROM products WHERE is_deleted = false", [P])
def count_products(spark, sf_dir) -> DataFrame:
    return summary.count_active_products(cat(spark, sf_dir).products)


@register("count_products_by_supplier", """
SELECT fournisseur_id, count(id) AS records_total FROM products WHERE is_deleted = false GROUP BY fournisseur_id""", [P])
def count_products_by_supplier(spark, sf_dir) -> DataFrame:
    return summary.count_products_by_supplier(cat(spark, sf_dir).products)


@register("product_counts", f"""
SELECT count(*) AS records_total, CAST(count_if(coalesce({PRODUCT_SEARCH_SQL}, false)) AS BIGINT) AS records_filtered
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id WHERE p.is_deleted = false""", [U, P])
def product_counts(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_counts(c.products, c.users, PRODUCT_SEARCH)


@register("product_listing_envelope", f"""
SELECT count(*) AS records_total, CAST(count_if(coalesce({PRODUCT_SEARCH_SQL}, false)) AS BIGINT) AS records_filtered
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id WHERE p.is_deleted = false AND p.fournisseur_id = {SUPPLIER_ID}""",
          [U, P])
def product_listing_envelope(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_envelope(c.products, c.users, c.product_variations, PAGE_START, PAGE_LENGTH,
                                    PRODUCT_SEARCH, SUPPLIER_ID).counts


@register("product_listing_page", f"""
WITH page AS (
  SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur
  FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id
  WHERE p.is_deleted = false AND p.fournisseur_id = {SUPPLIER_ID} AND {PRODUCT_SEARCH_SQL} ORDER BY p.id DESC LIMIT 5),
s AS ({SUMMARY_SQL} AND product_id IN (SELECT id FROM page) GROUP BY product_id)
SELECT page.*, CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock,
       coalesce(s.has_price_supplement, false) AS has_price_supplement
FROM page LEFT JOIN s ON s.product_id = page.id""", [U, P, V])
def product_listing_page(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_envelope(c.products, c.users, c.product_variations, 0, listing.PRODUCT_GRID_LENGTH,
                                    PRODUCT_SEARCH, SUPPLIER_ID).page


@register("user_listing_envelope", f"""
SELECT count(*) AS records_total, CAST(count_if(coalesce({USER_SEARCH_SQL}, false)) AS BIGINT) AS records_filtered
FROM users WHERE is_deleted = false""", [U])
def user_listing_envelope(spark, sf_dir) -> DataFrame:
    return listing.user_envelope(cat(spark, sf_dir).users, 0, listing.USER_GRID_LENGTH, USER_SEARCH).counts


@register("user_listing_page", f"""
SELECT id, nom, prenom, email, role, CASE WHEN libelle IS NULL OR libelle IN ('', '0') THEN '-' ELSE libelle END AS libelle,
       {ROLE_SQL}
FROM users WHERE is_deleted = false AND {USER_SEARCH_SQL} ORDER BY id DESC LIMIT 15""", [U])
def user_listing_page(spark, sf_dir) -> DataFrame:
    return listing.user_envelope(cat(spark, sf_dir).users, 0, listing.USER_GRID_LENGTH, USER_SEARCH).page


@register("user_counts", f"""
SELECT count(*) AS records_total, CAST(count_if(coalesce({USER_SEARCH_SQL}, false)) AS BIGINT) AS records_filtered
FROM users WHERE is_deleted = false""", [U])
def user_counts(spark, sf_dir) -> DataFrame:
    return listing.user_counts(cat(spark, sf_dir).users, USER_SEARCH)


@register("variation_counts", f"""
SELECT product_id, count(*) AS records_total, CAST(count_if(coalesce({VARIATION_SEARCH_SQL}, false)) AS BIGINT) AS records_filtered
FROM product_variations WHERE is_deleted = false GROUP BY product_id""", [V])
def variation_counts(spark, sf_dir) -> DataFrame:
    return listing.variation_counts(cat(spark, sf_dir).product_variations, VARIATION_SEARCH)


# ---------------------------------------------------------------- pages (SRT)

@register("product_page", f"""
WITH page AS (
  SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur
  FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id
  WHERE p.is_deleted = false ORDER BY p.id DESC LIMIT {PAGE_LENGTH} OFFSET {PAGE_START}),
s AS ({SUMMARY_SQL} AND product_id IN (SELECT id FROM page) GROUP BY product_id)
SELECT page.*, CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock,
       coalesce(s.has_price_supplement, false) AS has_price_supplement
FROM page LEFT JOIN s ON s.product_id = page.id""", [U, P, V])
def product_page(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.product_page(c.products, c.users, c.product_variations, PAGE_START, PAGE_LENGTH)


DEEP_START = 1200  # beyond what a task may keep for a page


@register("product_page_deep", f"""
WITH page AS (
  SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL} AS fournisseur
  FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id
  WHERE p.is_deleted = false ORDER BY p.id DESC LIMIT {PAGE_LENGTH} OFFSET {DEEP_START}),
s AS ({SUMMARY_SQL} AND product_id IN (SELECT id FROM page) GROUP BY product_id)
SELECT page.*, CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock,
       coalesce(s.has_price_supplement, false) AS has_price_supplement
FROM page LEFT JOIN s ON s.product_id = page.id""", [U, P, V])
def product_page_deep(spark, sf_dir) -> DataFrame:
    """SRT-1 far from the start: the offset is located by counts per id range."""
    c = cat(spark, sf_dir)
    return listing.product_page(c.products, c.users, c.product_variations, DEEP_START, PAGE_LENGTH)


@register("user_page", f"""
SELECT id, nom, prenom, email, role, CASE WHEN libelle IS NULL OR libelle IN ('', '0') THEN '-' ELSE libelle END AS libelle,
       {ROLE_SQL}
FROM users WHERE is_deleted = false ORDER BY id DESC LIMIT 15 OFFSET 15""", [U])
def user_page(spark, sf_dir) -> DataFrame:
    return listing.user_page(cat(spark, sf_dir).users, 15, listing.USER_GRID_LENGTH)
