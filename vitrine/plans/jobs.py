"""Registered batch jobs: windows, relations, scalar functions, quality rules,
references, change-apply, images and schema evolution, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions import images, prices
from vitrine.operators import changes, evolve, filters, increments, listing, quality, references, relations, summary
from vitrine.operators.windows import page_numbers
from vitrine.plans import sqlparts as S
from vitrine.plans.queries import SUMMARY_SQL, SUPPLIER_LABEL_SQL, cat
from vitrine.plans.registry import QUERIES, register
from vitrine.session import ensure_checkpoint_dir, materialise
from vitrine.sources import assets as asset_audit
from vitrine.sources import parts, snapshots
from vitrine.sources.tables import raw

U, P, V = "users", "products", "product_variations"
PAGE_PRODUCT = 8           # product whose variation grid is paged
VARIATION_START = 0


# ------------------------------------------------------------------- windows

@register("supplier_pages", f"""
SELECT id, fournisseur_id, CAST(rn AS BIGINT) AS rn, CAST((rn - 1) // {listing.PRODUCT_GRID_LENGTH} AS BIGINT) AS page
FROM (SELECT id, fournisseur_id, row_number() OVER (PARTITION BY fournisseur_id ORDER BY id DESC) AS rn
      FROM products WHERE is_deleted = false)""", [P])
def supplier_pages(spark, sf_dir) -> DataFrame:
    p = filters.active_strict(cat(spark, sf_dir).products).select("id", "fournisseur_id")
    return page_numbers(p, ["fournisseur_id"], listing.PRODUCT_GRID_LENGTH)


_BASE = S.reference_base("product_id", "libelle")


@register("reference_sequence", f"""
WITH b AS (SELECT id, product_id, {_BASE} AS base_reference FROM product_variations
           WHERE reference IS NULL AND product_id IS NOT NULL),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id, base_reference ORDER BY id) AS BIGINT) AS seq FROM b)
SELECT id, product_id, base_reference, seq,
       CASE WHEN seq = 1 THEN base_reference
            ELSE substr(base_reference, 1, 100 - length(printf('-%02d', seq))) || printf('-%02d', seq) END
         AS candidate_reference
FROM s""", [V])
def reference_sequence(spark, sf_dir) -> DataFrame:
    return references.reference_sequence(cat(spark, sf_dir).product_variations)


@register("reference_base", f"""
SELECT id, product_id, {_BASE} AS base_reference FROM product_variations
WHERE reference IS NULL AND product_id IS NOT NULL""", [V])
def reference_base(spark, sf_dir) -> DataFrame:
    v = cat(spark, sf_dir).product_variations
    return (references.with_reference_base(v.filter(F.col("reference").isNull() & F.col("product_id").isNotNull()))
            .select("id", "product_id", "base_reference"))


def _counter_ctes(new_select: str) -> str:
    """CTEs ending in ``gen(id, product_id, reference)``: the k-th new row (by id) of a
    (product, base) takes the k-th candidate that no stored reference holds. The
    candidates are generated up to (new rows + stored references of that product).
    ``new_select`` yields ``id, pid, base``; stored references are those of the table."""
    return f"""new AS ({new_select}),
stored AS (SELECT upper(strip_accents(rtrim(reference))) AS ref FROM product_variations WHERE reference IS NOT NULL),
stored_pid AS (SELECT TRY_CAST(regexp_extract(ref, '^PRD-([0-9]+)-', 1) AS BIGINT) AS pid, count(*) AS n
               FROM stored GROUP BY 1),
grp AS (SELECT g.pid, g.base, g.n_new + coalesce(s.n, 0) AS n_cand
        FROM (SELECT pid, base, count(*) AS n_new FROM new GROUP BY pid, base) g
        LEFT JOIN stored_pid s ON s.pid = g.pid),
cand AS (SELECT pid, base, unnest(generate_series(1, n_cand)) AS n FROM grp),
named AS (SELECT pid, base, n, CASE WHEN n = 1 THEN base
                                    ELSE substr(base, 1, 100 - length(printf('-%02d', n))) || printf('-%02d', n) END AS c
          FROM cand),
free AS (SELECT pid, base, c, row_number() OVER (PARTITION BY pid, base ORDER BY n) AS r
         FROM named WHERE c NOT IN (SELECT ref FROM stored)),
ranked AS (SELECT id, pid, base, row_number() OVER (PARTITION BY pid, base ORDER BY id) AS k FROM new),
gen AS (SELECT ranked.id, ranked.pid AS product_id, free.c AS reference
        FROM ranked JOIN free ON free.pid = ranked.pid AND free.base = ranked.base AND free.r = ranked.k)"""


_ASSIGN_SQL = "WITH " + _counter_ctes(
    f"SELECT id, product_id AS pid, {_BASE} AS base FROM product_variations "
    "WHERE reference IS NULL AND product_id IS NOT NULL") + "\nSELECT id, product_id, reference FROM gen"


@register("assign_references", _ASSIGN_SQL, [V])
def assign_references(spark, sf_dir) -> DataFrame:
    return references.assign_references(cat(spark, sf_dir).product_variations)


# ----------------------------------------------------------- variation grids

_VROW = """v.id, v.product_id, v.libelle, {attr} AS attributs_text,
       CASE WHEN v.reference IS NULL OR v.reference IN ('', '0') THEN '—' ELSE v.reference END AS reference,
       v.prix_supplement, CAST(p.prix AS DOUBLE) + CAST(v.prix_supplement AS DOUBLE) AS prix_final,
       CAST(p.prix + v.prix_supplement AS DECIMAL(11,3)) AS prix_final_dec,
       '+' || CAST(CAST(v.prix_supplement AS DECIMAL(11,3)) AS VARCHAR) || ' TND' AS prix_supplement_text,
       CAST(CAST(p.prix + v.prix_supplement AS DECIMAL(11,3)) AS VARCHAR) || ' TND' AS prix_final_text,
       v.stock""".format(
    attr=S.attribute_text("v.attributs"))


def _variation_page_sql(order: str) -> str:
    return f"""
WITH page AS (SELECT * FROM product_variations WHERE product_id = {PAGE_PRODUCT} AND is_deleted = false
              ORDER BY {order} LIMIT {listing.VARIATION_GRID_LENGTH} OFFSET {VARIATION_START})
SELECT {_VROW} FROM page v JOIN products p ON p.id = v.product_id AND NOT coalesce(p.is_deleted, false)"""


@register("variation_page_by_label", _variation_page_sql("lower(strip_accents(libelle)), id"), [P, V])
def variation_page_by_label(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.variation_page(c.product_variations, c.products, PAGE_PRODUCT, VARIATION_START,
                                  listing.VARIATION_GRID_LENGTH, None, 0, "asc")


@register("variation_page_by_supplement", _variation_page_sql("prix_supplement DESC, id"), [P, V])
def variation_page_by_supplement(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.variation_page(c.product_variations, c.products, PAGE_PRODUCT, VARIATION_START,
                                  listing.VARIATION_GRID_LENGTH, None, 3, "desc")


@register("variation_page_clamped", f"""
WITH page AS (SELECT * FROM product_variations WHERE product_id = {PAGE_PRODUCT} AND is_deleted = false
              ORDER BY stock DESC, id LIMIT 100 OFFSET 0)
SELECT {_VROW} FROM page v JOIN products p ON p.id = v.product_id AND NOT coalesce(p.is_deleted, false)""", [P, V])
def variation_page_clamped(spark, sf_dir) -> DataFrame:
    """SRT-5: a request for 5,000 rows from -7 on gets the first 100."""
    c = cat(spark, sf_dir)
    return listing.variation_page(c.product_variations, c.products, PAGE_PRODUCT, -7, 5000, None, 5, "desc")


_GRID_SEARCH = ("(lower(strip_accents(libelle)) LIKE '%1-urgent%' OR lower(strip_accents(reference)) LIKE '%1-urgent%' "
                "OR attributs LIKE '%1-URGENT%')")


def _variation_response(spark, sf_dir) -> listing.Envelope:
    c = cat(spark, sf_dir)
    return listing.variation_envelope(c.product_variations, c.products, PAGE_PRODUCT, 0, 5, "1-URGENT", 0, "desc")


@register("variation_listing_envelope", f"""
SELECT count(*) AS records_total, CAST(count_if(coalesce({_GRID_SEARCH}, false)) AS BIGINT) AS records_filtered
FROM product_variations WHERE is_deleted = false AND product_id = {PAGE_PRODUCT}""", [V])
def variation_listing_envelope(spark, sf_dir) -> DataFrame:
    return _variation_response(spark, sf_dir).counts


@register("variation_listing_page", f"""
WITH page AS (SELECT * FROM product_variations WHERE product_id = {PAGE_PRODUCT} AND is_deleted = false AND {_GRID_SEARCH}
              ORDER BY lower(strip_accents(libelle)) DESC, id LIMIT 5)
SELECT {_VROW} FROM page v JOIN products p ON p.id = v.product_id AND NOT coalesce(p.is_deleted, false)""", [P, V])
def variation_listing_page(spark, sf_dir) -> DataFrame:
    return _variation_response(spark, sf_dir).page


@register("variation_rows", f"""
SELECT {_VROW} FROM product_variations v JOIN products p ON p.id = v.product_id AND NOT coalesce(p.is_deleted, false)
WHERE v.is_deleted = false""", [P, V])
def variation_rows(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.variation_rows(filters.active_strict(c.product_variations), filters.active_lenient(c.products))


@register("variations_of_product",
          f"SELECT * FROM product_variations WHERE product_id = {PAGE_PRODUCT} AND is_deleted = false", [V])
def variations_of_product(spark, sf_dir) -> DataFrame:
    return filters.active_strict(filters.of_parent(cat(spark, sf_dir).product_variations, PAGE_PRODUCT))


@register("active_variations",
          f"SELECT * FROM product_variations WHERE product_id = {PAGE_PRODUCT} AND is_deleted = false ORDER BY id", [V])
def active_variations(spark, sf_dir) -> DataFrame:
    return listing.active_variations(cat(spark, sf_dir).product_variations, PAGE_PRODUCT)


# ----------------------------------------------------------------- relations

_NESTED_SQL = """
SELECT p.id AS product_id, p.libelle AS product_libelle, p.is_deleted AS product_is_deleted,
       v.id AS variation_id, v.position, v.libelle AS v_libelle, v.attributs AS v_attributs,
       v.prix_supplement AS v_prix_supplement, v.stock AS v_stock, v.stock_utilise AS v_stock_utilise,
       v.reference AS v_reference, v.is_deleted AS v_is_deleted
FROM products p LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY id) AS BIGINT) AS position
                           FROM product_variations) v ON v.product_id = p.id"""


@register("products_nested_variations", _NESTED_SQL, [P, V])
def products_nested_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.products_with_variations(c.products, c.product_variations)


@register("nested_active_variations",
          f"SELECT * FROM ({_NESTED_SQL}) n WHERE variation_id IS NOT NULL AND NOT v_is_deleted", [P, V])
def nested_active_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.nested_active_variations(relations.products_with_variations(c.products, c.product_variations))


@register("nested_stock_total", """
SELECT p.id AS product_id, CAST(coalesce(sum(CASE WHEN NOT v.is_deleted THEN v.stock END), 0) AS BIGINT) AS stock_total
FROM products p LEFT JOIN product_variations v ON v.product_id = p.id GROUP BY p.id""", [P, V])
def nested_stock_total(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.nested_stock_total(relations.products_with_plain_variations(c.products, c.product_variations))


@register("total_stock", f"""
WITH s AS ({SUMMARY_SQL} GROUP BY product_id)
SELECT p.id AS product_id, CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock_total
FROM products p LEFT JOIN s ON s.product_id = p.id""", [P, V])
def total_stock(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return summary.stock_totals(c.products, c.product_variations)


@register("total_stock_of_product", f"""
SELECT CAST(coalesce(sum(stock), 0) AS BIGINT) AS stock_total FROM product_variations
WHERE is_deleted = false AND product_id = {PAGE_PRODUCT}""", [V])
def total_stock_of_product(spark, sf_dir) -> DataFrame:
    return summary.total_stock(cat(spark, sf_dir).product_variations, PAGE_PRODUCT)


@register("manageable_variations", """
SELECT v.*, p.fournisseur_id FROM product_variations v
JOIN products p ON p.id = v.product_id AND NOT coalesce(p.is_deleted, false)
WHERE NOT coalesce(v.is_deleted, false)""", [P, V])
def manageable_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.manageable_variations(c.product_variations, c.products)


@register("products_invalid_supplier", """
SELECT * FROM products WHERE fournisseur_id NOT IN
  (SELECT id FROM users WHERE role = 'ROLE_FOURNISSEUR' AND is_deleted = false)""", [U, P])
def products_invalid_supplier(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.products_invalid_supplier(c.products, c.users)


@register("orphan_variations",
          "SELECT * FROM product_variations WHERE product_id NOT IN (SELECT id FROM products)", [P, V])
def orphan_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.orphan_variations(c.product_variations, c.products)


@register("orphan_images", f"""
SELECT * FROM image_assets WHERE image_key NOT IN
  (SELECT {S.strip_prefix('image')} FROM products WHERE image IS NOT NULL)""", [P, "image_assets"])
def orphan_images(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.orphan_images(c.image_assets, c.products)


@register("access_matrix", """
SELECT a.event_id, a.user_id, a.product_id,
       (p.id IS NOT NULL AND u.id IS NOT NULL AND (u.role = 'ROLE_ADMIN' OR p.fournisseur_id IS NOT DISTINCT FROM a.user_id))
         AS allowed
FROM access_requests a LEFT JOIN products p ON p.id = a.product_id LEFT JOIN users u ON u.id = a.user_id""",
          [U, P, "access_requests"])
def access_matrix(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.access_matrix(c.access_requests, c.products, c.users)


@register("stale_products", """
SELECT * FROM products WHERE is_deleted = false AND fournisseur_id IN (SELECT id FROM users WHERE is_deleted = true)""",
          [U, P])
def stale_products(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.stale_products(c.products, c.users)


@register("stale_variations", """
SELECT * FROM product_variations WHERE is_deleted = false
  AND product_id IN (SELECT id FROM products WHERE is_deleted = true)""", [P, V])
def stale_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return relations.stale_variations(c.product_variations, c.products)


# -------------------------------------------------------------- scalar text

@register("variation_final_price", """
SELECT v.id, CAST(p.prix AS DOUBLE) + CAST(v.prix_supplement AS DOUBLE) AS prix_final,
       CAST(p.prix + v.prix_supplement AS DECIMAL(11,3)) AS prix_final_dec
FROM product_variations v JOIN products p ON p.id = v.product_id""", [P, V])
def variation_final_price(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    p = c.products.select(F.col("id").alias("pid"), "prix")
    v = c.product_variations
    return v.join(p, v.product_id == p.pid).select(
        "id", prices.final_price_double(F.col("prix"), F.col("prix_supplement")).alias("prix_final"),
        prices.final_price_decimal(F.col("prix"), F.col("prix_supplement")).alias("prix_final_dec"))


@register("price_text", f"""
WITH s AS ({SUMMARY_SQL} GROUP BY product_id)
SELECT p.id, CASE WHEN coalesce(s.has_price_supplement, false) THEN 'À partir de ' ELSE '' END
              || CAST(CAST(p.prix AS DECIMAL(11,3)) AS VARCHAR) || ' TND' AS prix_text,
       '+' || CAST(CAST(coalesce(s.max_supplement, 0) AS DECIMAL(11,3)) AS VARCHAR) || ' TND' AS max_supplement_text
FROM products p LEFT JOIN (SELECT product_id, has_price_supplement, max_supplement FROM s
  JOIN (SELECT product_id AS k, max(prix_supplement) AS max_supplement FROM product_variations
        WHERE is_deleted = false GROUP BY product_id) m ON m.k = s.product_id) s ON s.product_id = p.id""", [P, V])
def price_text(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    s = summary.stock_and_supplement(c.product_variations)
    p = c.products
    j = p.join(s, p.id == s.product_id, "left")
    flag = F.coalesce(F.col("has_price_supplement"), F.lit(False))
    return j.select("id", prices.listing_price_text(F.col("prix"), flag).alias("prix_text"),
                    prices.supplement_text(F.coalesce(F.col("max_supplement"), F.lit(0))).alias("max_supplement_text"))


@register("image_urls", f"""
SELECT id, CASE WHEN image IS NULL OR image = '' THEN {S.q(images.PLACEHOLDER)}
                ELSE {S.q(images.IMAGE_BASE + '/')} || regexp_replace(image, '^/', '') END AS image_url
FROM products""", [P])
def image_urls(spark, sf_dir) -> DataFrame:
    return cat(spark, sf_dir).products.select("id", images.image_url(F.col("image")).alias("image_url"))


@register("image_key_strip", f"SELECT id, {S.strip_prefix('image')} AS image FROM products", [P])
def image_key_strip(spark, sf_dir) -> DataFrame:
    return evolve.strip_image_prefix(cat(spark, sf_dir).products).select("id", "image")


@register("image_key_restore", f"""
SELECT id, CASE WHEN image IS NOT NULL AND NOT {S.has_legacy_prefix('image')}
                THEN {S.q(images.LEGACY_PREFIX)} || image ELSE image END AS image
FROM (SELECT id, {S.strip_prefix('image')} AS image FROM products)""", [P])
def image_key_restore(spark, sf_dir) -> DataFrame:
    p = evolve.strip_image_prefix(cat(spark, sf_dir).products)
    return evolve.restore_image_prefix(p).select("id", "image")


@register("attribute_text", f"SELECT id, {S.attribute_text('attributs')} AS attributs_text FROM product_variations", [V])
def attribute_text(spark, sf_dir) -> DataFrame:
    v = cat(spark, sf_dir).product_variations
    return v.select("id", attrs.attribute_text(F.col("attributs")).alias("attributs_text"))


@register("attributes_exploded", """
SELECT id, name, json_extract_string(attributs, '$."' || name || '"') AS value
FROM (SELECT id, attributs, unnest(json_keys(attributs)) AS name FROM product_variations)""", [V])
def attributes_exploded(spark, sf_dir) -> DataFrame:
    v = cat(spark, sf_dir).product_variations
    return (v.select("id", F.explode(attrs.parse_attributes(F.col("attributs"))).alias("name", "value")))


_VALUE_AT_I = """json_extract_string(attributs, '$."' || names[i] || '"')"""


def _pairs_ctes(rows: str = "SELECT id, attributs FROM variation_changes") -> str:
    """CTEs ending in ``pj(id, attributes_json)``: the attribute object of each change
    row with names and values trimmed, blank pairs dropped, first spelling kept."""
    return f"""src AS (
  SELECT id, attributs, CASE WHEN NOT json_valid(attributs) THEN [] WHEN json_type(attributs) = 'OBJECT'
                             THEN json_keys(attributs) ELSE [] END AS names
  FROM ({rows})),
zipped AS (
  SELECT id, list_transform(range(1, len(names) + 1), lambda i: {{
           'name': {S.php_trim('names[i]')},
           'value': {S.php_trim(_VALUE_AT_I)}}})
         AS pairs
  FROM src),
kept AS (SELECT id, list_filter(pairs, lambda p: p.name <> '' AND p.value <> '') AS kept FROM zipped),
firsts AS (
  SELECT id, list_filter(kept, lambda p, i: NOT list_contains(
           list_transform(list_slice(kept, 1, i - 1), lambda q: lower(q.name)), lower(p.name))) AS firsts
  FROM kept),
pj AS (
  SELECT id, CASE WHEN len(firsts) = 0 THEN '[]' ELSE '{{' || coalesce(array_to_string(list_transform(firsts, lambda p:
           CAST(to_json(p.name) AS VARCHAR) || ':' || CAST(to_json(p.value) AS VARCHAR)), ','), '') || '}}' END
           AS attributes_json
  FROM firsts)"""


_PAIRS_SQL = "WITH " + _pairs_ctes("SELECT id, attributs FROM variation_forms") + "\nSELECT id, attributes_json FROM pj"


def _clean_label(c: str, p: str) -> str:
    """The label of a change: its own, else its cleaned attribute values, else the product's label."""
    return (f"CASE WHEN {S.php_trim(f'{c}.libelle')} <> '' THEN {S.php_trim(f'{c}.libelle')} "
            f"WHEN coalesce(len(firsts.firsts), 0) = 0 THEN coalesce({p}.libelle, '') "
            "ELSE array_to_string(list_transform(firsts.firsts, lambda x: x.value), ' - ') END")


@register("normalise_attributes", _PAIRS_SQL, ["variation_forms"])
def normalise_attributes(spark, sf_dir) -> DataFrame:
    """Form arrays taken from the posted attribute objects, cleaned (SCL-11), as the
    JSON text that is stored."""
    forms = cat(spark, sf_dir).variation_forms
    m = attrs.parse_attributes(F.col("attributs"))
    clean = attrs.normalise_pairs(F.map_keys(m), F.map_values(m))
    return forms.select("id", attrs.stored_attributes(clean).alias("attributes_json"))


@register("variation_default_label", f"""
WITH {_pairs_ctes("SELECT id, attributs FROM variation_forms")}
SELECT c.id, {_clean_label('c', 'p')} AS libelle
FROM variation_forms c JOIN firsts ON firsts.id = c.id LEFT JOIN products p ON p.id = c.product_id""",
          [P, "variation_forms"])
def variation_default_label(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return quality.normalise_variation_changes(c.variation_forms, c.products).select("id", "libelle")


@register("normalise_products", f"""
SELECT id, {S.php_trim('libelle')} AS libelle, {S.php_trim('description')} AS description, {S.norm_price('prix')} AS prix
FROM product_intake""", ["product_intake"])
def normalise_products(spark, sf_dir) -> DataFrame:
    return quality.normalise_products(cat(spark, sf_dir).product_intake).select("id", "libelle", "description", "prix")


@register("normalise_prices", f"""
SELECT id, prix, {S.parse_price('prix')} AS prix_value, coalesce({S.price_ok('prix')}, false) AS prix_valid
FROM (SELECT id, {S.norm_price('prix')} AS prix FROM product_intake)""", ["product_intake"])
def normalise_prices(spark, sf_dir) -> DataFrame:
    n = quality.normalise_products(cat(spark, sf_dir).product_intake)
    return n.select("id", "prix", prices.parse_price(F.col("prix")).alias("prix_value"),
                    F.coalesce(prices.price_matches_pattern(F.col("prix")), F.lit(False)).alias("prix_valid"))


@register("normalise_stock", f"""
SELECT id, stock AS stock_text, {S.php_int('stock')} AS stock FROM product_intake""", ["product_intake"])
def normalise_stock(spark, sf_dir) -> DataFrame:
    return quality.normalise_products(cat(spark, sf_dir).product_intake).select("id", "stock_text", "stock")


@register("normalise_users", f"""
SELECT id, {S.php_trim('nom')} AS nom, {S.php_trim('prenom')} AS prenom, {S.php_trim('email')} AS email,
       coalesce(role, '') AS role, CASE WHEN role = 'ROLE_FOURNISSEUR' THEN {S.php_trim('libelle')} END AS libelle
FROM user_changes""", ["user_changes"])
def normalise_users(spark, sf_dir) -> DataFrame:
    return quality.normalise_users(cat(spark, sf_dir).user_changes)


# --------------------------------------------------------------- data quality

def _intake_norm(rows: str) -> str:
    return f"""SELECT i.id, i.seq, {S.php_trim('i.libelle')} AS libelle, {S.php_trim('i.description')} AS description,
       {S.norm_price('i.prix')} AS prix, i.product_type, {S.php_int('i.stock')} AS stock,
       CASE WHEN a.role = 'ROLE_FOURNISSEUR' THEN i.actor_id ELSE i.fournisseur_id END AS fournisseur_id,
       s.id AS sid, a.role AS arole, st.id AS stored, i.image
FROM ({rows}) i LEFT JOIN (SELECT id FROM users WHERE role = 'ROLE_FOURNISSEUR' AND is_deleted = false) s
  ON s.id = i.fournisseur_id
LEFT JOIN (SELECT id, role FROM users WHERE NOT coalesce(is_deleted, false)) a ON a.id = i.actor_id
LEFT JOIN products st ON st.id = i.id"""


_INTAKE_NORM = _intake_norm("SELECT * FROM product_intake")
_INTAKE_RULES = [
    ("id", S.MSG["product_stored"], "stored IS NOT NULL"),
    ("product_type", S.MSG["type_invalid"], "coalesce(product_type, '') NOT IN ('standard', 'variations')"),
    ("stock", S.MSG["stock_not_integer"], "stock IS NULL"),
    ("stock", S.MSG["stock_negative"], "product_type = 'standard' AND stock < 0"),
    *S.product_rules("libelle", "description", "prix"),
    ("fournisseur", S.MSG["supplier_invalid"], "arole = 'ROLE_ADMIN' AND sid IS NULL"),
    ("fournisseur", S.MSG["add_denied"], "coalesce(arole, '') NOT IN ('ROLE_ADMIN', 'ROLE_FOURNISSEUR')"),
    ("image", S.MSG["image_invalid"], f"image IS NOT NULL AND NOT {S.image_key_ok('image', 'fournisseur_id')}"),
]


@register("dq_intake", f"SELECT id, {S.report(_INTAKE_RULES)} FROM ({_INTAKE_NORM})", [U, P, "product_intake"])
def dq_intake(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return quality.flat_report(quality.validate_intake(c.product_intake, c.users, c.products))


@register("dq_products", f"""
SELECT id, {S.report(S.product_rules('libelle', 'description', 'prix'))} FROM ({_INTAKE_NORM})""",
          [U, P, "product_intake"])
def dq_products(spark, sf_dir) -> DataFrame:
    return quality.flat_report(quality.validate_products(cat(spark, sf_dir).product_intake))


@register("dq_prices", f"""
SELECT id, prix, {S.parse_price('prix')} AS prix_value,
       CASE WHEN {S.blank('prix')} THEN 'blank' WHEN NOT {S.price_ok('prix')} THEN 'pattern'
            WHEN {S.parse_price('prix')} IS NULL THEN 'range' ELSE 'ok' END AS price_status
FROM (SELECT id, {S.norm_price('prix')} AS prix FROM product_intake)""", ["product_intake"])
def dq_prices(spark, sf_dir) -> DataFrame:
    n = quality.normalise_products(cat(spark, sf_dir).product_intake)
    prix = F.col("prix")
    value = prices.parse_price(prix)
    status = (F.when(quality.blank(prix), F.lit("blank")).when(~prices.price_matches_pattern(prix), F.lit("pattern"))
              .when(value.isNull(), F.lit("range")).otherwise(F.lit("ok")))
    return n.select("id", "prix", value.alias("prix_value"), status.alias("price_status"))


_VAR_RULES = S.variation_rules("libelle", "CAST(prix_supplement AS VARCHAR)", "stock", "stock_utilise", "reference") + [
    ("attributs", S.MSG["attributes_invalid"],
     "NOT (regexp_replace(attributs, '\\s', '', 'g') = '[]' OR (json_valid(attributs) AND json_type(attributs) = 'OBJECT'))")]


@register("dq_variations", f"SELECT id, {S.report(_VAR_RULES)} FROM product_variations", [V])
def dq_variations(spark, sf_dir) -> DataFrame:
    return quality.flat_report(quality.validate_variations(cat(spark, sf_dir).product_variations))


_USER_NORM = f"""SELECT c.id, c.seq, {S.php_trim('c.nom')} AS nom, {S.php_trim('c.prenom')} AS prenom,
       {S.php_trim('c.email')} AS email, coalesce(c.role, '') AS role,
       CASE WHEN c.role = 'ROLE_FOURNISSEUR' THEN {S.php_trim('c.libelle')} END AS libelle
FROM user_changes c"""
_TAKEN = (f"EXISTS (SELECT 1 FROM users u WHERE {S.fold_key('u.email')} = {S.fold_key('n.email')} "
          "AND (n.id IS NULL OR u.id <> n.id))")
_USER_RULES = S.user_rules("n.nom", "n.prenom", "n.email", "n.role", "n.libelle", _TAKEN)


@register("dq_users", f"SELECT n.id, {S.report(_USER_RULES)} FROM ({_USER_NORM}) n", [U, "user_changes"])
def dq_users(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return quality.flat_report(quality.validate_user_rows(c.user_changes, c.users))


@register("dq_supplier_label",
          f"SELECT * FROM users WHERE role = 'ROLE_FOURNISSEUR' AND {S.php_trim('libelle')} = ''", [U])
def dq_supplier_label(spark, sf_dir) -> DataFrame:
    return quality.supplier_label_missing(cat(spark, sf_dir).users)


@register("duplicate_emails", f"""
SELECT u.id, u.email, d.n_same FROM users u JOIN
  (SELECT {S.fold_key('email')} AS k, count(*) AS n_same FROM users GROUP BY 1 HAVING count(*) > 1) d
  ON d.k = {S.fold_key('u.email')}""", [U])
def duplicate_emails(spark, sf_dir) -> DataFrame:
    return quality.duplicate_emails(cat(spark, sf_dir).users)


@register("email_availability", f"""
SELECT n.id, n.email, NOT {_TAKEN} AS available FROM email_candidates n""", [U, "email_candidates"])
def email_availability(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return (quality.email_usage(c.email_candidates, c.users)
            .select("id", "email", (~F.col("email_taken")).alias("available")))


@register("duplicate_references", """
SELECT upper(strip_accents(rtrim(reference))) AS reference_key, count(*) AS n_rows FROM product_variations
WHERE reference IS NOT NULL GROUP BY 1 HAVING count(*) > 1""", [V])
def duplicate_references(spark, sf_dir) -> DataFrame:
    return quality.duplicate_references(cat(spark, sf_dir).product_variations)


def _null_profile_sql() -> str:
    parts = []
    for table, cols in quality.NOT_NULL_COLUMNS.items():
        for col in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{col}' AS column_name, "
                         f"CAST(count_if({col} IS NULL) AS BIGINT) AS null_count FROM {table}")
    return "\nUNION ALL ".join(parts)


@register("null_profile", _null_profile_sql(), [U, P, V])
def null_profile(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return quality.null_profile({"users": c.users, "products": c.products, "product_variations": c.product_variations})


@register("image_asset_audit", f"""
SELECT image_key, length, mime, mime IN ('image/jpeg', 'image/png', 'image/webp') AS mime_ok,
       length <= {images.MAX_BYTES} AS size_ok,
       lower(regexp_extract(image_key, '\\.([^./]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp') AS extension_ok,
       (mime IN ('image/jpeg', 'image/png', 'image/webp') AND length <= {images.MAX_BYTES}
        AND lower(regexp_extract(image_key, '\\.([^./]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp')) AS valid
FROM image_assets""", ["image_assets"])
def image_asset_audit(spark, sf_dir) -> DataFrame:
    return asset_audit.audit_assets(cat(spark, sf_dir).image_assets)


@register("image_key_audit", f"""
SELECT id, fournisseur_id, image, well_formed, supplier_match, escapes_directory,
       CASE WHEN escapes_directory OR NOT well_formed THEN 'error' WHEN NOT supplier_match THEN 'warning' ELSE 'ok' END
         AS status
FROM (SELECT id, fournisseur_id, image, regexp_matches(image, {S.q(images.KEY_PATTERN)}) AS well_formed,
             coalesce(TRY_CAST(split_part(image, '/', 1) AS BIGINT) = fournisseur_id, false) AS supplier_match,
             regexp_matches(image, {S.q(images.PARENT_SEGMENT)}) OR starts_with(image, '/') AS escapes_directory
      FROM products WHERE image IS NOT NULL)""", [P])
def image_key_audit(spark, sf_dir) -> DataFrame:
    return asset_audit.audit_image_keys(cat(spark, sf_dir).products)


# ------------------------------------------------------------- change-apply

_P_COLS = "id, libelle, description, image, prix, fournisseur_id"
_V_COLS = "id, product_id, libelle, attributs, prix_supplement, stock, stock_utilise, reference"
_U_COLS = "id, nom, prenom, email, role, libelle"


_PDEL_CHECK = f"""SELECT d.id, CASE WHEN p.id IS NULL THEN 'Produit introuvable.'
       WHEN a.id IS NULL OR coalesce(a.is_deleted, false) THEN 'Ce compte est désactivé.'
       WHEN a.role <> 'ROLE_ADMIN' AND p.fournisseur_id IS DISTINCT FROM d.actor_id
         THEN 'Vous ne pouvez pas supprimer ce produit.' END AS reason
FROM (SELECT DISTINCT id, actor_id FROM product_deletes) d LEFT JOIN products p ON p.id = d.id
LEFT JOIN users a ON a.id = d.actor_id"""


@register("apply_product_deletes", f"""
SELECT {_P_COLS}, CASE WHEN id IN (SELECT id FROM ({_PDEL_CHECK}) WHERE reason IS NULL) THEN true ELSE is_deleted END
  AS is_deleted FROM products""", [U, P, "product_deletes"])
def apply_product_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_product_deletes(c.products, c.users, c.product_deletes).snapshot


@register("rejected_product_deletes", f"SELECT id, reason FROM ({_PDEL_CHECK}) WHERE reason IS NOT NULL",
          [U, P, "product_deletes"])
def rejected_product_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_product_deletes(c.products, c.users, c.product_deletes).rejected


@register("apply_user_deletes", f"""
SELECT {_U_COLS}, CASE WHEN id IN (SELECT id FROM user_deletes) THEN true ELSE is_deleted END AS is_deleted
FROM users""", [U, "user_deletes"])
def apply_user_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_user_deletes(c.users, c.user_deletes).snapshot


@register("rejected_user_deletes", """
SELECT DISTINCT id, 'user_not_found' AS reason FROM user_deletes WHERE id NOT IN (SELECT id FROM users)""",
          [U, "user_deletes"])
def rejected_user_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_user_deletes(c.users, c.user_deletes).rejected


_VDEL_CHECK = """SELECT d.id, v.product_id,
       CASE WHEN a.id IS NULL OR coalesce(a.is_deleted, false) THEN 'Ce compte est désactivé.'
            WHEN v.id IS NULL OR coalesce(v.is_deleted, false) THEN 'Variation introuvable.'
            WHEN p.id IS NULL OR coalesce(p.is_deleted, false) THEN 'Produit introuvable.'
            WHEN a.role <> 'ROLE_ADMIN' AND p.fournisseur_id IS DISTINCT FROM d.actor_id
              THEN 'Vous ne pouvez pas gérer les variations de ce produit.' END AS reason
FROM (SELECT DISTINCT id, actor_id FROM variation_deletes) d LEFT JOIN product_variations v ON v.id = d.id
LEFT JOIN products p ON p.id = v.product_id LEFT JOIN users a ON a.id = d.actor_id"""


@register("apply_variation_deletes", f"""
SELECT {_V_COLS}, CASE WHEN id IN (SELECT id FROM ({_VDEL_CHECK}) WHERE reason IS NULL) THEN true ELSE is_deleted END
  AS is_deleted FROM product_variations""", [U, P, V, "variation_deletes"])
def apply_variation_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_variation_deletes(c.product_variations, c.products, c.users, c.variation_deletes).snapshot


@register("rejected_variation_deletes", f"SELECT id, reason FROM ({_VDEL_CHECK}) WHERE reason IS NOT NULL",
          [U, P, V, "variation_deletes"])
def rejected_variation_deletes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_variation_deletes(c.product_variations, c.products, c.users, c.variation_deletes).rejected


@register("refreshed_stock", f"""
WITH acc AS (SELECT id, product_id FROM ({_VDEL_CHECK}) WHERE reason IS NULL),
snap AS (SELECT product_id, stock, CASE WHEN id IN (SELECT id FROM acc) THEN true ELSE is_deleted END AS is_deleted
         FROM product_variations)
SELECT t.product_id, CAST(coalesce(sum(CASE WHEN s.is_deleted = false THEN s.stock END), 0) AS BIGINT) AS stock_total
FROM (SELECT DISTINCT product_id FROM acc) t LEFT JOIN snap s ON s.product_id = t.product_id
GROUP BY t.product_id""", [U, P, V, "variation_deletes"])
def refreshed_stock(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.stock_after_deletes(c.product_variations, c.products, c.users, c.variation_deletes)


# the first row of an id that passes by itself adds the product; later rows of the id find it stored
_INTAKE_JUDGED = f"""WITH alone AS (
  SELECT *, coalesce({S.first_message(_INTAKE_RULES)},
                     CASE WHEN product_type = 'standard' AND id + 4398046511104 IN (SELECT id FROM product_variations)
                          THEN {S.q(S.MSG['product_stored'])} END) AS own
  FROM ({_INTAKE_NORM}))
SELECT alone.*, CASE WHEN EXISTS (SELECT 1 FROM alone e WHERE e.id = alone.id AND e.seq < alone.seq AND e.own IS NULL)
                     THEN {S.q(S.MSG['product_stored'])} ELSE own END AS reason
FROM alone"""
_INTAKE_OK = f"SELECT * FROM ({_INTAKE_JUDGED}) WHERE reason IS NULL"


@register("intake_products", f"""
SELECT id, libelle, description, image, {S.parse_price('prix')} AS prix, fournisseur_id,
       false AS is_deleted FROM ({_INTAKE_OK})""", [U, P, V, "product_intake"])
def intake_products(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.intake(c.product_intake, c.users, c.products, c.product_variations)[0]


@register("rejected_intake", f"SELECT id, seq, reason FROM ({_INTAKE_JUDGED}) WHERE reason IS NOT NULL",
          [U, P, V, "product_intake"])
def rejected_intake(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.intake(c.product_intake, c.users, c.products, c.product_variations)[2]


@register("intake_default_variations", f"""
WITH {_counter_ctes("SELECT id + 4398046511104 AS id, id AS pid, " + S.reference_base("id", "libelle")
                    + f" AS base FROM ({_INTAKE_OK}) WHERE product_type = 'standard'")}
SELECT i.id + 4398046511104 AS id, i.id AS product_id, i.libelle, '[]' AS attributs,
       CAST(0 AS DECIMAL(10,3)) AS prix_supplement, i.stock, CAST(0 AS BIGINT) AS stock_utilise, gen.reference,
       false AS is_deleted
FROM ({_INTAKE_OK}) i LEFT JOIN gen ON gen.product_id = i.id WHERE i.product_type = 'standard'""",
          [U, P, V, "product_intake"])
def intake_default_variations(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.intake_default_variations(c.product_intake, c.users, c.products, c.product_variations)


# by itself, then with the owner that the change meets: the supplier of the last admin change before it that passes
_PU_CHECK = f"""WITH x AS (
  SELECT u.id, u.seq, u.actor_id, coalesce(u.remove_image, false) AS remove_image, u.new_image, {S.php_trim('u.libelle')} AS libelle,
         {S.php_trim('u.description')} AS description, {S.norm_price('u.prix')} AS prix,
         u.fournisseur_id AS req_fournisseur_id, p.id AS old_id, p.fournisseur_id AS old_fournisseur_id,
         p.image AS old_image, coalesce(a.role = 'ROLE_ADMIN', false) AS is_admin,
         a.id IS NULL OR coalesce(a.is_deleted, false) AS no_account,
         u.fournisseur_id IN (SELECT id FROM users WHERE role = 'ROLE_FOURNISSEUR' AND is_deleted = false) AS supplier_ok
  FROM product_updates u LEFT JOIN products p ON p.id = u.id LEFT JOIN users a ON a.id = u.actor_id),
alone AS (
  SELECT *, CASE WHEN old_id IS NULL THEN 'Produit introuvable.' WHEN no_account THEN 'Ce compte est désactivé.' END AS early,
    CASE WHEN {S.first_message(S.product_rules('libelle', 'description', 'prix'))} IS NOT NULL
           THEN {S.first_message(S.product_rules('libelle', 'description', 'prix'))}
         WHEN is_admin AND NOT supplier_ok THEN {S.q(S.MSG['supplier_invalid'])}
         WHEN new_image IS NOT NULL AND NOT {S.image_key_ok('new_image',
             "CASE WHEN is_admin THEN req_fournisseur_id ELSE actor_id END")} THEN {S.q(S.MSG['image_invalid'])} END AS late
  FROM x),
met AS (
  SELECT n.*, coalesce((SELECT arg_max(e.req_fournisseur_id, e.seq) FROM alone e
                        WHERE e.id = n.id AND e.seq < n.seq AND e.is_admin AND e.early IS NULL AND e.late IS NULL),
                       n.old_fournisseur_id) AS owner
  FROM alone n)
SELECT *, CASE WHEN early IS NOT NULL THEN early
               WHEN NOT is_admin AND owner IS DISTINCT FROM actor_id THEN 'Vous ne pouvez pas modifier ce produit.'
               ELSE late END AS reason,
       new_image IS NOT NULL OR remove_image AS moves_image
FROM met"""


@register("apply_product_updates", f"""
WITH good AS (SELECT * FROM ({_PU_CHECK}) WHERE reason IS NULL),
ok AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
im AS (SELECT * FROM good WHERE moves_image QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT p.id,
       CASE WHEN ok.id IS NOT NULL THEN ok.libelle ELSE p.libelle END AS libelle,
       CASE WHEN ok.id IS NOT NULL THEN ok.description ELSE p.description END AS description,
       CASE WHEN im.id IS NOT NULL THEN im.new_image ELSE p.image END AS image,
       CASE WHEN ok.id IS NOT NULL THEN {S.parse_price('ok.prix')} ELSE p.prix END AS prix,
       CASE WHEN ok.id IS NULL THEN p.fournisseur_id WHEN ok.is_admin THEN ok.req_fournisseur_id ELSE ok.actor_id END
         AS fournisseur_id,
       p.is_deleted
FROM products p LEFT JOIN ok ON ok.id = p.id LEFT JOIN im ON im.id = p.id""", [U, P, "product_updates"])
def apply_product_updates(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_product_updates(c.products, c.users, c.product_updates).snapshot


@register("replaced_image_keys", f"""
SELECT id, was AS image FROM (
  SELECT id, new_image, CASE WHEN row_number() OVER w = 1 THEN old_image ELSE lag(new_image) OVER w END AS was
  FROM ({_PU_CHECK}) WHERE reason IS NULL AND moves_image WINDOW w AS (PARTITION BY id ORDER BY seq))
WHERE coalesce(was, '') <> '' AND was IS DISTINCT FROM new_image""", [U, P, "product_updates"])
def replaced_image_keys(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.replaced_image_keys(changes.apply_product_updates(c.products, c.users, c.product_updates))


@register("rejected_product_updates", f"SELECT id, seq, reason FROM ({_PU_CHECK}) WHERE reason IS NOT NULL",
          [U, P, "product_updates"])
def rejected_product_updates(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_product_updates(c.products, c.users, c.product_updates).rejected


def _vc_judged(rows: str) -> str:
    """Every change of ``rows`` by itself, with the product that ``rows`` gives for an insert."""
    return f"""SELECT *, coalesce(early, {S.first_message(S.variation_rules(
        'libelle', 'sup_text', 'stock', 'stock_utilise', 'old_ref'))}) AS reason FROM (
SELECT c.id, c.seq, v.id IS NOT NULL AS is_stored, coalesce(v.product_id, c.product_id) AS product_id,
       {_clean_label('c', 'p')} AS libelle, c.id * 10 + c.seq AS rid,
       {S.norm_price('c.prix_supplement')} AS sup_text, {S.php_int('c.stock')} AS stock,
       CAST(coalesce(v.stock_utilise, 0) AS BIGINT) AS stock_utilise, v.reference AS old_ref,
       CASE WHEN v.id IS NULL AND c.id >= 4398046511104
              THEN 'Variation ids from 4398046511104 on belong to default variations.'
            WHEN a.id IS NULL OR coalesce(a.is_deleted, false) THEN 'Ce compte est désactivé.'
            WHEN v.id IS NOT NULL AND coalesce(v.is_deleted, false) THEN 'Variation introuvable.'
            WHEN p.id IS NULL OR coalesce(p.is_deleted, false) THEN 'Produit introuvable.'
            WHEN a.role <> 'ROLE_ADMIN' AND p.fournisseur_id IS DISTINCT FROM c.actor_id
              THEN 'Vous ne pouvez pas gérer les variations de ce produit.'
            WHEN NOT {S.readable_attributes('c.attributs')} THEN {S.q(S.MSG['attributes_invalid'])}
            WHEN {S.php_int('c.stock')} IS NULL THEN {S.q(S.MSG['stock_not_integer'])} END AS early
FROM ({rows}) c LEFT JOIN product_variations v ON v.id = c.id
LEFT JOIN products p ON p.id = coalesce(v.product_id, c.product_id)
LEFT JOIN users a ON a.id = c.actor_id LEFT JOIN firsts ON firsts.id = c.id * 10 + c.seq)"""


# the first change of a new id that passes inserts it; later ones are judged with the product of that row
_VC_CTES = f"""{_pairs_ctes('SELECT id * 10 + seq AS id, attributs FROM variation_changes')},
alone AS ({_vc_judged('SELECT * FROM variation_changes')}),
inserts AS (SELECT id, product_id, seq FROM alone WHERE reason IS NULL AND NOT is_stored
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
checked AS ({_vc_judged("""SELECT c.* REPLACE (CASE WHEN i.seq < c.seq THEN i.product_id ELSE c.product_id END AS product_id)
                           FROM variation_changes c LEFT JOIN inserts i ON i.id = c.id""")})"""
_APPLY_VC_SQL = f"""WITH {_VC_CTES},
acc AS (SELECT *, first_value(libelle) OVER (PARTITION BY id ORDER BY seq) AS first_label FROM checked WHERE reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
{_counter_ctes("SELECT id, product_id AS pid, " + S.reference_base("product_id", "first_label")
               + " AS base FROM acc WHERE old_ref IS NULL")}
SELECT {_V_COLS}, is_deleted FROM product_variations WHERE id NOT IN (SELECT id FROM acc)
UNION ALL
SELECT acc.id, acc.product_id, acc.libelle, pj.attributes_json AS attributs,
       {S.parse_price('acc.sup_text')} AS prix_supplement, acc.stock, acc.stock_utilise,
       coalesce(acc.old_ref, gen.reference) AS reference, false AS is_deleted
FROM acc LEFT JOIN pj ON pj.id = acc.rid LEFT JOIN gen ON gen.id = acc.id"""


@register("apply_variation_changes", _APPLY_VC_SQL, [U, P, V, "variation_changes"])
def apply_variation_changes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_variation_changes(c.product_variations, c.products, c.users, c.variation_changes).snapshot


@register("rejected_variation_changes", f"""WITH {_VC_CTES}
SELECT id, seq, reason FROM checked WHERE reason IS NOT NULL""", [U, P, V, "variation_changes"])
def rejected_variation_changes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    checked = changes.check_variation_changes(c.product_variations, c.products, c.users, c.variation_changes)
    return checked.filter(F.col("reason").isNotNull()).select("id", "seq", "reason")


def _new_root(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"


_ROWS_OF = """SELECT 'users' AS table_name, id, md5(concat_ws('|', nom, prenom, email, role, libelle, is_deleted)) AS content FROM ({users})
UNION ALL SELECT 'products', id, md5(concat_ws('|', libelle, description, image, prix, fournisseur_id, is_deleted)) FROM ({products})
UNION ALL SELECT 'product_variations', id, md5(concat_ws('|', product_id, libelle, attributs, prix_supplement, stock, stock_utilise,
                                                         reference, is_deleted)) FROM ({variations})"""


def _stored_rows(catalogue) -> DataFrame:
    """Every row of a stored version's three tables, its fields as one digest."""
    def rows(name: str, *fields: str) -> DataFrame:
        df = getattr(catalogue, name)
        return df.select(F.lit(name).alias("table_name"), "id", F.md5(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]))
                         .alias("content"))
    return (rows("users", "nom", "prenom", "email", "role", "libelle", "is_deleted")
            .unionByName(rows("products", "libelle", "description", "image", "prix", "fournisseur_id", "is_deleted"))
            .unionByName(rows("product_variations", "product_id", "libelle", "attributs", "prix_supplement", "stock", "stock_utilise",
                              "reference", "is_deleted")))


@register("stored_after_intake", _ROWS_OF.format(
    users="SELECT * FROM users",
    products=f"""SELECT * FROM products UNION ALL
SELECT id, libelle, description, image, {S.parse_price('prix')} AS prix, fournisseur_id, false AS is_deleted FROM ({_INTAKE_OK})""",
    variations=f"SELECT * FROM product_variations UNION ALL SELECT * FROM ({QUERIES['intake_default_variations'].sql})"),
          [U, P, V, "product_intake"])
def stored_after_intake(spark, sf_dir) -> DataFrame:
    """SNK-2: users, products and variations as read back from the written and published version."""
    c = cat(spark, sf_dir)
    root = _new_root(spark)
    changes.write_intake(c.product_intake, c, root)
    return _stored_rows(cat(spark, root))


@register("stored_after_updates", _ROWS_OF.format(
    users="SELECT * FROM users", products=QUERIES["apply_product_updates"].sql, variations="SELECT * FROM product_variations"),
          [U, P, V, "product_updates"])
def stored_after_updates(spark, sf_dir) -> DataFrame:
    """SNK-3: users, products and variations as read back from the written and published version."""
    c = cat(spark, sf_dir)
    root = _new_root(spark)
    changes.write_change_result(changes.apply_product_updates(c.products, c.users, c.product_updates), "products", c, root)
    return _stored_rows(cat(spark, root))


# The batch as a loop, one change after another: ``held`` has every account with its address so far.
_NOT_TAKEN = S.user_rules("n.nom", "n.prenom", "n.email", "n.role", "n.libelle", "false")
_HELD_BY_OTHER = "len(list_filter(run.held, lambda h: h.k = n.k AND h.id <> n.id)) > 0"
_UC_CTES = f"""RECURSIVE alone AS (
  SELECT n.*, {S.first_message(_NOT_TAKEN)} AS own, {S.fold_key('n.email')} AS k,
         row_number() OVER (ORDER BY n.seq, n.id) AS place FROM ({_USER_NORM}) n),
run AS (
  SELECT CAST(0 AS BIGINT) AS place, false AS taken,
         (SELECT list({{'id': id, 'k': {S.fold_key('email')}}}) FROM users) AS held
  UNION ALL
  SELECT n.place, {_HELD_BY_OTHER} AS taken,
         CASE WHEN n.own IS NULL AND NOT ({_HELD_BY_OTHER})
              THEN list_append(list_filter(run.held, lambda h: h.id <> n.id), {{'id': n.id, 'k': n.k}}) ELSE run.held END AS held
  FROM run JOIN alone n ON n.place = run.place + 1),
judged AS (SELECT alone.*, CASE WHEN run.taken THEN {S.q(S.MSG['email_taken'])} ELSE own END AS reason
           FROM alone JOIN run ON run.place = alone.place)"""


@register("apply_user_changes", f"""
WITH {_UC_CTES},
ok AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT {_U_COLS}, is_deleted FROM users WHERE id NOT IN (SELECT id FROM ok)
UNION ALL
SELECT ok.id, ok.nom, ok.prenom, ok.email, ok.role, ok.libelle, coalesce(u.is_deleted, false) AS is_deleted
FROM ok LEFT JOIN users u ON u.id = ok.id""", [U, "user_changes"])
def apply_user_changes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_user_changes(c.users, c.user_changes).snapshot


@register("rejected_user_changes", f"WITH {_UC_CTES}\nSELECT id, seq, reason FROM judged WHERE reason IS NOT NULL",
          [U, "user_changes"])
def rejected_user_changes(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return changes.apply_user_changes(c.users, c.user_changes).rejected


# ---------------------------------------------------------------- evolution

@register("evolve_users", f"SELECT {_U_COLS}, false AS is_deleted FROM users", [U])
def evolve_users(spark, sf_dir) -> DataFrame:
    v1 = cat(spark, sf_dir).users.drop("is_deleted")
    return evolve.add_user_deleted_flag(v1)


@register("evolve_prices", """
SELECT CAST(p_partkey AS BIGINT) + 1 AS id, TRY_CAST(p_retailprice AS DECIMAL(10,3)) AS prix,
       p_retailprice IS NOT NULL AND TRY_CAST(p_retailprice AS DECIMAL(10,3)) IS NULL AS prix_overflow
FROM part""")
def evolve_prices(spark, sf_dir) -> DataFrame:
    v1 = raw(spark, sf_dir, "part", "p_partkey", "p_retailprice").select(
        (F.col("p_partkey").cast("bigint") + 1).alias("id"), F.col("p_retailprice").alias("prix"))
    return evolve.price_to_decimal(v1).select("id", "prix", "prix_overflow")


@register("evolve_descriptions", """
SELECT id, concat(repeat(description, 20), ' ', libelle) AS description,
       CAST(length(concat(repeat(description, 20), ' ', libelle)) AS BIGINT) AS n_chars FROM products""", [P])
def evolve_descriptions(spark, sf_dir) -> DataFrame:
    """EVO-2: descriptions beyond the old 255 characters go through a stored version whole."""
    c = cat(spark, sf_dir)
    root = _new_root(spark)
    longer = c.products.withColumn("description", F.concat(F.repeat("description", F.lit(20)), F.lit(" "), F.col("libelle")))
    snapshots.next_version(c, root, {"products": longer})
    return cat(spark, root).products.select("id", "description", F.length("description").cast("bigint").alias("n_chars"))


@register("evolve_variations", f"""
SELECT id, product_id, libelle, attributs, prix_supplement, stock, CAST(0 AS BIGINT) AS stock_utilise, reference,
       is_deleted FROM product_variations""", [V])
def evolve_variations(spark, sf_dir) -> DataFrame:
    v1 = cat(spark, sf_dir).product_variations.drop("stock_utilise")
    return evolve.add_used_stock(v1)


@register("catalogue_mart", f"""
WITH s AS ({SUMMARY_SQL} GROUP BY product_id)
SELECT p.id, p.libelle, p.description, p.image, p.prix, {SUPPLIER_LABEL_SQL}
         AS fournisseur, p.fournisseur_id,
       CAST(coalesce(s.stock_total, 0) AS BIGINT) AS stock, coalesce(s.has_price_supplement, false) AS has_price_supplement,
       CASE WHEN coalesce(s.has_price_supplement, false) THEN 'À partir de ' ELSE '' END
         || CAST(CAST(p.prix AS DECIMAL(11,3)) AS VARCHAR) || ' TND' AS prix_text
FROM products p LEFT JOIN users u ON p.fournisseur_id = u.id LEFT JOIN s ON s.product_id = p.id
WHERE p.is_deleted = false""", [U, P, V])
def catalogue_mart(spark, sf_dir) -> DataFrame:
    c = cat(spark, sf_dir)
    return listing.catalogue_mart(c.products, c.users, c.product_variations)



_CHANGED_MART = QUERIES["catalogue_mart"].sql.strip().removeprefix("WITH").replace("FROM product_variations", "FROM changed")


@register("catalogue_mart_after_changes", f"""
WITH changed AS ({_APPLY_VC_SQL}), {_CHANGED_MART}""", [U, P, V, "variation_changes"])
def catalogue_mart_after_changes(spark, sf_dir) -> DataFrame:
    """SNK-4 kept up to date: the stored mart and summary state, brought to the state after the variation changes by
    rewriting the partitions that those touch, and read back."""
    c = cat(spark, sf_dir)
    root = _new_root(spark)
    parts.write(listing.catalogue_mart(c.products, c.users, c.product_variations), f"{root}/mart-1", "fournisseur_id")
    increments.write_state(c.product_variations, f"{root}/state-1")
    changed = materialise(changes.apply_variation_changes(c.product_variations, c.products, c.users, c.variation_changes).accepted)
    change = materialise(increments.delta(increments.rows_before(c.product_variations, changed), changed))
    increments.update_state(spark, f"{root}/state-1", change, f"{root}/state-2")
    increments.update_mart(spark, f"{root}/mart-1", c.products, c.users, increments.read_state(spark, f"{root}/state-2"), change,
                           f"{root}/mart-2")
    return parts.read(spark, f"{root}/mart-2", "fournisseur_id")


@register("refreshed_summary", f"""
WITH changed AS ({_APPLY_VC_SQL}),
moved AS (SELECT product_id, prix_supplement, count(*) AS n, sum(stock) AS stock FROM product_variations WHERE is_deleted = false GROUP BY ALL
          EXCEPT SELECT product_id, prix_supplement, count(*), sum(stock) FROM changed WHERE is_deleted = false GROUP BY ALL),
came AS (SELECT product_id, prix_supplement, count(*) AS n, sum(stock) AS stock FROM changed WHERE is_deleted = false GROUP BY ALL
         EXCEPT SELECT product_id, prix_supplement, count(*), sum(stock) FROM product_variations WHERE is_deleted = false GROUP BY ALL)
SELECT t.product_id, CAST(coalesce(sum(c.stock), 0) AS BIGINT) AS stock_total,
       coalesce(CAST(max(c.prix_supplement) AS DOUBLE) > 0, false) AS has_price_supplement
FROM (SELECT product_id FROM moved UNION SELECT product_id FROM came) t
LEFT JOIN changed c ON c.product_id = t.product_id AND c.is_deleted = false GROUP BY t.product_id""", [U, P, V, "variation_changes"])
def refreshed_summary(spark, sf_dir) -> DataFrame:
    """AGG-9 after variation changes: stock and supplement flag of the touched products, from the summary's state."""
    c = cat(spark, sf_dir)
    changed = materialise(changes.apply_variation_changes(c.product_variations, c.products, c.users, c.variation_changes).accepted)
    change = materialise(increments.delta(increments.rows_before(c.product_variations, changed), changed))
    return increments.refreshed_summary(increments.summary_state(c.product_variations), change)
