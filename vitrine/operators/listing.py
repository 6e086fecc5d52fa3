"""Listings: joins, row projections, ordering and pages (JOIN-1/2, PROJ-1..5,
SRT-1..6, SNK-1, SNK-4).

A page is ``orderBy(...).offset(start).limit(length)``, which Spark runs as
``TakeOrderedAndProject``: every task keeps only its best ``start + length`` rows,
so no full sort and no single-task gather of the table. Product and user pages far from the
start are located first, by counts per id range (``newest_first``), so that a page keeps few
rows however deep it is. Pages for *all* suppliers at once use the skew-safe row numbering in ``windows``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions import prices
from vitrine.functions.text import falsy_default, php_concat
from vitrine.operators import filters, summary
from vitrine.session import materialise

# Page sizes of the server and of the grids, the variation page
# bounds, and the text shown for a missing supplier / trade name / reference.
DEFAULT_LENGTH = 20
PRODUCT_GRID_LENGTH = 5
VARIATION_GRID_LENGTH = 5
USER_GRID_LENGTH = 15
VARIATION_MAX_LENGTH = 100
NO_SUPPLIER = "-"
NO_TRADE_NAME = "-"
NO_REFERENCE = "—"
ROLE_LABELS = {"ROLE_ADMIN": ("Administrateur", "role-admin")}
OTHER_ROLE_LABEL = ("Fournisseur", "role-fournisseur")

USER_COLUMNS = ["id", "nom", "prenom", "email", "role", "libelle", "is_deleted"]


def clamp_page(start: int, length: int, max_length: int | None = None) -> tuple[int, int]:
    """start >= 0 and 1 <= length (<= max_length when given)."""
    start = max(0, int(start))
    length = max(1, int(length))
    if max_length is not None:
        length = min(max_length, length)
    return start, length


#: Rows that a task may keep for a page; pages beyond are located by counts in RANGES id ranges.
SHALLOW = 1000
RANGES = 1024


def newest_first(df: DataFrame, start: int, length: int) -> DataFrame:
    """The rows from ``start`` on, in descending id order.

    A page near the start is taken from the rows as they are. For others the ids are counted in at most RANGES
    equal ranges, and the range that holds the offset is counted again in finer ones until it holds
    few rows; then the page is taken from that range and those that the page runs on to. Every
    count reads the id column alone, with the range as a filter of the scan.
    """
    newest = F.col("id").desc()
    if start + length <= SHALLOW:
        return df.orderBy(newest).offset(start).limit(length)
    ids = df.select("id")
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return df.limit(0)
    least, above = low, 0  # the least id of all; rows with ids over ``high``
    while True:
        width = max(1, -(-(high - low + 1) // RANGES))
        # a whole-number division; decimals, since ids may lie further apart than a long holds
        far = F.expr(f"(CAST({high} AS DECIMAL(38,0)) - CAST(id AS DECIMAL(38,0))) div CAST({width} AS DECIMAL(38,0))")
        counts = sorted(ids.filter(F.col("id").between(low, high)).groupBy(far.cast("long").alias("range")).count().collect())
        seen, held = above, None
        for at, n in counts:  # at most RANGES rows
            if seen + n > start:
                held = at, n
                break
            seen += n
        if held is None:
            return df.limit(0)  # the offset lies beyond the last row
        skip, wanted = start - seen, start + length
        if width == 1 or held[1] <= SHALLOW:
            running = accumulate((n for _, n in counts), initial=above)
            last = next((at for (at, _), after in zip(counts, islice(running, 1, None)) if after >= wanted), None)
            bottom = least if last is None else max(low, high - (last + 1) * width + 1)
            rows = df.filter(F.col("id").between(bottom, high - held[0] * width))
            return rows.orderBy(newest).offset(skip).limit(length)
        low, high, above = max(low, high - (held[0] + 1) * width + 1), high - held[0] * width, seen


def product_supplier_join(products: DataFrame, users: DataFrame) -> DataFrame:
    """Products with every column of their supplier (``u_*``); left outer join."""
    u = users.select(*[F.col(c).alias("u_" + c) for c in USER_COLUMNS])
    return products.join(u, products.fournisseur_id == u.u_id, "left")


def supplier_label() -> Column:
    """``"First Last (Trade)"`` with PHP concatenation, ``-`` when there is no supplier."""
    return (F.when(F.col("u_id").isNull(), F.lit(NO_SUPPLIER))
            .otherwise(php_concat(F.col("u_prenom"), " ", F.col("u_nom"), " (", F.col("u_libelle"), ")")))


def product_rows(joined: DataFrame) -> DataFrame:
    """PROJ-1: the list row of a product."""
    return joined.select("id", "libelle", "description", "image", "prix",
                         supplier_label().alias("fournisseur"))


def product_listing(products: DataFrame, users: DataFrame, search: str | None = None,
                    supplier_id: int | None = None, mode: str = "like") -> DataFrame:
    """Active (strict) products in scope, joined to their supplier, searched."""
    p = filters.for_supplier(filters.active_strict(products), supplier_id)
    joined = product_supplier_join(p, users)
    pred = filters.product_search_predicate(search, mode)
    return joined if pred is None else joined.filter(pred)


def with_summary(rows: DataFrame, summ: DataFrame) -> DataFrame:
    """JOIN-2: attach stock and supplement flag; a product without summary gets 0 / false."""
    return (rows.join(summ, rows.id == summ.product_id, "left")
            .drop("product_id")
            .withColumn("stock", F.coalesce(F.col("stock_total"), F.lit(0)).cast("bigint"))
            .withColumn("has_price_supplement", F.coalesce(F.col("has_price_supplement"), F.lit(False)))
            .drop("stock_total"))


def product_page(products: DataFrame, users: DataFrame, variations: DataFrame,
                 start: int = 0, length: int = DEFAULT_LENGTH, search: str | None = None,
                 supplier_id: int | None = None, mode: str = "like") -> DataFrame:
    """The product grid page: newest first, offset/limit, with stock summary.

    Without a search the page is cut from the products alone; it is written once
    (at most ``length`` rows), and users and variations are reduced by semi joins
    with its few keys before anything else happens to them. A search looks at the
    supplier's names too, so then the join comes first. The summary covers only the
    products on the page, as the reference does with its IN list.
    """
    start, length = clamp_page(start, length)
    newest = F.col("id").desc()
    if search:
        listing = product_listing(products, users, search, supplier_id, mode)
        rows = materialise(newest_first(product_rows(listing), start, length))
    else:
        scope = filters.for_supplier(filters.active_strict(products), supplier_id)
        page = materialise(newest_first(
            scope.select("id", "libelle", "description", "image", "prix", "fournisseur_id"), start, length))
        owners = filters.by_keys(users, page, key_column="fournisseur_id")
        rows = product_rows(product_supplier_join(page, owners))
    summ = summary.stock_summary(variations, rows.select("id") if search else page.select("id"))
    return with_summary(rows, summ).orderBy(newest)


def product_counts(products: DataFrame, users: DataFrame, search: str | None = None,
                   supplier_id: int | None = None, mode: str = "like") -> DataFrame:
    """``recordsTotal`` / ``recordsFiltered`` of the product grid in one pass."""
    p = filters.for_supplier(filters.active_strict(products), supplier_id)
    pred = filters.product_search_predicate(search, mode)
    if pred is not None:
        p = product_supplier_join(p, users)
    return summary.total_and_filtered(p, pred)


def catalogue_mart(products: DataFrame, users: DataFrame, variations: DataFrame) -> DataFrame:
    """SNK-4: every active product as a list row with its summary and display text.

    The summary is aggregated once for all products (partial + final hash
    aggregate) and joined on the product id.
    """
    return mart_rows(product_listing(products, users), summary.stock_summary(variations))


def mart_rows(listed: DataFrame, summ: DataFrame) -> DataFrame:
    """The mart's rows of listed products, with a given summary."""
    rows = listed.select("id", "libelle", "description", "image", "prix", supplier_label().alias("fournisseur"), "fournisseur_id")
    mart = with_summary(rows, summ)
    return mart.withColumn("prix_text", prices.listing_price_text(F.col("prix"), F.col("has_price_supplement")))


def write_catalogue_mart(mart: DataFrame, path: str, files_per_supplier_hint: int = 0) -> None:
    """Write the mart partitioned by supplier.

    Range-partitioning on (supplier, id) before the write gives each task a
    contiguous slice of suppliers, so a task writes few files, and a supplier
    with a third of all products is spread over many tasks instead of one.
    """
    parts = files_per_supplier_hint or mart.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (mart.repartitionByRange(int(parts), "fournisseur_id", "id")
     .write.mode("errorifexists").partitionBy("fournisseur_id").parquet(path))


def user_rows(users: DataFrame) -> DataFrame:
    """PROJ-2: user list row, trade name ``-`` when empty."""
    return users.select("id", "nom", "prenom", "email", "role",
                        falsy_default(F.col("libelle"), NO_TRADE_NAME).alias("libelle"))


def role_columns() -> list[Column]:
    """SCL-2: display name and badge class of a role."""
    label, klass = ROLE_LABELS["ROLE_ADMIN"]
    admin = F.col("role") == F.lit("ROLE_ADMIN")
    return [F.when(admin, F.lit(label)).otherwise(F.lit(OTHER_ROLE_LABEL[0])).alias("role_label"),
            F.when(admin, F.lit(klass)).otherwise(F.lit(OTHER_ROLE_LABEL[1])).alias("role_class")]


def role_labels(users: DataFrame) -> DataFrame:
    return users.select("id", "role", *role_columns())


def user_listing(users: DataFrame, search: str | None = None, mode: str = "like") -> DataFrame:
    u = filters.active_strict(users)
    pred = filters.user_search_predicate(search, mode)
    return u if pred is None else u.filter(pred)


def user_page(users: DataFrame, start: int = 0, length: int = DEFAULT_LENGTH,
              search: str | None = None, mode: str = "like") -> DataFrame:
    """The user grid page: newest first, each row with its role's label and class."""
    start, length = clamp_page(start, length)
    page = newest_first(user_rows(user_listing(users, search, mode)), start, length)
    return page.select("*", *role_columns())


def user_counts(users: DataFrame, search: str | None = None, mode: str = "like") -> DataFrame:
    return summary.total_and_filtered(filters.active_strict(users), filters.user_search_predicate(search, mode))


def supplier_options(users: DataFrame) -> DataFrame:
    """PROJ-4: choice label "Last First (Trade)" of active suppliers, trade part only when non-empty."""
    base = F.concat_ws(" ", F.coalesce(F.col("nom"), F.lit("")), F.coalesce(F.col("prenom"), F.lit("")))
    # the trade name is shown only when truthy in the template: NULL, '' and '0' are not
    truthy = F.col("libelle").isNotNull() & ~F.col("libelle").isin("", "0")
    label = F.when(truthy, F.concat(base, F.lit(" ("), F.col("libelle"), F.lit(")"))).otherwise(base)
    return filters.active_suppliers(users).select(F.col("id"), label.alias("label"))


# Whitelisted sort columns of the variation grid; anything else sorts by id.
VARIATION_SORTS = {0: "libelle", 2: "reference", 3: "prix_supplement", 4: "prix_supplement", 5: "stock"}
_COLLATED = {"libelle", "reference"}


def variation_sort(column_index: int | None, direction: str | None) -> list[Column]:
    """SRT-3: order expression for a grid request, with ``id`` as tie-break (T12)."""
    name = VARIATION_SORTS.get(int(column_index) if column_index is not None else 0, "id")
    desc = (direction or "asc").lower() == "desc"
    key = F.collate(F.col(name), "UNICODE_CI_AI") if name in _COLLATED else F.col(name)
    key = key.desc() if desc else key.asc()
    return [key] if name == "id" else [key, F.col("id").asc()]


def variation_rows(variations: DataFrame, products: DataFrame) -> DataFrame:
    """PROJ-3: variation list row with rendered attributes and final price."""
    p = products.select(F.col("id").alias("_pid"), F.col("prix").alias("_prix"))
    v = variations.join(p, variations.product_id == p._pid, "inner")
    return v.select(
        "id", "product_id", "libelle",
        attrs.attribute_text(F.col("attributs")).alias("attributs_text"),
        falsy_default(F.col("reference"), NO_REFERENCE).alias("reference"),
        F.col("prix_supplement"),
        prices.final_price_double(F.col("_prix"), F.col("prix_supplement")).alias("prix_final"),
        prices.final_price_decimal(F.col("_prix"), F.col("prix_supplement")).alias("prix_final_dec"),
        prices.supplement_text(F.col("prix_supplement")).alias("prix_supplement_text"),
        prices.price_text(F.col("_prix") + F.col("prix_supplement")).alias("prix_final_text"),
        "stock")


def variation_listing(variations: DataFrame, product_id: int | None, search: str | None = None,
                      mode: str = "like") -> DataFrame:
    v = filters.active_strict(variations)
    if product_id is not None:
        v = filters.of_parent(v, product_id)
    pred = filters.variation_search_predicate(search, mode)
    return v if pred is None else v.filter(pred)


def variation_page(variations: DataFrame, products: DataFrame, product_id: int, start: int = 0,
                   length: int = VARIATION_GRID_LENGTH, search: str | None = None,
                   order_column: int | None = 0, order_dir: str | None = "asc",
                   mode: str = "like") -> DataFrame:
    """One product's variation grid page (bounds clamped to 1..100)."""
    start, length = clamp_page(start, length, VARIATION_MAX_LENGTH)
    listing = variation_listing(variations, product_id, search, mode)
    page = listing.orderBy(*variation_sort(order_column, order_dir)).offset(start).limit(length)
    return variation_rows(page, filters.active_lenient(products))


def variation_counts(variations: DataFrame, search: str | None = None, mode: str = "like") -> DataFrame:
    """AGG-3: total and filtered active variations of every product."""
    return summary.total_and_filtered(filters.active_strict(variations),
                                      filters.variation_search_predicate(search, mode), ["product_id"])


def active_variations(variations: DataFrame, product_id: int) -> DataFrame:
    """SRT-4: a product's active variations, oldest first."""
    return filters.active_strict(filters.of_parent(variations, product_id)).orderBy("id")


class Envelope:
    """SNK-1: the counts and the page of a grid response (the page is planned on first use)."""

    def __init__(self, counts: DataFrame, page: Callable[[], DataFrame]):
        self.counts = counts
        self._page_fn = page
        self._page: DataFrame | None = None

    @property
    def page(self) -> DataFrame:
        if self._page is None:
            self._page = self._page_fn()
        return self._page

    def write(self, path: str) -> None:
        self.counts.coalesce(1).write.mode("errorifexists").json(f"{path}/counts")
        self.page.write.mode("errorifexists").json(f"{path}/data")


def product_envelope(products: DataFrame, users: DataFrame, variations: DataFrame, start: int = 0,
                     length: int = DEFAULT_LENGTH, search: str | None = None,
                     supplier_id: int | None = None, mode: str = "like") -> Envelope:
    return Envelope(product_counts(products, users, search, supplier_id, mode),
                    lambda: product_page(products, users, variations, start, length, search, supplier_id, mode))


def user_envelope(users: DataFrame, start: int = 0, length: int = DEFAULT_LENGTH, search: str | None = None,
                  mode: str = "like") -> Envelope:
    return Envelope(user_counts(users, search, mode), lambda: user_page(users, start, length, search, mode))


def variation_envelope(variations: DataFrame, products: DataFrame, product_id: int, start: int = 0,
                       length: int = VARIATION_GRID_LENGTH, search: str | None = None, order_column: int | None = 0,
                       order_dir: str | None = "asc", mode: str = "like") -> Envelope:
    """The response for one product's variation grid."""
    counts = summary.total_and_filtered(filters.active_strict(filters.of_parent(variations, product_id)),
                                        filters.variation_search_predicate(search, mode))
    return Envelope(counts, lambda: variation_page(variations, products, product_id, start, length, search,
                                                   order_column, order_dir, mode))
