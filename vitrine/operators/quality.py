"""Normalisation and validation of incoming rows (SCL-9..18, DQ-1..19).

Each rule is a boolean column. ``violations`` collects every failing rule of a
row as ``struct(path, message)`` in declaration order, so a batch keeps all
problems while ``first_message`` is what the reference would answer. Rules are
row-local except the uniqueness rules, which are aggregations + joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions import images, prices
from vitrine.functions.text import fold_key, php_trim
from vitrine.operators import filters, membership

# The messages of the entity rules and of the intake checks, the
# maximum lengths, the allowed product types and roles, and the HTML5 e-mail
# pattern of the e-mail rule.
MAX_LABEL = 255
MAX_REFERENCE = 100
PRODUCT_TYPES = ("standard", "variations")
ROLES = ("ROLE_ADMIN", "ROLE_FOURNISSEUR")
EMAIL_PATTERN = (r"^[a-zA-Z0-9.!#$%&'*+\/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
                 r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$")
MSG = {
    "product_label_blank": "Le libellé est obligatoire.",
    "label_too_long": "Le libellé ne peut pas dépasser 255 caractères.",
    "description_blank": "La description est obligatoire.",
    "price_blank": "Le prix est obligatoire.",
    "price_pattern": "Le prix doit être un nombre avec au maximum 3 décimales.",
    "price_negative": "Le prix doit être positif ou égal à zéro.",
    "variation_label_blank": "Le libellé de la variation est obligatoire.",
    "supplement_blank": "Le supplément de prix est obligatoire.",
    "supplement_pattern": "Le supplément doit être un nombre avec au maximum 3 décimales.",
    "supplement_negative": "Le supplément de prix doit être positif ou égal à zéro.",
    "stock_negative": "Le stock doit être positif ou égal à zéro.",
    "used_stock_negative": "Le stock utilisé doit être positif ou égal à zéro.",
    "reference_too_long": "La référence ne peut pas dépasser 100 caractères.",
    "last_name_blank": "Le nom est obligatoire.",
    "first_name_blank": "Le prénom est obligatoire.",
    "too_long": "This value is too long. It should have 255 characters or less.",
    "email_blank": "L’email est obligatoire.",
    "email_invalid": "L’adresse email est invalide.",
    "role_invalid": "Le rôle sélectionné est invalide.",
    "email_taken": "Cet email est déjà utilisé.",
    "trade_name_blank": "Le libellé du fournisseur est obligatoire.",
    "type_invalid": "Le type de produit sélectionné est invalide.",
    "stock_not_integer": "Le stock doit être un nombre entier.",
    "supplier_invalid": "Le fournisseur sélectionné est invalide.",
    "price_range": "Le prix dépasse la valeur maximale.",
    "supplement_range": "Le supplément de prix dépasse la valeur maximale.",
    "product_stored": "Ce produit est déjà enregistré.",
    "add_denied": "Vous ne pouvez pas ajouter de produit.",
    "image_invalid": "L’image doit être au format JPEG, PNG ou WebP et ne pas dépasser 5 Mo.",
    "attributes_invalid": "Les caractéristiques ne sont pas un objet JSON.",
}

_INT_TEXT = r"^[+-]?(0|[1-9][0-9]*)$"


def blank(c: Column) -> Column:
    """NotBlank: NULL or ''."""
    return c.isNull() | (c == "")


def too_long(c: Column, limit: int) -> Column:
    """Length(max): skipped for NULL and ''."""
    return F.coalesce(F.length(c) > limit, F.lit(False))


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def violations(rules: list[tuple[str, str, Column]]) -> Column:
    """Array of failing rules, in the given order."""
    items = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(msg).alias("message")))
             for path, msg, bad in rules]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def with_violations(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    v = violations(rules)
    return (df.withColumn("violations", v)
            .withColumn("n_violations", F.size("violations").cast("bigint"))
            .withColumn("first_message", F.get(F.col("violations"), 0)["message"]))


def flat_report(df: DataFrame, key: str = "id") -> DataFrame:
    """The part of a validation result that SQL can compare: counts, first message, paths."""
    return df.select(key, "n_violations", "first_message",
                     F.array_join(F.transform("violations", lambda x: x["path"]), ",").alias("paths"))


# ------------------------------------------------------------- normalisation

def php_int(c: Column) -> Column:
    """``getInt``: an integer text (PHP whitespace allowed around it), else NULL."""
    t = php_trim(c)
    return F.when(t.rlike(_INT_TEXT), t.try_cast("bigint"))


def normalise_products(intake: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """SCL-9, SCL-10, SCL-17: trimmed texts, decimal comma fixed, stock as integer. ``keep`` names columns passed on."""
    return intake.select(
        "id",
        php_trim(F.col("libelle")).alias("libelle"),
        php_trim(F.col("description")).alias("description"),
        prices.normalise_price_text(F.col("prix")).alias("prix"),
        F.col("product_type"),
        F.col("stock").alias("stock_text"),
        php_int(F.col("stock")).alias("stock"),
        "fournisseur_id", "actor_id", "image", *keep)


def normalise_users(changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """SCL-9, SCL-13: trimmed names and e-mail; trade name kept only for suppliers. ``keep`` names columns passed on."""
    role = F.coalesce(F.col("role"), F.lit(""))
    return changes.select(
        "id",
        php_trim(F.col("nom")).alias("nom"),
        php_trim(F.col("prenom")).alias("prenom"),
        php_trim(F.col("email")).alias("email"),
        role.alias("role"),
        F.when(role == "ROLE_FOURNISSEUR", php_trim(F.col("libelle"))).alias("libelle"), *keep)


def attributes_readable(attributs: Column) -> Column:
    """A change gives no attributes (NULL), the empty list, or an object."""
    return F.coalesce(attrs.attributes_valid(attributs), attributs.isNull())


def normalise_variation_changes(changes: DataFrame, products: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """SCL-10..12: attributes cleaned, default label, decimal comma fixed, stock as integer.

    ``products`` provides the label used when neither a label nor attributes are given; ``keep`` names columns passed on.
    """
    parsed = attrs.parse_attributes(F.col("attributs"))
    clean = attrs.normalise_pairs(F.map_keys(parsed), F.map_values(parsed))
    p = products.select(F.col("id").alias("__pid"), F.col("libelle").alias("__plabel"))
    staged = changes.join(p, changes.product_id == p.__pid, "left").withColumn("__attrs", clean)
    return (staged
            .select("id", "product_id",
                    attrs.default_label(F.col("libelle"), F.col("__attrs"), F.col("__plabel")).alias("libelle"),
                    attrs.stored_attributes(F.col("__attrs")).alias("attributs"),
                    attributes_readable(F.col("attributs")).alias("attributs_ok"),
                    prices.normalise_price_text(F.col("prix_supplement")).alias("prix_supplement"),
                    php_int(F.col("stock")).alias("stock"), *keep))


# ------------------------------------------------------------------ rule sets

def product_rules(libelle: Column, description: Column, prix: Column) -> list[tuple[str, str, Column]]:
    """DQ-1..3, in declaration order; ``prix`` is the normalised text."""
    return [
        ("libelle", MSG["product_label_blank"], blank(libelle)),
        ("libelle", MSG["label_too_long"], too_long(libelle, MAX_LABEL)),
        ("description", MSG["description_blank"], blank(description)),
        ("prix", MSG["price_blank"], blank(prix)),
        ("prix", MSG["price_pattern"], filled(prix) & ~prices.price_matches_pattern(prix)),
        ("prix", MSG["price_negative"], prices.php_negative(prix)),
        ("prix", MSG["price_range"], prices.price_out_of_range(prix)),
    ]


def variation_rules(libelle: Column, supplement: Column, stock: Column, used_stock: Column,
                    reference: Column) -> list[tuple[str, str, Column]]:
    """DQ-4..7; ``supplement`` is the normalised text."""
    return [
        ("libelle", MSG["variation_label_blank"], blank(libelle)),
        ("libelle", MSG["label_too_long"], too_long(libelle, MAX_LABEL)),
        ("prixSupplement", MSG["supplement_blank"], blank(supplement)),
        ("prixSupplement", MSG["supplement_pattern"], filled(supplement) & ~prices.price_matches_pattern(supplement)),
        ("prixSupplement", MSG["supplement_negative"], prices.php_negative(supplement)),
        ("prixSupplement", MSG["supplement_range"], prices.price_out_of_range(supplement)),
        ("stock", MSG["stock_negative"], stock < 0),
        ("stockUtilise", MSG["used_stock_negative"], used_stock < 0),
        ("reference", MSG["reference_too_long"], too_long(reference, MAX_REFERENCE)),
    ]


def user_rules(nom: Column, prenom: Column, email: Column, role: Column, libelle: Column,
               email_taken: Column) -> list[tuple[str, str, Column]]:
    """DQ-8..12: class rules (unique e-mail, supplier trade name) first, then fields."""
    return [
        ("email", MSG["email_taken"], email_taken),
        ("libelle", MSG["trade_name_blank"], (role == "ROLE_FOURNISSEUR") & (php_trim(libelle) == "")),
        ("nom", MSG["last_name_blank"], blank(nom)),
        ("nom", MSG["too_long"], too_long(nom, MAX_LABEL)),
        ("prenom", MSG["first_name_blank"], blank(prenom)),
        ("prenom", MSG["too_long"], too_long(prenom, MAX_LABEL)),
        ("email", MSG["email_blank"], blank(email)),
        ("email", MSG["email_invalid"], filled(email) & ~email.rlike(EMAIL_PATTERN)),
        ("role", MSG["role_invalid"], role.isNotNull() & ~role.isin(*ROLES)),
    ]


# ---------------------------------------------------------------- validators

def validate_products(intake: DataFrame) -> DataFrame:
    """DQ-1..3 on normalised intake rows."""
    n = normalise_products(intake)
    return with_violations(n, product_rules(F.col("libelle"), F.col("description"), F.col("prix")))


def image_key_allowed(image: Column, supplier_id: Column) -> Column:
    """DQ-20..22 on a new key: its shape and type, inside the folder of the product's supplier."""
    return (images.key_well_formed(image) & ~images.key_escapes_directory(image)
            & F.coalesce(images.key_supplier(image) == supplier_id, F.lit(False)))


def validate_intake(intake: DataFrame, users: DataFrame, products: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole intake check in the reference's order: product type (DQ-14), stock
    (DQ-15), entity rules (DQ-1..3), supplier (DQ-16), image (DQ-20..22).

    An admin names an active supplier; a supplier becomes the owner of what it
    adds (``fournisseur_id`` of the result), and nobody else may add. An id that
    is stored already is refused first: intake only adds rows.
    """
    n = normalise_products(intake, keep)
    sup = filters.active_suppliers(users).select(F.col("id").alias("__sid"))
    actors = filters.eligible_accounts(users).select(F.col("id").alias("__aid"), F.col("role").alias("__arole"))
    stored = products.select(F.col("id").alias("__stored"))
    n = (n.join(sup, n.fournisseur_id == sup.__sid, "left").join(actors, n.actor_id == actors.__aid, "left")
         .join(stored, n.id == stored.__stored, "left"))
    is_admin = F.coalesce(F.col("__arole") == filters.ROLE_ADMIN, F.lit(False))
    is_supplier = F.coalesce(F.col("__arole") == filters.ROLE_SUPPLIER, F.lit(False))
    n = n.withColumn("fournisseur_id", F.when(is_supplier, F.col("actor_id")).otherwise(F.col("fournisseur_id")))
    rules = [
        ("id", MSG["product_stored"], F.col("__stored").isNotNull()),
        ("product_type", MSG["type_invalid"], ~F.coalesce(F.col("product_type"), F.lit("")).isin(*PRODUCT_TYPES)),
        ("stock", MSG["stock_not_integer"], F.col("stock").isNull()),
        ("stock", MSG["stock_negative"], (F.col("product_type") == "standard") & (F.col("stock") < 0)),
        *product_rules(F.col("libelle"), F.col("description"), F.col("prix")),
        ("fournisseur", MSG["supplier_invalid"], is_admin & F.col("__sid").isNull()),
        ("fournisseur", MSG["add_denied"], ~is_admin & ~is_supplier),
        ("image", MSG["image_invalid"],
         F.col("image").isNotNull() & ~image_key_allowed(F.col("image"), F.col("fournisseur_id"))),
    ]
    return with_violations(n, rules).drop("__sid", "__aid", "__arole", "__stored")


def email_usage(candidates: DataFrame, users: DataFrame, cand_id: str = "id") -> DataFrame:
    """Candidates with ``email_taken``: another user (any id but the candidate's own,
    deleted users included) has the same e-mail under the table collation.

    Of the users only possible holders of an address of the candidates go on (``membership``). They
    are reduced to one row per e-mail key (row count and smallest id, a partial/final aggregate), so a very common address never makes the
    join emit or buffer all its rows: with unique ids, the key is taken for a
    candidate when it has more than one user, or one user whose id differs.
    """
    c = candidates.withColumn("__ckey", fold_key(F.col("email")))
    held = membership.possible(users.select("id", fold_key(F.col("email")).alias("__ukey")), "__ukey", c, "__ckey")
    per_key = held.groupBy("__ukey").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__uid"))
    j = c.join(per_key, c.__ckey == per_key.__ukey, "left")
    taken = (F.col("__n").isNotNull()
             & (F.col(cand_id).isNull() | (F.col("__n") > 1) | (F.col("__uid") != F.col(cand_id))))
    return j.withColumn("email_taken", taken).drop("__ckey", "__ukey", "__n", "__uid")


def with_user_rules(normalised: DataFrame) -> DataFrame:
    """DQ-8..13 on normalised user rows that have ``email_taken``."""
    return with_violations(normalised, user_rules(F.col("nom"), F.col("prenom"), F.col("email"), F.col("role"),
                                                  F.col("libelle"), F.col("email_taken")))


def validate_user_rows(changes: DataFrame, users: DataFrame) -> DataFrame:
    """DQ-8..13 on user rows (insert or update), each by itself against the stored users."""
    return with_user_rules(email_usage(normalise_users(changes), users))


def validate_variations(variations: DataFrame) -> DataFrame:
    """DQ-4..7 on stored variation rows (the supplement as its decimal text)."""
    sup_text = F.col("prix_supplement").cast("string")
    rules = variation_rules(F.col("libelle"), sup_text, F.col("stock"), F.col("stock_utilise"),
                            F.col("reference"))
    rules.append(("attributs", MSG["attributes_invalid"], ~attrs.attributes_valid(F.col("attributs"))))
    return with_violations(variations, rules)


def supplier_label_missing(users: DataFrame) -> DataFrame:
    """DQ-11 on stored users: suppliers without a trade name."""
    return users.filter((F.col("role") == "ROLE_FOURNISSEUR") & (php_trim(F.col("libelle")) == ""))


def duplicate_emails(users: DataFrame) -> DataFrame:
    """DQ-12: users whose e-mail is shared with another row (case, accents and
    trailing spaces ignored; deleted rows count). Counts are a partial/final
    aggregate joined back, so one very common address is not a single task."""
    keyed = users.withColumn("email_key", fold_key(F.col("email")))
    dup = (keyed.groupBy("email_key").agg(F.count(F.lit(1)).alias("n_same"))
           .filter(F.col("n_same") > 1))
    return keyed.join(dup, "email_key").select("id", "email", "n_same")


def clashing_references(batch: DataFrame, variations: DataFrame) -> DataFrame:
    """DQ-19 for a batch: its rows (``id, reference``) whose reference another row holds, of the batch or stored.

    The stored table is only read for the batch's own references, so the work after its scan follows the batch.
    """
    from vitrine.functions.references import comparable_reference
    keyed = batch.filter(F.col("reference").isNotNull()).select("id", "reference", comparable_reference(F.col("reference")).alias("__key"))
    stored = variations.filter(F.col("reference").isNotNull()).select("id", comparable_reference(F.col("reference")).alias("__key"))
    met = membership.possible(stored, "__key", keyed, "__key").unionByName(keyed.select("id", "__key")).distinct()
    held = met.groupBy("__key").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    return keyed.join(held, "__key").select("id", "reference", "n_rows")


def duplicate_references(variations: DataFrame) -> DataFrame:
    """DQ-19: references held by more than one row under the table collation."""
    from vitrine.functions.references import comparable_reference
    return (variations.filter(F.col("reference").isNotNull())
            .groupBy(comparable_reference(F.col("reference")).alias("reference_key"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


NOT_NULL_COLUMNS = {
    "users": ["id", "nom", "prenom", "email", "role", "is_deleted"],
    "products": ["id", "libelle", "description", "prix", "fournisseur_id"],
    "product_variations": ["id", "product_id", "libelle", "attributs", "prix_supplement", "stock",
                           "stock_utilise", "is_deleted"],
}


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-18: NULL count of every NOT NULL column, one pass per table."""
    parts = []
    for name, cols in NOT_NULL_COLUMNS.items():
        df = tables[name]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
        parts.append(counts.unpivot([], cols, "column_name", "null_count")
                     .withColumn("table_name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "column_name", "null_count")
